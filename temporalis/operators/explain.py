"""Explanations: contributions, re-thresholded formulas, greedy picks, and global disjunctions.

A shift of thresholds adds the shift to the robustness, so nothing is evaluated again: a
re-thresholded formula is sign * rho + delta of the stored feature. Undefined metrics are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship
from . import classify
from .order import placed, quantiles

#: Products of features and weights that are held at a time.
SIDE_BY_SIDE = 1 << 21


def _each_series(rows: DataFrame, coef: DataFrame, schema: str, work, missing: float = 0.0) -> DataFrame:
    """work(class_idx, feats, weights) gives, for the series of a batch, (place of its series, columns of schema) of the rows to return.

    rows (series_id, class_idx, feats) are packed, the model is a row a class and feature: nothing is shuffled.
    A missing feature counts as 0; if missing is NaN, work gets features as they are.
    """
    ship(rows.sparkSession)
    weights = classify.weights_of(coef)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            x = x if np.isnan(missing) else np.nan_to_num(x, nan=missing)
            # as many series at a time as keep the products small
            share = max(1, SIDE_BY_SIDE // max(1, weights.size))
            for lo in range(0, b.num_rows, share):
                at, *columns = work(b.column(1)[lo : lo + share].to_numpy(zero_copy_only=False).astype(np.int64), x[lo : lo + share], weights)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + lo)), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=["series_id", *(c.split()[0] for c in schema.split(", "))])

    kind = rows.schema["series_id"].dataType.simpleString()
    return rows.select("series_id", "class_idx", "feats").mapInArrow(run, f"series_id {kind}, {schema}")


def _against(t: np.ndarray, x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(competitors [series, K - 1], (w of the class - w of the competitor) * rho [series, K - 1, M])."""
    others = np.array([[c for c in range(len(weights)) if c != k] for k in range(len(weights))], dtype=np.int64).reshape(len(weights), -1)[t]
    return others, (weights[t][:, None] - weights[others]) * x[:, None]


def _first_m(values: np.ndarray, m: int) -> np.ndarray:
    """The places of the m largest of the last axis to nine digits, the first of equal ones first."""
    return np.argsort(-np.round(values, 9), axis=-1, kind="stable")[..., :m]


def contributions(rows: DataFrame, coef: DataFrame) -> DataFrame:
    """(series_id, competitor, formula_id, c): (w of the series' class - w of the competitor) * rho."""

    def work(t, x, weights):
        others, c = _against(t, x, weights)
        n, k, m = c.shape
        return np.repeat(np.arange(n), k * m), np.repeat(others.ravel(), m).astype(np.int32), np.tile(np.arange(m, dtype=np.int32), n * k), c.ravel()

    return _each_series(rows, coef, "competitor int, formula_id int, c double", work)


def class_contributions(rows: DataFrame, coef: DataFrame) -> DataFrame:
    """(series_id, class_idx, formula_id, c): w * rho of every class."""

    def work(t, x, weights):
        c = weights[None] * x[:, None]
        n, k, m = c.shape
        return np.repeat(np.arange(n), k * m), np.tile(np.repeat(np.arange(k, dtype=np.int32), m), n), np.tile(np.arange(m, dtype=np.int32), n * k), c.ravel()

    return _each_series(rows, coef, "class_idx int, formula_id int, c double", work)


def top_m(rows: DataFrame, coef: DataFrame, m: int) -> DataFrame:
    """(series_id, formula_id, total, rank): the m features of largest sum over competitors."""

    def work(t, x, weights):
        total = (len(weights) * weights - weights.sum(axis=0))[t] * x
        first = _first_m(total, m)
        n, k = first.shape
        return np.repeat(np.arange(n), k), first.ravel().astype(np.int32), np.take_along_axis(total, first, 1).ravel(), np.tile(np.arange(1, k + 1, dtype=np.int32), n)

    return _each_series(rows, coef, "formula_id int, total double, rank int", work)


def top_m_each(rows: DataFrame, coef: DataFrame, m: int) -> DataFrame:
    """The same against each competitor, with the role of each pick."""

    def work(t, x, weights):
        others, c = _against(t, x, weights)
        first = _first_m(c, m)
        n, k, count = first.shape
        return np.repeat(np.arange(n), k * count), np.repeat(others.ravel(), count).astype(np.int32), first.ravel().astype(np.int32), np.take_along_axis(c, first, 2).ravel(), np.tile(np.arange(1, count + 1, dtype=np.int32), n * k)

    found = _each_series(rows, coef, "competitor int, formula_id int, c double, rank int", work)
    return found.withColumn("role", F.when(F.col("c") > 0, "supports").otherwise("threatens"))


def margins(rows: DataFrame, coef: DataFrame, each: int, overall: int) -> DataFrame:
    """(series_id, competitor, full_margin, own_margin, top_margin): of all features, of the best against that competitor, and of the best over all."""

    def work(t, x, weights):
        others, c = _against(t, x, weights)
        n, k, _ = c.shape
        own = np.take_along_axis(c, _first_m(c, each), 2).sum(axis=2)
        first = _first_m((len(weights) * weights - weights.sum(axis=0))[t] * x, overall)
        top = np.take_along_axis(c, np.repeat(first[:, None], k, axis=1), 2).sum(axis=2)
        return np.repeat(np.arange(n), k), others.ravel().astype(np.int32), c.sum(axis=2).ravel(), own.ravel(), top.ravel()

    return _each_series(rows, coef, "competitor int, full_margin double, own_margin double, top_margin double", work)


def class_medians(long: DataFrame) -> DataFrame:
    return quantiles(long.where("split = 'TRAIN'"), ["formula_id", "label"], "rho", [0.5]).select("formula_id", "label", F.get("q", F.lit(0)).alias("med"))


def reference_classes(medians: DataFrame) -> DataFrame:
    """(formula_id, target, med_t, reference, med_r): the class that a formula should tell the target from.

    Nothing below: the smallest above; nothing above: the largest below; as many on either
    side: the farthest; else the nearest of the side that holds more. Ties go to the first class; if all
    medians equal the target's, the target is its own reference.
    """
    t = medians.select("formula_id", F.col("label").alias("target"), F.col("med").alias("med_t"))
    pairs = t.join(medians, "formula_id").where("target <> label")
    w = Window.partitionBy("formula_id", "target")
    below, above = F.col("med") < F.col("med_t"), F.col("med") > F.col("med_t")
    rows = pairs.withColumn("nb", F.sum(below.cast("int")).over(w)).withColumn("na", F.sum(above.cast("int")).over(w))
    nb, na, m = F.col("nb"), F.col("na"), F.col("med")
    key = (
        F.when((nb == 0) & (na == 0), None)
        .when(nb == 0, F.when(above, m))
        .when(na == 0, F.when(below, -m))
        .when(na == nb, -F.abs(m - F.col("med_t")))
        .when(nb > na, F.when(below, -m))
        .otherwise(F.when(above, m))
    )
    first = rows.withColumn("key", key).withColumn("nth", F.row_number().over(w.orderBy(F.col("key").asc_nulls_last(), "label"))).where("nth = 1")
    chosen = first.select("formula_id", "target", F.when(F.col("key").isNotNull(), F.col("label")).alias("r"), F.when(F.col("key").isNotNull(), F.col("med")).alias("med_r"))
    return t.join(chosen, ["formula_id", "target"], "left").select("formula_id", "target", "med_t", F.coalesce("r", "target").alias("reference"), F.coalesce("med_r", "med_t").alias("med_r"))


def reparametrised(refs: DataFrame) -> DataFrame:
    """(formula_id, target, sign, delta): negate if the target lies lower; zero is then midway."""
    sign = F.when(F.col("med_t") < F.col("med_r"), -1).otherwise(1)
    return refs.select("formula_id", "target", "reference", sign.alias("sign"), (-sign * (F.col("med_t") + F.col("med_r")) / 2).alias("delta"))


def moved(rho: Column) -> Column:
    return F.col("sign") * rho + F.col("delta")


#: Series that a row of words holds a bit of.
BLOCK = 1 << 11
#: Stands for no formula: its words hold every series, and those of the class.
EVERY = -1


def block_words(feats: DataFrame, reparam: DataFrame, split: str) -> DataFrame:
    """(formula_id, target, block, on, own): bits that tell for which series of a block a formula holds, and which of them are the target's.

    feats are packed rows; a block of BLOCK series is packed in one task, into M x K rows of BLOCK / 64 words.
    reparam has a row a formula and class. A missing value doesn't hold.
    """
    ship(feats.sparkSession)
    told = reparam.select("formula_id", "target", "sign", "delta").collect()  # a row a formula and class
    targets = sorted({r.target for r in told})
    count = max((r.formula_id for r in told), default=-1) + 1
    sign, delta = np.zeros((count, len(targets))), np.full((count, len(targets)), np.nan)
    for r in told:
        sign[r.formula_id, targets.index(r.target)], delta[r.formula_id, targets.index(r.target)] = r.sign, r.delta
    width = BLOCK // 64

    def words(bits: np.ndarray) -> np.ndarray:
        """[..., series] to [..., words]."""
        return np.packbits(np.pad(bits, [*[(0, 0)] * (bits.ndim - 1), (0, BLOCK - bits.shape[-1])]), axis=-1, bitorder="little").view(np.int64)

    def packed(block: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        at = (t.column("place").to_numpy() - block * BLOCK).astype(np.int64)
        rho = np.full((count, BLOCK), np.nan)
        rho[:, at] = t.column("feats").chunk(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1).T[:count]
        there, label = np.zeros(BLOCK, dtype=bool), np.full(BLOCK, None, dtype=object)
        there[at], label[at] = True, t.column("label").to_pylist()
        of_class = np.array([there & (label == k) for k in targets]).reshape(len(targets), BLOCK)
        on = [words(np.broadcast_to(there, of_class.shape))]
        own = [words(of_class)]
        for j in range(count):
            holds = sign[j][:, None] * rho[j] + delta[j][:, None] > 0  # NaN doesn't
            on.append(words(holds)), own.append(words(holds & of_class))
        lists = [pa.ListArray.from_arrays(pa.array(np.arange((count + 1) * len(targets) + 1, dtype=np.int32) * width), pa.array(np.concatenate(w).ravel())) for w in (on, own)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(-1, count, dtype=np.int32), len(targets))), pa.array(targets * (count + 1)), pa.array(np.full((count + 1) * len(targets), block, dtype=np.int64)), *lists],
            names=["formula_id", "target", "block", "on", "own"],
        )

    def pack(batches):
        block, held = None, []
        for b in batches:
            blocks = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)] if len(blocks) else [0]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if held and blocks[lo] != block:
                    yield packed(block, held)
                    held = []
                block = int(blocks[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield packed(block, held)

    # places are dense, whatever the ids are
    rows = placed(feats.where(F.col("split") == split), ["series_id"]).select(F.floor(F.col("place") / BLOCK).alias("block"), "place", "label", "feats")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(pack, "formula_id int, target string, block long, on array<long>, own array<long>")


def _ones(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))


def _both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def greedy_picks(pool: DataFrame, words: DataFrame, pool_size: int, threshold: float) -> DataFrame:
    """(series_id, target, picks, precision, n_tp) for a pool (series_id, target, formula_id, rank).

    Every round adds the formula whose conjunction with those picked has the best TRAIN
    precision (the first by rank on ties), until it reaches the threshold or the pool is
    empty. What a set of picks holds for depends on the target and the set alone: pools with
    the same set share one state, whose words and trials are worked out once. The first round has one state a
    target and needs no words of its own. words should be stored (``block_words`` of TRAIN).
    """
    own = cut(pool.groupBy("series_id", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "formula_id"))), lambda s: s.formula_id.cast("int")).alias("order")))
    pools = cut(own.groupBy("target", "order").agg(F.min("series_id").alias("pool_id")))
    left = pools.select("pool_id", F.posexplode("order").alias("rank", "formula_id"))
    none = F.array().cast("array<int>")
    at = pools.select("pool_id", "target", none.alias("held"), none.alias("picks"), F.lit(-1.0).alias("precision"), F.lit(0).cast("long").alias("n_tp"))
    states, finished = None, at.where("false")
    for _ in range(pool_size):
        more = at.select("pool_id", "target", "held").join(left, "pool_id").where(~F.array_contains("held", F.col("formula_id")))
        if states is None:
            tried = words.where(F.col("formula_id") != EVERY).withColumn("held", none).withColumns({"n": _ones(F.col("on")), "tp": _ones(F.col("own"))})
        else:
            trials = more.select("target", "held", "formula_id").distinct().join(states, ["target", "held"])
            tried = trials.join(words, ["formula_id", "target", "block"]).withColumns({"n": _ones(_both(F.col("so_far"), F.col("on"))), "tp": _ones(_both(F.col("so_far"), F.col("own")))})
        counts = tried.groupBy("target", "held", "formula_id").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))
        each = more.join(counts, ["target", "held", "formula_id"], "left").withColumn("p", F.coalesce(F.try_divide("tp", "n"), F.lit(0.0)))
        best = each.groupBy("pool_id").agg(F.min(F.struct((-F.col("p")).alias("m"), "rank", "formula_id", F.coalesce("tp", F.lit(0)).alias("tp"))).alias("b"))
        now = cut(at.join(best, "pool_id", "left"))
        finished = finished.unionByName(now.where("b is null").drop("b"))
        picked = F.col("b.formula_id")
        moved_on = now.where("b is not null").select("pool_id", "target", F.array_sort(F.array_append("held", picked)).alias("held"), F.array_append("picks", picked).alias("picks"), (-F.col("b.m")).alias("precision"), F.col("b.tp").alias("n_tp"), F.col("held").alias("from"), picked.alias("added"))
        finished = finished.unionByName(moved_on.where(F.col("precision") >= threshold).drop("from", "added"))
        going = moved_on.where(F.col("precision") < threshold)
        at = going.drop("from", "added")
        if at.isEmpty():
            break
        new = going.groupBy("target", "held").agg(F.min(F.struct("from", F.col("added").alias("formula_id"))).alias("s")).select("target", "held", "s.from", "s.formula_id")
        on = new.join(words, ["formula_id", "target"])
        if states is None:
            on = on.select("target", "held", "block", F.col("on").alias("so_far"))
        else:
            on = on.join(states.withColumnRenamed("held", "from"), ["target", "from", "block"]).select("target", "held", "block", _both(F.col("so_far"), F.col("on")).alias("so_far"))
        states = cut(on)
    found = finished.unionByName(at).where("size(picks) > 0").select("pool_id", "picks", "precision", "n_tp").join(pools, "pool_id").drop("pool_id")
    return own.join(found, ["target", "order"]).select("series_id", "target", "picks", "precision", "n_tp")


def distinct_locals(local: DataFrame) -> DataFrame:
    """(target, picks, first_id): distinct locals of each class, told by what they pick, with their first appearance."""
    return local.groupBy("target", F.array_sort("picks").alias("picks")).agg(F.min("series_id").alias("first_id"))


def global_quality(words: DataFrame, picks: DataFrame) -> DataFrame:
    """(target, n_pos, tp, n_class, precision, coverage, f1) of each class's disjunction of conjunctions; null where undefined.

    words are those of TEST, picks (target, pick_id, formula_id) the conjunctions. Words meet by AND in a
    conjunction (as many as it has picks), and by OR in its class, a word at a time; only counts leave.
    """
    each = picks.join(words, ["formula_id", "target"]).groupBy("target", "pick_id", "block").agg(F.collect_list("on").alias("all"))
    holds = each.select("target", "block", F.posexplode(F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))).alias("i", "w"))
    any_of = holds.groupBy("target", "block", "i").agg(F.bit_or("w").alias("w"))
    every = words.where(F.col("formula_id") == EVERY).join(picks.select("target").distinct(), "target").select("target", "block", F.posexplode("own").alias("i", "of_class"))
    n = every.join(any_of, ["target", "block", "i"], "left").groupBy("target").agg(*[F.coalesce(F.sum(F.bit_count(c)), F.lit(0)).cast("long").alias(name) for c, name in ((F.col("w"), "n_pos"), (F.col("w").bitwiseAND(F.col("of_class")), "tp"), (F.col("of_class"), "n_class"))])
    return qualities(n)


def qualities(counts: DataFrame) -> DataFrame:
    """precision, coverage and f1 beside the counts (n_pos, tp, n_class)."""
    n = counts.withColumn("precision", F.try_divide("tp", "n_pos")).withColumn("coverage", F.try_divide("tp", "n_class"))
    return n.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("coverage"), F.col("precision") + F.col("coverage")))


def macro(quality: DataFrame) -> DataFrame:
    return quality.agg(F.avg("f1").alias("macro_f1"), F.count("f1").alias("n_defined"))
