"""The formula bank: sample, centre, prune by correlation, trim, until it is full.

Undefined correlations (a constant feature) are null and never prune.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula import Formula, Sampler, shifted
from ..functions.robustness import features
from ..session import cut, ship
from . import scale

#: A feature is constant if its deviation over TRAIN, from sums of squares, is below this share of 1 + |mean|.
FLAT = 1e-7
#: Columns of a block of the matrix of products, and tiles that a task holds (at most 3 MB each).
WIDTH, GROUP = 256, 64


def centres(long: DataFrame) -> DataFrame:
    """(formula_id, delta): minus the TRAIN mean of each feature."""
    return long.where("split = 'TRAIN'").groupBy("formula_id").agg((-F.avg("rho")).alias("delta"))


def centred(long: DataFrame) -> DataFrame:
    """rho + delta, on all splits. A row a formula is broadcast."""
    return long.join(F.broadcast(centres(long)), "formula_id").withColumn("rho", F.col("rho") + F.col("delta"))


class Columns(NamedTuple):
    """Of the TRAIN rows: their number, and each feature's values, mean and deviation (0 if constant)."""

    n: int
    values: np.ndarray
    mean: np.ndarray
    std: np.ndarray


def _rows_of(column: pa.Array, m: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, m)


def columns(feats: DataFrame, m: int) -> Columns:
    """In one pass; m numbers a task reach the driver."""
    ship(feats.sparkSession)

    def task(batches):
        total = np.zeros((3, m))
        rows = 0
        for b in batches:
            x = _rows_of(b.column(0), m)
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            rows, total = rows + len(x), total + [there.sum(axis=0), x.sum(axis=0), (x * x).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["n", "sums"])

    found = feats.where("split = 'TRAIN'").select("feats").mapInArrow(task, "n long, sums array<double>").toArrow()
    n, total = 0, np.zeros((3, m))
    for own, sums in zip(found.column(0).to_pylist(), found.column(1), strict=True):
        n, total = n + own, total + sums.values.to_numpy().reshape(3, m)
    mean = total[1] / np.maximum(total[0], 1)
    std = np.sqrt(np.maximum(total[2] / np.maximum(total[0], 1) - mean**2, 0.0))
    return Columns(n, total[0], mean, np.where(std > FLAT * (1 + np.abs(mean)), std, 0.0))


def _tiles(feats: DataFrame, m: int, about: Columns, schema: str, told) -> DataFrame:
    """told(first, second, r) of each pair of column blocks, as rows; r is NaN where undefined.

    The matrix of products is added up in tiles of WIDTH x WIDTH. A task holds GROUP of them at a time
    (rows are read once a group), their sums over tasks meet tile by tile, and only told's rows leave.
    """
    blocks = -(-m // WIDTH)
    pairs = [(p, q) for p in range(blocks) for q in range(p, blocks)]
    whole = bool((about.values == about.n).all())
    center, scale = about.mean, np.where(about.std > 0, 1.0 / np.where(about.std > 0, about.std, 1.0), 0.0)

    def products(some: list[tuple[int, int]]):
        def task(batches):
            sums: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                x = (_rows_of(b.column(0), m) - center) * scale
                there = ~np.isnan(x)
                x, one = np.where(there, x, 0.0), there.astype(float)
                for p, q in some:
                    a, c = x[:, p * WIDTH : (p + 1) * WIDTH], x[:, q * WIDTH : (q + 1) * WIDTH]
                    if whole:
                        own = (a.T @ c)[None]
                    else:  # a series without a value for a formula is left out of that formula's pairs
                        ha, hc = one[:, p * WIDTH : (p + 1) * WIDTH], one[:, q * WIDTH : (q + 1) * WIDTH]
                        own = np.array([a.T @ c, a.T @ hc, ha.T @ c, (a * a).T @ hc, ha.T @ (c * c), ha.T @ hc])
                    sums[p, q] = own if (p, q) not in sums else sums[p, q] + own
            for (p, q), own in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([p * blocks + q]), pa.array([own.ravel()], pa.list_(pa.float64()))], names=["tile", "sums"])

        return task

    def meet(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for tile, sums in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = sums.values.to_numpy()
                total[tile] = own if tile not in total else total[tile] + own
        for tile, own in total.items():
            p, q = divmod(tile, blocks)
            first, second = (np.arange(k * WIDTH, min(m, (k + 1) * WIDTH)) for k in (p, q))
            own = own.reshape(-1, len(first), len(second))
            with np.errstate(divide="ignore", invalid="ignore"):
                if whole:
                    r = own[0] / about.n
                    r[about.std[first] == 0], r[:, about.std[second] == 0] = np.nan, np.nan
                else:
                    xy, x, y, xx, yy = own[:5] / own[5]
                    sx, sy = np.sqrt(np.maximum(xx - x * x, 0.0)), np.sqrt(np.maximum(yy - y * y, 0.0))
                    r = np.where((sx > FLAT) & (sy > FLAT), (xy - x * y) / (sx * sy), np.nan)
            r[first[:, None] >= second[None, :]] = -np.inf  # each pair once
            yield told(first, second, r)

    rows = feats.where("split = 'TRAIN'").select("feats")
    found = [rows.mapInArrow(products(pairs[i : i + GROUP]), "tile long, sums array<double>").repartition("tile").mapInArrow(meet, schema) for i in range(0, len(pairs), GROUP)]
    return reduce(DataFrame.unionByName, found)


def correlations(feats: DataFrame, m: int) -> DataFrame:
    """(k, i, r) for formulas k < i of packed rows over TRAIN; r is null if either is constant, or without any common series."""

    def told(first: np.ndarray, second: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        k, i = np.nonzero(r != -np.inf)
        own = r[k, i]
        return pa.RecordBatch.from_arrays([pa.array(first[k].astype(np.int32)), pa.array(second[i].astype(np.int32)), pa.array(own, mask=np.isnan(own))], names=["k", "i", "r"])

    return _tiles(feats, m, columns(feats, m), "k int, i int, r double", told)


def correlated(feats: DataFrame, m: int, threshold: float) -> DataFrame:
    """(formula_id): each formula that any earlier one, kept or not, is correlated with. Tiles apply the rule, no matrix leaves them."""

    def told(first: np.ndarray, second: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        gone = second[((np.abs(r) > threshold) & (r != -np.inf)).any(axis=0)]
        return pa.RecordBatch.from_arrays([pa.array(gone.astype(np.int32))], names=["formula_id"])

    return _tiles(feats, m, columns(feats, m), "formula_id int", told).distinct()


def kept(bank: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Bank without each formula that any earlier one, kept or not, is correlated with."""
    gone = pairs.where(F.abs("r") > threshold).select(F.col("i").alias("formula_id")).distinct()
    return bank.join(gone, "formula_id", "left_anti")


def build_bank(panel: DataFrame, long: DataFrame, steps: int, n_formulas: int, batch: int = 500, threshold: float = 0.98, max_iter: int = 20, depth: int = 3, only_temporal: bool = True, until_weight: float = 0.0, seed: int = 0) -> tuple[list[Formula], DataFrame]:
    """(formulas, feats): at most n_formulas centred formulas, none correlated with an earlier one."""
    limits = scale.bounds(long).orderBy("var").collect()
    sampler = Sampler([r.low for r in limits], [r.high for r in limits], steps - 1, depth, seed, only_temporal, until_weight)
    bank: list[Formula] = []
    rows = panel.withColumn("feats", F.array().cast("array<double>"))
    for _ in range(max_iter):
        need = n_formulas - len(bank)
        if need <= 0:
            break
        new = sampler.sample(max(need, batch))
        # a row keeps its series and all its features: nothing is joined
        drawn = cut(features(rows, new, steps, append=True))
        delta = -columns(drawn, len(bank) + len(new)).mean[len(bank) :]
        bank += [shifted(phi, float(d)) for phi, d in zip(new, delta, strict=True)]
        gone = {r.formula_id for r in correlated(drawn, len(bank), threshold).collect()}  # a shift changes no correlation
        stay = [j for j in range(len(bank)) if j not in gone][:n_formulas]
        move = [0.0] * (len(bank) - len(new)) + delta.tolist()
        bank = [bank[j] for j in stay]
        # columns and shifts travel as one literal each, not as a thousand
        chosen = F.zip_with(F.transform(F.lit(stay), lambda j: F.get(F.col("feats"), j)), F.lit([move[j] for j in stay]), lambda x, d: x + d) if stay else F.array().cast("array<double>")
        rows = drawn.withColumn("feats", chosen)
    return bank, cut(rows.select("series_id", "label", "split", "feats"))
