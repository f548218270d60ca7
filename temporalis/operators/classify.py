"""Linear classification of features and its metrics."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship
from . import path
from .order import placed

POINTS = 6
PART_BYTES = 32 << 20
#: Paths that run side by side, and the duality gap that is near enough to compare penalties.
FITS = 4
FOLD_TOL = 1e-3


def class_weights(rows: DataFrame) -> DataFrame:
    """(label, n, weight): n rows of all / (classes * rows of the class)."""
    each = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = each.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return each.crossJoin(F.broadcast(total)).select("label", "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def classes(rows: DataFrame) -> DataFrame:
    """(label, class_idx) in sorted order; a row a class."""
    return rows.select("label").distinct().withColumn("class_idx", F.row_number().over(Window.orderBy("label")) - 1)


def penalties(data: path.Rows, points: int = POINTS) -> list[float]:
    """L1 penalties from just below the one that leaves no weight down to a 300th of it."""
    slopes = path.sums(data, np.zeros((data.classes, data.features)), np.zeros(0, dtype=int)).slopes
    top = float(np.abs(slopes).max()) if slopes.size else 0.0
    return [(top or 1.0) * 10.0**x for x in np.linspace(-0.5, -2.5, points)]


def prototype_path(n: int, points: int = 20) -> list[float]:
    """Penalties of the older prototype: inverse strengths from 1e-5 to 10, over n balanced rows."""
    return [1.0 / (c * n) for c in np.logspace(-5, 1, points)]


def balanced_rows(feats: DataFrame, folds: int = 1) -> DataFrame:
    """(class_idx, weight, feats, fold) of TRAIN, stored, in parts of about PART_BYTES: fits pass over them many times.

    Folds are dealt in turn, in order of label and a hash: every fold has its share of each class.
    """
    own = feats.where("split = 'TRAIN'")
    if folds > 1:
        dealt = placed(own.withColumn("_hash", F.xxhash64("series_id")), ["label", "_hash", "series_id"]).withColumn("fold", F.col("place") % folds)
    else:
        dealt = own.withColumn("fold", F.lit(0))
    rows = dealt.join(F.broadcast(classes(own)), "label").join(F.broadcast(class_weights(own).select("label", "weight")), "label")
    size = own.agg(F.sum(F.size("feats")).alias("n")).first().n or 0
    return cut(rows.select("class_idx", "weight", "feats", F.col("fold").cast("int").alias("fold")).repartition(max(1, 8 * size // PART_BYTES)))


def train(feats: DataFrame, folds: int = 3, penalty_path: list[float] | None = None, standardised: bool = True) -> np.ndarray:
    """Weights [class, feature] of balanced L1 logistic regression without intercept; the penalty is chosen by stratified folds.

    Each fold's path is fitted on the other folds (FITS paths side by side) and read on its own;
    the penalty of least mean loss is fitted on all rows, down the path to it.
    """
    rows = balanced_rows(feats, folds)
    data = path.prepared(rows, standardised)
    if not data.features:
        return np.zeros((data.classes, 0))
    wanted = sorted(penalty_path or penalties(data), reverse=True)
    if folds > 1 and len(wanted) > 1:

        def losses(k: int) -> list[float]:
            rest = path.prepared(rows.where(F.col("fold") != k), standardised)._replace(classes=data.classes)
            return path.held_out_loss(rows.where(F.col("fold") == k), path.l1_path(rest, wanted, tol=FOLD_TOL))

        with ThreadPoolExecutor(FITS) as pool:
            mean = np.mean(list(pool.map(losses, range(folds))), axis=0)
        wanted = wanted[: int(mean.argmin()) + 1]
    return path.l1_path(data, wanted)[-1].weights


def coefficients(weights: np.ndarray, spark) -> DataFrame:
    """(class_idx, formula_id, w): small, a row a class and feature."""
    return spark.createDataFrame([(i, j, float(weights[i, j])) for i in range(weights.shape[0]) for j in range(weights.shape[1])], "class_idx int, formula_id int, w double")


def class_means(long: DataFrame) -> DataFrame:
    """(class_idx, formula_id, d): how far the TRAIN mean of a feature in each class lies above that of all."""
    own = long.where("split = 'TRAIN'")
    of_each = own.groupBy("label", "formula_id").agg(F.avg("rho").alias("m"))
    of_all = own.groupBy("formula_id").agg(F.avg("rho").alias("all"))
    return of_each.join(F.broadcast(of_all), "formula_id").join(F.broadcast(classes(own)), "label").select("class_idx", "formula_id", F.round(F.col("m") - F.col("all"), 9).alias("d"))  # a row a formula, a row a class


def shrunken(means: DataFrame, shrink: float) -> DataFrame:
    """Weights (class_idx, formula_id, w): class means drawn towards the mean of all by shrink, zero where that passes it."""
    return means.select("class_idx", "formula_id", (F.signum("d") * F.greatest(F.abs("d") - F.lit(float(shrink)), F.lit(0.0))).alias("w"))


def binary_expanded(coef: DataFrame) -> DataFrame:
    """One row of weights stands for two classes: its negative and itself."""
    return coef.select(F.lit(0).alias("class_idx"), "formula_id", (-F.col("w")).alias("w")).unionByName(coef.select(F.lit(1).alias("class_idx"), "formula_id", "w"))


def nonzero_features(coef: DataFrame) -> DataFrame:
    return coef.groupBy("formula_id").agg(F.max(F.abs("w")).alias("top")).where("top > 0").select("formula_id")


def weights_of(coef: DataFrame) -> np.ndarray:
    """The weights [class, feature] of coef (class_idx, formula_id, w): a row a class and feature."""
    told = coef.collect()
    weights = np.zeros((max((r.class_idx for r in told), default=-1) + 1, max((r.formula_id for r in told), default=-1) + 1))
    for r in told:
        weights[r.class_idx, r.formula_id] = r.w
    return weights


def scored(feats: DataFrame, coef: DataFrame) -> DataFrame:
    """Packed rows (series_id, label, split, feats) with scores, the weighted sum of features a class, and class_idx.

    class_idx has the largest score to nine digits, the first class on ties. A missing feature counts as 0. Nothing
    is shuffled: the product is taken in the row.
    """
    ship(feats.sparkSession)
    weights = weights_of(coef)

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.nan_to_num(b.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1))
            z = x[:, : weights.shape[1]] @ weights.T  # features without a weight count nothing
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(weights)), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(np.round(z, 9).argmax(axis=1).astype(np.int32))], names=["series_id", "label", "split", "feats", "scores", "class_idx"])

    rows = feats.select("series_id", "label", "split", "feats")
    return rows.mapInArrow(work, f"{rows.schema.simpleString()[7:-1]}, scores array<double>, class_idx int".replace(":", " "))


def scores(rows: DataFrame) -> DataFrame:
    """(series_id, class_idx, score) of scored rows."""
    return rows.select("series_id", F.posexplode("scores").alias("class_idx", "score"))


def predictions(long_scores: DataFrame) -> DataFrame:
    """(series_id, class_idx) of the largest score, the first class on ties, of rows (series_id, class_idx, score)."""
    return long_scores.groupBy("series_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "class_idx")).alias("top")).select("series_id", F.col("top.class_idx").alias("class_idx"))


def long_scores(long: DataFrame, coef: DataFrame) -> DataFrame:
    """(series_id, class_idx, score) of some features only, given as rows (series_id, formula_id, rho)."""
    return long.join(F.broadcast(coef), "formula_id").groupBy("series_id", "class_idx").agg(F.sum(F.col("w") * F.col("rho")).alias("score"))  # classes times features


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, label, pred, n) of judged rows; by: what tells runs apart."""
    return rows.groupBy(*(by or []), "label", "pred").agg(F.count("*").alias("n"))


def report(conf: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 (0 where undefined) and support of every class that occurs or is predicted."""
    by = by or []
    sides = conf.select(*by, "n", "label", F.lit(True).alias("true"), (F.col("label") == F.col("pred")).alias("right")).unionByName(conf.select(*by, "n", F.col("pred").alias("label"), F.lit(False).alias("true"), F.lit(False).alias("right")))
    some = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).cast("long")
    both = sides.groupBy(*by, "label").agg(some(F.col("true")).alias("support"), some(F.col("right")).alias("tp"), some(~F.col("true")).alias("positives"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return both.select(*by, "label", zero(F.col("tp"), F.col("positives")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), zero(2 * F.col("tp"), F.col("positives") + F.col("support")).alias("f1"), "support")


def balanced_accuracy(rows: DataFrame) -> DataFrame:
    recall = rows.groupBy("label").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("recall"))
    return recall.agg(F.avg("recall").alias("balanced_accuracy"), F.count("*").alias("n_classes"))
