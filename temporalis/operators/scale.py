"""Scaling of panels by each variable's training statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def fit(long: DataFrame, sample: bool = False) -> DataFrame:
    """(var, mean, std) over the TRAIN rows; population deviation, or the sample one."""
    std = F.stddev_samp if sample else F.stddev_pop
    return long.where("split = 'TRAIN'").groupBy("var").agg(F.avg("x").alias("mean"), std("x").alias("std"))


def transform(long: DataFrame, stats: DataFrame, eps: float = EPS) -> DataFrame:
    """x becomes (x - mean) / (std + eps). stats has a row a variable."""
    return long.join(F.broadcast(stats), "var").withColumn("x", (F.col("x") - F.col("mean")) / (F.col("std") + F.lit(eps))).drop("mean", "std")


def bounds(long: DataFrame) -> DataFrame:
    """(var, low, high) of the TRAIN rows."""
    return long.where("split = 'TRAIN'").groupBy("var").agg(F.min("x").alias("low"), F.max("x").alias("high"))
