import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from temporalis.operators import order


def test_ranks_equal_percentiles(spark):
    r = random.Random(1)
    rows = [(k, s, r.choice([None, round(r.uniform(-3, 3), 1), r.gauss(0, 1), 0.0, -0.0])) for k, n in ((0, 1), (1, 2), (2, 500), (3, 2000), (None, 40)) for s in ("a", "b") for _ in range(n)]
    rows += [(9, "a", None)]
    df = spark.createDataFrame(rows, "k int, s string, x double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    told = lambda d: {(x.k, x.s): list(x.q) for x in d.collect()}
    near, far = told(order.quantiles(df, ["k", "s"], "x", probs)), told(order.quantiles(df, ["k", "s"], "x", probs, buffer=10))
    assert near.keys() == far.keys() and (9, "a") not in near
    for key, q in near.items():
        own = [x for k, s, x in rows if (k, s) == key and x is not None]
        assert q == pytest.approx(np.quantile(own, probs)) and far[key] == pytest.approx(q)
    assert order.quantiles(df.where("false"), ["k"], "x", [0.5], buffer=0).count() == 0


def test_a_group_of_millions_is_cut_anywhere(spark):
    n = 3_000_000
    rows = spark.range(n).select(F.when(F.col("id") % 1000 == 0, 1).otherwise(0).alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("x"))
    got = {x.k: x.q for x in order.quantiles(rows, ["k"], "x", [0.25, 0.5]).collect()}
    values = (np.arange(n) * 7919) % n
    for k, own in ((0, values[np.arange(n) % 1000 != 0]), (1, values[::1000])):
        assert got[k] == pytest.approx(np.quantile(own, [0.25, 0.5]))
    dealt = rows.repartitionByRange(8, "k", "x").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert dealt < n / 4  # what a task of it holds
