import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from temporalis.operators import analytics, classify
from temporalis.plans import queries

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def model(spark, r, features=5, classes=4):
    coef = classify.coefficients(np.round(r.normal(size=(classes, features)), 2), spark)
    box = spark.createDataFrame([(j, *sorted(map(float, r.uniform(-0.5, 0.5, 2)))) for j in range(features)], "formula_id int, vmin double, vmax double")
    rows = [(i, int(r.integers(classes)), [float(v) for v in r.normal(0, 1.5, features)]) for i in range(60)]
    rows[0][2][1] = float("nan")
    return coef, box, spark.createDataFrame(rows, "series_id long, class_idx int, feats array<double>")


def long_gains(rows, coef, box):
    """The gains of packed rows by joins, as rows (series_id, competitor, formula_id, a, lb)."""
    own = coef.join(coef.select(F.col("class_idx").alias("competitor"), "formula_id", F.col("w").alias("other")), "formula_id").where("class_idx <> competitor").withColumn("d", F.col("w") - F.col("other"))
    low = analytics.worst_case(own, box)
    low = low.join(low.groupBy("class_idx", "competitor").agg((F.lit(1e-6) - F.sum("worst")).alias("lb")), ["class_idx", "competitor"])
    long = rows.select("series_id", "class_idx", F.posexplode("feats").alias("formula_id", "rho"))
    return long.join(low, ["class_idx", "formula_id"]).select("series_id", "competitor", "formula_id", F.round(F.col("d") * F.col("rho") - F.col("worst"), 9).alias("a"), F.round("lb", 9).alias("lb"))


def test_side_by_side_equals_one_by_one(monkeypatch):
    """Batches of series with and without a set, with nothing to secure, and with infinite gains; small shares and wide banks too."""
    r = np.random.default_rng(3)
    monkeypatch.setattr(analytics, "SUMS", 50)
    for rows, m in ((1, 1), (1, 6), (3, 6), (4, 7), (2, analytics.FEW + 1), (0, 3), (2, 0)):
        a, lb = np.round(r.normal(0.3, 1, (40, rows, m)), 2), np.round(r.uniform(-1.0, 2.5, (40, rows)), 2)
        lb[:5] = -1.0
        if m:
            a[:5, :, 0] = np.inf
        picks, least = analytics.fewest_features_each(a, lb)
        assert len(picks) == len(least) == 40
        for own, n, x, bar in zip(picks, least, a, lb, strict=True):
            k, short = analytics.fewest_features(x, bar)
            assert (own is None) == (k is None) and n == short and (own is None or len(own) == n and (x[:, own].sum(axis=1) >= bar - 1e-9).all())
    assert analytics.fewest_features_each(np.zeros((0, 2, 3)), np.zeros((0, 2))) == ([], [])
    assert analytics.fewest_features_each(np.ones((1, 1, 1100)), np.ones((1, 1)))[1] == [1]


def test_packed_abduction_equals_all_subsets(spark):
    coef, box, rows = model(spark, np.random.default_rng(11))
    own: dict = {}
    for x in long_gains(rows, coef, box).collect():
        own.setdefault(x.series_id, {}).setdefault(x.competitor, ({}, x.lb))[0][x.formula_id] = 0.0 if x.a is None or np.isnan(x.a) else x.a
    need = {}
    for i, sides in own.items():
        fits = [len(s) for k in range(6) for s in itertools.combinations(range(5), k) if all(sum(a[j] for j in s) >= lb - 1e-12 for a, lb in sides.values())]
        need[i] = min(fits, default=-1)
    found = analytics.abduced(rows, coef, box)
    assert "Exchange" not in plan(found) and "FlatMapGroups" not in plan(found)
    got = found.collect()
    assert {x.series_id: x.n_needed for x in got} == need and len(got) == 60 and len(set(need.values())) > 3 and min(need.values()) == -1
    for x in got:
        assert x.n_needed == (-1 if x.picks is None else len(x.picks)) and x.at_least == (None if x.picks is None else len(x.picks))
        assert x.picks is None or all(sum(a[j] for j in x.picks) >= lb - 1e-9 for a, lb in own[x.series_id].values())
    assert {x.series_id: x.n_needed for x in analytics.abduce(long_gains(rows, coef, box)).collect()} == need
    assert analytics.abduced(rows.limit(0), coef, box).count() == analytics.abduced(rows, coef, box.limit(0)).count() == 0


def test_long_abduction_keeps_its_parts(spark):
    """The rows are few bytes for their search: parts joined by size would leave all of it to one task."""
    r = np.random.default_rng(2)
    gains = spark.createDataFrame([(i, 1, j, float(r.normal()), 0.5) for i in range(200) for j in range(3)], "series_id long, competitor int, formula_id int, a double, lb double")
    parts = analytics.abduce(gains).withColumn("part", F.spark_partition_id()).select("part").distinct().count()
    assert parts >= 8


@tables
def test_whole_abduction_meets_no_series_in_a_task(spark):
    """Only the box is grouped (by formula), before; the search itself is taken in the packed row."""
    assert "FlatMapGroups" not in (found := plan(queries.ALL["abduce_whole"][0](queries.Frames(spark, SF)))) and "Exchange" not in found


def test_packed_margins_equal_joined_ones(spark):
    coef, box, rows = model(spark, np.random.default_rng(11))
    found = analytics.abduced_margins(rows, coef, box)
    assert "Exchange" not in plan(found) and "Join" not in plan(found)
    picks = analytics.abduced(rows, coef, box).where("n_needed >= 0").select("series_id", F.explode_outer("picks").alias("formula_id"))
    gains = long_gains(rows, coef, box).join(picks.select("series_id").distinct(), "series_id", "left_semi").withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    want = {(x.series_id, x.competitor): x.margin for x in analytics.verified_margins(gains, picks).collect()}
    got = found.collect()
    assert len(got) == len(want) > 60 and all(x.secured and x.margin == pytest.approx(want[x.series_id, x.competitor], abs=1e-9) for x in got)
    assert analytics.abduced_margins(rows, coef, box.limit(0)).count() == 0


@tables
def test_whole_margins_meet_no_series_in_a_task(spark):
    found = plan(queries.ALL["verified_margins_whole"][0](queries.Frames(spark, SF)))
    assert "MapInArrow" in found and not any(x in found for x in ("FlatMapGroups", "Exchange", "Join"))


@tables
def test_one_pair_meets_no_series_in_a_task(spark):
    """In the packed row, and no other answer than from sorted gains of the pair."""
    f = queries.Frames(spark, SF)
    found = queries.ALL["abduce_check"][0](f)
    assert "FlatMapGroups" not in plan(found) and "Exchange" not in plan(found)
    want = {x.series_id: x.n_needed if x.enough else -1 for x in queries.ALL["abduce_binary"][0](f).collect()}
    assert {x.series_id: x.n_needed for x in found.collect()} == want and len(set(want.values())) > 2
