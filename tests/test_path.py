import numpy as np
import pytest
from pyspark.sql import functions as F

from temporalis.operators import classify, path
from temporalis.plans import queries
from temporalis.session import cut


@pytest.fixture(scope="module")
def drawn():
    r = np.random.default_rng(0)
    n, m, k = 500, 24, 4
    true = np.zeros((k, m))
    true[:, :5] = r.normal(size=(k, 5)) * 1.5
    x = r.normal(size=(n, m)) * r.uniform(0.3, 2, m)
    x[:, 7], x[:, 23] = x[:, 0] + 0.1 * r.normal(size=n), 0.0
    y = (x @ true.T + r.gumbel(size=(n, k))).argmax(axis=1)
    return x, y, n / (k * np.bincount(y, minlength=k)[y])


@pytest.fixture(scope="module")
def rows(spark, drawn):
    x, y, w = drawn
    return cut(spark.createDataFrame([(int(a), float(b), c.tolist()) for a, b, c in zip(y, w, x, strict=True)], "class_idx int, weight double, feats array<double>").repartition(3))


def objective(drawn, weights, penalty):
    x, y, w = drawn
    z = x @ weights.T
    top = z.max(axis=1)
    return (w * (np.log(np.exp(z - top[:, None]).sum(axis=1)) + top - z[np.arange(len(y)), y])).sum() / w.sum() + penalty * np.abs(weights).sum()


def test_path_reaches_the_least_objective(spark, drawn, rows, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = path.prepared(rows, standardised=False)
    assert (data.classes, data.features) == (4, 24) and data.total == pytest.approx(500)
    fits = path.l1_path(data, points=5)
    assert not fits[0].weights.any() and fits[0].loss == pytest.approx(np.log(4))
    assert all(f.gap < 1e-4 and f.passes < 30 for f in fits) and not any(f.weights[:, 23].any() for f in fits)
    used = [int((f.weights != 0).any(axis=0).sum()) for f in fits]
    assert used[1] < 12 and used[1] < used[-1]
    v = rows.select(F.col("class_idx").cast("double").alias("label"), "weight", array_to_vector("feats").alias("features")).cache()
    for f in fits[2:4:2]:
        model = LogisticRegression(weightCol="weight", regParam=f.penalty, elasticNetParam=1.0, fitIntercept=False, family="multinomial", maxIter=200, tol=1e-9, standardization=False).fit(v)
        theirs, ours = objective(drawn, model.coefficientMatrix.toArray(), f.penalty), objective(drawn, f.weights, f.penalty)
        assert theirs - f.gap - 1e-3 < ours < theirs + f.gap + 1e-9
    # so do sums that meet in tasks, and classes taken apart
    monkeypatch.setattr(path, "AT_ONCE", 0)
    monkeypatch.setattr(path, "COUPLED", 0)
    again = path.l1_path(data, [fits[1].penalty], tol=5e-3)[0]
    assert objective(drawn, again.weights, again.penalty) - objective(drawn, fits[1].weights, again.penalty) < again.gap + 1e-9 < 6e-3


def test_standardised_path_is_that_of_divided_features(spark, drawn, rows):
    x, y, w = drawn
    std = x.std(axis=0)
    fits = path.l1_path(path.prepared(rows), [0.03])
    divided = (x / np.where(std > 0, std, 1.0), y, w)
    assert objective(divided, fits[0].weights * std, 0.03) < objective(divided, np.zeros((4, 24)), 0.03)
    assert fits[0].gap < 1e-4


def test_held_out_loss_and_edges(spark, drawn, rows):
    data = path.prepared(rows)
    fits = path.l1_path(data, [0.05, 0.01])
    assert path.held_out_loss(rows, fits) == pytest.approx([f.loss for f in fits])
    empty = path.prepared(rows.where("false"))
    assert path.l1_path(empty) == [] and (empty.classes, empty.features) == (0, 0)
    odd = spark.createDataFrame([(0, 1.0, [1.0, None, float("nan")]), (1, 1.0, [-1.0, 2.0, 0.0]), (None, 1.0, [9.0, 9.0, 9.0]), (0, 1.0, None)], "class_idx int, weight double, feats array<double>")
    got = path.l1_path(path.prepared(odd, standardised=False), [0.1])
    assert got[0].weights[0, 0] > 0 > got[0].weights[1, 0] and got[0].gap < 1e-4


def test_training_chooses_by_folds_and_predicts(spark, drawn):
    x, y, _ = drawn
    feats = spark.createDataFrame([(i, f"c{a}", "TRAIN" if i % 4 else "TEST", v.tolist()) for i, (a, v) in enumerate(zip(y, x, strict=True))], "series_id long, label string, split string, feats array<double>")
    weights = classify.train(feats)
    assert weights.shape == (4, 24) and (x[::4] @ weights.T).argmax(axis=1).tolist().count(0) > 0
    assert ((x[::4] @ weights.T).argmax(axis=1) == y[::4]).mean() > 0.6
    assert classify.coefficients(weights, spark).count() == 96


def test_query_stays_near_the_least(spark):
    got = queries.ALL["l1_path"][0](queries.Frames(spark, "/root/testdata/sf0.001")).orderBy(F.desc("penalty")).collect()
    assert len(got) == 20 and got[0].n_nonzero == 0 and got[-1].n_nonzero > 4 and all(r.gap < 1e-4 for r in got)
    assert [r.loss for r in got] == sorted([r.loss for r in got], reverse=True)
