import random
import re

import numpy as np
from pyspark.sql import functions as F

from temporalis.llm.textcore import span_hashes
from temporalis.llm.toxicity import HEADS, fit_ordinal, graded, score_toxicity, train_toxicity, without_toxic

BAD = ["vile", "foul", "rotten"]


def made(n, seed):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{'abcdefghij'[r.randrange(10)]}{'abcdefghij'[r.randrange(10)]}" for _ in range(r.randint(5, 60))]
        grade = r.choice([0, 0, 0, 1, 2])
        for _ in range(grade and 3 * grade - 1):
            words[r.randrange(len(words))] = r.choice(BAD) + r.choice(["", ",", "!!"])
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if grade == 2 else 1, int(grade > 0)))
    return docs, labels


def test_held_out_accuracy_and_ordering(spark):
    docs, labels = made(600, 1)
    d, g = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = train_toxicity(d.where("doc_id % 3 <> 0"), g.where("doc_id % 3 <> 0"), F.col("toxic") * (2 - F.col("quality")))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in score_toxicity(d.where("doc_id % 3 = 0"), model).collect()}
    assert len(got) == 200
    right = [got[i].toxic == bool(t) for i, _, t in labels if i in got]
    assert np.mean(right) > 0.97
    assert all(r.kept != r.toxic and 0 <= r.p_toxic <= r.severity <= 2 for r in got.values())
    of_grade = [np.mean([got[i].severity for i, q, t in labels if i in got and t * (2 - q) == k]) for k in range(3)]
    assert of_grade[0] < of_grade[1] < of_grade[2]


def test_severity_rises_with_marked_words_where_labels_have_no_grade(spark):
    r = random.Random(6)
    bad = [f"bad{c}" for c in "abcdefgh"]
    count = [r.choice([0, 0, 1, 2, 5, 7]) for _ in range(600)]
    rows = [(i, " ".join([f"w{r.randrange(10)}{'xyz'[r.randrange(3)]}" for _ in range(30)] + r.sample(bad, n))) for i, n in enumerate(count)]
    d, g = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(n > 0)) for i, n in enumerate(count)], "doc_id long, toxic int")
    model = train_toxicity(d.where("doc_id % 3 <> 0"), g)
    got = {x.doc_id: x.severity for x in score_toxicity(d.where("doc_id % 3 = 0"), model).collect()}
    mean = [np.mean([got[i] for i, n in enumerate(count) if i in got and n == k]) for k in (0, 1, 2, 5, 7)]
    assert len(model.thresholds) == 2 and mean == sorted(mean) and mean[0] < 0.2 and mean[-1] > 1.5
    places = np.array([(i, j) for i, n in enumerate(count[:50]) for j in range(n)])
    toxic = np.array(count[:50]) > 0
    middle = np.median([n for n in count[:50] if n])
    assert graded(places[:, 0], places[:, 1], toxic, 8).tolist() == [0 if not n else 1 + (n > middle) for n in count[:50]]


def test_scores_equal_brute_force_and_filter_keeps_columns(spark):
    """Every text's severity, from its words and heads one by one."""
    docs, labels = made(300, 4)
    d, g = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = train_toxicity(d, g)
    weight = dict(zip(model.hashes.tolist(), model.weights, strict=True))
    rows = [*docs[:60], (7, None), (None, "Vile, FOUL! rotten"), (7, "")]

    def one(word):
        data = np.frombuffer(word, dtype=np.uint8)
        return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])

    def want(text):
        seen = set()
        for w in re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode()):
            seen.add(one(w))
            seen |= {one(w[:n]) ^ (k + 1) for k, n in enumerate(HEADS) if len(w) > n}
        z = sum(weight.get(h, 0.0) for h in seen)
        return [1 / (1 + np.exp(t - z)) for t in model.thresholds]

    df = spark.createDataFrame([(*x, "x") for x in rows], "doc_id long, text string, toxic string")
    got = sorted((str(x.doc_id), x.p_toxic, x.severity) for x in score_toxicity(df, model).collect())
    for (i, p, s), (j, q) in zip(got, sorted((str(i), want(t)) for i, t in rows), strict=True):
        assert i == j and abs(p - q[0]) < 1e-9 and abs(s - sum(q)) < 1e-9
    kept = without_toxic(df, model)
    assert kept.columns == df.columns
    assert sorted(str(tuple(x)) for x in kept.collect()) == sorted(str((i, t, "x")) for i, t in rows if want(t)[0] < 0.5)
    assert without_toxic(df.where("false"), model).count() == 0


def test_likelihood_gradient_reaches_known_thresholds():
    r = np.random.default_rng(0)
    x = r.integers(0, 2, 4000)
    u = 2 * x - 1 + r.logistic(size=4000)
    y = (u > 0).astype(int) + (u > 1.5)
    rows = np.flatnonzero(x)
    w, t = fit_ordinal(rows, np.zeros(len(rows), int), y, 1, ridge=1e-6)
    assert abs(w[0] - 2) < 0.25 and abs(t[0] - 1) < 0.2 and abs(t[1] - 2.5) < 0.25


def test_nulls_empty_repeats_long(spark):
    docs, labels = made(200, 2)
    d, g = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = train_toxicity(d, g)
    odd = spark.createDataFrame([(None, "vile foul", 1), (1, None, 2), (2, "", 3), (2, "", 4), (3, "wab " * 300000 + "vile rotten foul vile", 5)], "doc_id long, text string, toxic int")
    got = score_toxicity(odd, model).collect()
    assert len(got) == 5
    assert {r.toxic for r in got if r.doc_id in (1, 2)} == {False}
    assert [r.toxic for r in got if r.doc_id == 3] == [True]
    assert score_toxicity(odd.where("false"), model).count() == 0
    none = train_toxicity(d, g.where("false"), F.col("toxic"))
    assert {(r.toxic, r.severity) for r in score_toxicity(odd, none).collect()} == {(False, 0.0)}
