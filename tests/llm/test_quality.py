import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from temporalis.llm.quality import FALLING, MONOTONE, STATS, fit_forest, quality_rules, train_quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    cover = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), n < 10 or 100 * len(cover) > 20 * n


def made(seed, n=150):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lines = [" ".join(r.choice(["alpha", "béta", "gam#ma", "d|", "ñu", "x", "日本"]) + r.choice(["", ".", "!!"]) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 6))]
        lines += r.choices(lines, k=r.randint(0, 2)) + r.choice([[], [" "], [""], ["\t\x0b"]])
        out.append((i, r.choice(["\n", "\r\n", "\n\n"]).join(lines)))
    return out


def test_base_equals_brute_force(spark):
    rows = made(4)
    got = {r.doc_id: tuple(r)[1:7] for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), None).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_monotone_and_accurate():
    r = np.random.default_rng(1)
    x = r.random((3000, len(STATS)))
    sym, odd = STATS.index("symbol_share"), STATS.index("mean_word")
    y = ((x[:, sym] < 0.5) & (np.abs(x[:, odd] - 0.5) < 0.4)).astype(float)
    y = np.where(r.random(3000) < 0.03, 1 - y, y)
    forest = fit_forest(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.93
    for name in FALLING:
        grid = np.repeat(x[:200], 21, axis=0)
        grid[:, STATS.index(name)] = np.tile(np.linspace(-0.1, 1.1, 21), 200)
        steps = np.diff(forest.score(grid).reshape(200, 21), axis=1)
        assert steps.max() <= 1e-12
    assert MONOTONE.any()


def test_forest_equals_a_walk_down_each_tree():
    r = np.random.default_rng(6)
    x = np.round(r.random((600, len(STATS))), 2)  # ties with thresholds
    forest = fit_forest(x, (x[:, 0] + x[:, 3] * x[:, 5] + 0.2 * r.normal(size=600) < 0.8).astype(float))
    got = forest.score(x)
    for row, p in zip(x.tolist(), got.tolist(), strict=True):
        z = forest.start
        for node in forest.roots.tolist():
            while forest.left[node] >= 0:
                node = (forest.left if row[forest.feature[node]] <= forest.threshold[node] else forest.right)[node]
            z += forest.value[node]
        assert p == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)
    assert got.min() < 0.5 < got.max()


def test_very_long_texts(spark):
    plain = " ".join(f"w{i}" for i in range(600_000))
    rows = [(1, plain), (2, plain + "\n" + plain), (3, "#" * 4_000_000), (4, "a b c d e\n" * 200_000)]
    got = {r.doc_id: tuple(r)[1:7] for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), None).collect()}
    chars = sum(len(f"w{i}") for i in range(600_000))
    assert got == {1: (600_000, chars, 0, 0, 0, False), 2: (1_200_000, 2 * chars, 0, 1, 1_200_000, True), 3: (1, 4_000_000, 4_000_000, 0, 0, True), 4: (1_000_000, 1_000_000, 0, 199_999, 1_000_000, True)}


@pytest.mark.parametrize("kinds", [2, 1, 0])
def test_training_nulls_empty(spark, kinds):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(30)) + ".") for i in range(80)]
    junk = [(100 + i, " ".join(f"w{(i + k * k) % 89}###" for k in range(30))) for i in range(80)]
    docs = spark.createDataFrame(good + junk + [(500, None), (501, ""), (None, good[0][1]), (3, good[3][1])], "doc_id long, text string").withColumn("kept", F.lit(1))
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + junk if kinds == 2 or (kinds and i < 100)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    forest = train_quality(docs, labels)
    assert (forest is None) == (kinds < 2)
    got = quality_rules(docs, forest).collect()
    assert len(got) == 164 and sum(r.doc_id == 3 for r in got) == 2
    assert {r.base_failed for r in got if r.doc_id in (500, 501)} == {True}
    if kinds == 2:
        assert all(r.kept == (r.doc_id is None or r.doc_id < 100) for r in got)
    assert quality_rules(docs.where("false"), forest).count() == 0
