import random

import pytest

from temporalis.llm.neardup import alternating_stars, near_duplicates

WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for w in WHITE:
            low = low.replace(w, " ")
        words = [w for w in low.split(" ") if w]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()})
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in range(len(rows)):
        for q in range(p):
            a, b = sets[p], sets[q]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(rows[p][0]), find(rows[q][0])
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def made(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, at = [], 0
    for _ in range(30):
        base = [r.choice(vocab) for _ in range(r.randint(1, 160))]
        for _ in range(r.randint(1, 8)):
            words = list(base)
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = r.choice(vocab)
            rows.append((at, r.choice([" ", "\n", "\t "]).join(words).upper() if r.random() < 0.2 else " ".join(words)))
            at += 1
    return rows + [(at, None), (at + 1, ""), (at + 2, " \n"), (at + 3, "one"), (at + 4, "ONE"), (at + 5, " one")]


def test_equals_brute_force(spark):
    rows = made()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df).collect()))
    assert got == brute(rows)


def test_nulls_repeats_empty_and_extra_columns(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(None, text, 1), (5, text, 2), (5, text, 3), (7, text, 4), (9, "x", 5), (9, text, 6)], "doc_id long, text string, kept int")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 6, None, True), (5, 6, 5, True), (5, 6, 5, True), (7, 6, 5, False), (9, 1, 5, False), (9, 6, 5, False)], key=str)
    assert near_duplicates(df.where("false")).collect() == []


def test_long_text(spark):
    long = " ".join(f"v{i % 5000}" for i in range(400_000))
    got = near_duplicates(spark.createDataFrame([(1, long), (2, long + " tail"), (3, "x" * 3_000_000)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101)]
    got = {r.doc_id: r.component_id for r in alternating_stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("seed", [5])
def test_blocks(spark, monkeypatch, seed):
    from temporalis.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 2)
    rows = made(seed)
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)


def crowd(seed, members=120):
    """Texts that share two thirds of their words, so buckets hold many unlike ones, and a few linked ones among them."""
    r = random.Random(seed)
    common = [f"c{i}" for i in range(80)]
    rows = []
    for i in range(members):
        own = [f"o{r.random()}" for _ in range(30)]
        rows.append((i, " ".join(common + own)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join(common + own[:-3] + ["else"] * 3)))
    return rows


def test_crowded_buckets_are_banded_again(spark, monkeypatch):
    from temporalis.llm import neardup

    tables = []
    again = neardup._banded_again

    def watched(spread, sigs, s):
        out = again(spread, sigs, s)
        tables.append((spread.groupBy("key").count().agg({"count": "max"}).first()[0], out is not spread))
        return out

    monkeypatch.setattr(neardup, "BLOCK", 1)
    monkeypatch.setattr(neardup, "_banded_again", watched)
    rows = crowd(11)
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)
    assert tables[0][0] > neardup.BANDS and tables[0][1]


def test_banding_again_leaves_few_pairs(spark):
    """A bucket of 20,000 members with signatures of their own, of which 100 pairs are alike in 96 minima."""
    import numpy as np

    from temporalis.llm import neardup
    from temporalis.llm.shared import Scratch

    g = np.random.default_rng(4)
    sigs = g.integers(0, 256, (20_000, neardup.HASHES), dtype=np.uint8)
    for i in range(100):
        same = g.permutation(neardup.HASHES)[:96]
        sigs[2 * i + 1, same] = sigs[2 * i, same]
    frame = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sigs)], "doc_id long, sig binary")
    s = Scratch()
    spread = spark.range(20_000).selectExpr("7L as key", "id as doc_id", "id as component_id")
    out = neardup._banded_again(spread, frame, s)
    pairs = out.alias("x").join(out.alias("y"), "key").where("x.doc_id < y.doc_id").selectExpr("x.doc_id as a", "y.doc_id as b").distinct()
    found = {tuple(r) for r in pairs.collect()}
    s.clear()
    assert {(2 * i, 2 * i + 1) for i in range(100)} <= found
    assert len(found) < 1_000


def test_unfinished_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    with pytest.raises(RuntimeError, match="rounds"):
        alternating_stars(chain, max_rounds=1)
    assert {r.component_id for r in alternating_stars(chain).collect()} == {0}
