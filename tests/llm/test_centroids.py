import hashlib
import math
import random

import numpy as np
import pytest

from temporalis.llm import centroids, queries


def brute(rows, k=16, rounds=3):
    """[(vec_id, cluster, distance)], centroids: the rule, a vector at a time."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, q) for i, q in kept if i is not None)[:k]
    cs = [q for *_, q in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda q: min((far(q, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for j in set(own):
            some = [q for (_, q), o in zip(kept, own, strict=True) if o == j]
            cs[j] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    return [(i, *near(q)[::-1]) for i, q in kept], cs


def test_search_is_exact_breaks_ties_and_saves_work():
    r = np.random.default_rng(0)
    for scale, k in ((3, 5), (40, 16), (1, 16)):
        q, c = r.integers(-scale, scale + 1, (700, 64)), r.integers(-scale, scale + 1, (k, 64))
        c[k // 2] = c[0]  # a copy never wins
        q[:50] = c[r.integers(k, size=50)]
        full = ((q[:, None] - c[None]) ** 2).sum(axis=2)
        for block in (1, 8, 7, 64, 100):
            who, best, terms = centroids.nearest(q, c, r.permutation(64), block)
            assert (who == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all() and terms <= q.size * k
    order = np.argsort(-q.var(axis=0), kind="stable")
    near = c[r.integers(k, size=2000)] * 20 + r.integers(-3, 4, (2000, 64))
    assert centroids.nearest(near, c * 20, order)[2] < 0.4 * near.size * k


def test_query_equals_brute_force_on_odd_rows(spark, tmp_path):
    r = random.Random(4)
    vector = lambda: [r.uniform(-0.6, 0.6) for _ in range(64)]
    same = [0.25] * 64
    rows = [(i, vector()) for i in range(150)] + [(1000 + i, same) for i in range(80)] + [(7, vector()), (7, vector()), (-3, vector()), (None, vector()), (None, same)]
    rows += [(2000, None), (2001, []), (2002, vector()[:63]), (2003, vector() + [0.5]), (2004, [None, *same[1:]]), (2005, [math.nan, *same[1:]]), (2006, [math.inf, *same[1:]]), (2007, [1e6] * 64), (2008, [-0.0] * 64)]
    table = spark.createDataFrame([(*x, "a", 5) for x in rows], "vec_id long, embedding array<float>, cluster string, q int")
    table.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, cs = brute(stored)
    got = queries.op11_centroid_clusters(spark, str(tmp_path)).collect()
    assert sorted(((x.vec_id, x.cluster, x.distance) for x in got), key=str) == sorted(want, key=str)
    each = {c: sum(d for _, o, d in want if o == c) for c in range(16)}
    for x in got:
        assert (x.cluster_inertia, x.inertia) == (each[x.cluster], sum(each.values()))
        assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[x.cluster])).encode()).hexdigest()


def test_few_and_no_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    found, cs = centroids.clustered(frame([(1, [0.5] * 64), (2, [0.5] * 64), (3, [0.1] * 64)]))
    assert len(cs) == 3 and {(x.vec_id, x.distance) for x in found.collect()} == {(1, 0), (2, 0), (3, 0)}
    assert len({x.cluster for x in found.where("vec_id < 3").collect()}) == 1  # the other one of the equal centroids is empty and stays
    for rows in ([], [(1, None), (2, [1.0])], [(None, [0.5] * 64)]):
        found, cs = centroids.clustered(frame(rows))
        assert found.collect() == [] and centroids.with_inertia(found, cs).collect() == []
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.clustered(frame([(1, [1e9] * 64)]))


def test_other_widths(spark):
    rows = [(i, [float(i % 3), float(i % 3)]) for i in range(30)]
    found, cs = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, width=2, scale=1)
    assert found.count() == 30 and cs.shape == (3, 2)
