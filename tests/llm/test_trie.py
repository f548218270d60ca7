import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from temporalis.llm import queries, trie
from temporalis.llm.shared import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, label string, depth int"


def brute(rows):
    """Every node of the contract, straight from the rule."""
    own: dict = {}
    tied = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, tied(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members: dict = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        full = tuple(turns.get(c - c % 100, [])[:h] + ts[h:])
        for d in range(len(full) + 1):
            members.setdefault(full[:d], []).append((c, d == len(full)))
    children: dict = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    n = {k: len(v) for k, v in members.items()}
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        kids = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in kids) if kids else 1
        saved[k] = (n[k] - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in kids)
    least = {k: min(v)[0] for k, v in members.items()}
    said = lambda k: ",".join(str(c) for c, e in sorted(members[k]) if e)
    return sorted(((least[k], len(k), least[k[:-1]] if k else None, n[k], len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(said(k).encode()).hexdigest()) for k in members), key=str)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/conversations.parquet")
    return sorted((tuple(r[c] for c in NAMES) for r in queries.op12_prefix_trie(spark, str(path)).collect()), key=str)


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(6)
    rows = []
    texts = [None, "", "a", "b", "é漢", "long text " * 30, "\U0001f602"]
    for c in [*range(0, 330), *range(100_000, 100_140), 5_000, 7_123, 7_124]:
        hot = c % 3 == 0  # a third begins alike, and a ninth is one conversation
        turns = [("user", "hello")] * (2 if hot else 0) + ([] if c % 9 == 0 else [(r.choice(["user", "assistant", None, ""]), r.choice(texts)) for _ in range(r.randint(0 if hot else 1, 7))])
        rows += [(c, None if k == 0 and r.random() < 0.3 else k, role, text, "x", 9) for k, (role, text) in enumerate(turns)]
    rows += [(None, 1, "user", "nobody", "x", 9), (7_125, 0, "user", "q" * 9, "x", 9), (7_125, 0, "user", "q" * 9, "x", 9), (7_125, 0, "user", "z", "x", 9), (7_126, None, "a", "b", "x", 9), (7_126, None, "ab", "", "x", 9)]
    rows += [(250, k, "user", str(k % 7), "x", 9) for k in range(3_000)]  # a long one
    r.shuffle(rows)
    assert got(spark, rows, tmp_path) == brute(rows)


def test_single_turnless_and_empty(spark, tmp_path):
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0)
    for i, rows in enumerate([[], [(None, 1, "a", "b", "x", 1)], [(turnless, 0, "a", "b", "x", 1)], [(0, 0, "a", "b", "x", 1), (0, 1, "a", "b", "x", 1)]]):
        assert got(spark, rows, tmp_path / str(i)) == brute(rows)
    assert brute([(turnless, 0, "a", "b", "x", 1)])[0][1:5] == (0, None, 1, 0)  # its turn was replaced by none


def test_bits_tell_parents_and_degrees():
    r = np.random.default_rng(3)
    paths = sorted({tuple(r.integers(0, 3, r.integers(0, 6))) for _ in range(300)})
    flat = np.array([[x, 7] for p in paths for x in p], dtype=np.uint64).reshape(-1, 2)
    offs = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    t, end = trie.build(flat, offs, np.arange(len(flat)))
    nodes = sorted({p[:d] for p in paths for d in range(len(p) + 1)}, key=lambda p: (len(p), p))
    at = {p: i for i, p in enumerate(nodes)}
    assert t.n == len(nodes) and len(t.bits) == -(-(2 * t.n - 1) // 8)
    assert t.parents().tolist() == [at[p[:-1]] if p else -1 for p in nodes]
    assert t.degrees().tolist() == [sum(len(q) == len(p) + 1 and q[:-1] == p for q in nodes) for p in nodes]
    assert [nodes[i] for i in end] == paths and t.labels[1:, 0].tolist() == [p[-1] for p in nodes[1:]]


def test_digest_of_a_path_with_many_members(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.lit(bytes(16))).otherwise(F.unhex(F.substring(F.md5((F.col("id") % 50).cast("string")), 1, 32))).alias("key"), (F.col("id") * 7 - 900).alias("conv_id"))
    want: dict = {}
    for x in rows.orderBy("conv_id").collect():
        want.setdefault(bytes(x.key), []).append(str(x.conv_id))
    found = trie.end_digests(rows, Scratch(), 8).collect()
    assert len(found) == len(want) and all(x.ends == hashlib.sha256(",".join(want[bytes(x.key)]).encode()).hexdigest() for x in found)
