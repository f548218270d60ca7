"""The trie of rebuilt conversations: who shares which first turns, and what sharing them saves.

A turn's label is 128 bits of the SHA-256 of its role and text, so that texts leave their
task as 16 bytes and a length. A conversation is its path of labels. Paths are counted
first (copies of a conversation, however many, are one row), then dealt to shards in
lexicographic order. Each shard is a succinct trie in level order: a LOUDS bit vector (a one
for each child of a node, then a zero) beside arrays of labels and sizes, from which numpy adds up
members, leaves and savings a level at a time, deepest first (``np.add.at``).

Neighbouring shards can only share the nodes above their first and last paths. These open
nodes leave a shard as partial sums; at most two paths a shard, they meet in one more trie,
so that a prefix under which most conversations begin costs no more than any other. The nodes
below an open one then look up its smallest member.

The digest of the conversations that end at a node takes their ids in order. They are
range-sorted, and all that lie within one partition are digested there. Ids of a path that
goes on in another are joined into pieces, which one task passes through SHA-256 in order, as
that digest asks; it holds one batch of pieces.

A conversation is one row of 20 bytes a turn. Null roles and texts are empty; turns that tie, as
repeated rows do, come in the order of their labels and all count. Rows without a conv_id are left out. Other columns
are ignored. An empty table has no members and so no node, not even the root.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, if_few, lean, range_partitions, ship

#: A rebuilt conversation takes up to SHARED - 1 turns from the first of each GROUP ids.
SHARED, GROUP = 6, 100
LABEL = 16
#: Bytes of a shard's arrays for each byte of its paths, at about.
ARRAYS = 4
#: Ids of a piece.
PIECE = 1 << 13
_NONE = hashlib.sha256(b"").hexdigest()
_NODE = "depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def label(role: Column, text: Column) -> Column:
    """32 hex digits that tell a turn's role and text."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * LABEL)


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): label and code points of each turn in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("there"), "turn", F.unhex(label(role, text)).alias("label"), F.length(text).alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t.label.alias("label"), t.size.alias("size"))).alias("turns"))


def rebuilt(turns: DataFrame, shared: int = SHARED, group: int = GROUP) -> DataFrame:
    """(conv_id, path, sizes): the first turns are those of the group's first conversation, as many as a hash tells."""
    h = (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    heads = turns.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, shared - 1).alias("first"))
    none = F.array().cast(turns.schema["turns"].dataType)
    both = F.concat(F.slice(F.coalesce("first", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    # a head has at most `group` conversations
    rows = turns.withColumn("head", F.col("conv_id") - F.col("conv_id") % group).join(heads, "head", "left").select("conv_id", both.alias("turns"))
    return rows.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.label)), "")).alias("path"), F.transform("turns", lambda t: t.size).alias("sizes"))


def _digest(path: Column) -> Column:
    return F.unhex(F.substring(F.sha2(path, 256), 1, 2 * LABEL))


def _runs(keys: pa.Array) -> list[int]:
    """Where runs of equal keys begin, and the end."""
    n = len(keys)
    if not n:
        return [0]
    same = np.frombuffer(keys.cast(pa.binary(LABEL)).buffers()[1], dtype=f"V{LABEL}", count=n + keys.offset)[keys.offset :]
    return [0, *(np.flatnonzero(same[1:] != same[:-1]) + 1).tolist(), n]


def _pieces(batches):
    """Digests of the paths whose ids all lie in this partition, and pieces of the others' ids."""
    part, key, held, piece, edge = TaskContext.get().partitionId(), None, [], 0, True
    out: list[tuple] = []

    def close(last: bool) -> None:
        said = ",".join(map(str, held))
        whole = not (edge or piece or last)
        out.append((key, part, piece, None if whole else said, hashlib.sha256(said.encode()).hexdigest() if whole else None))

    def rows():
        made = pa.RecordBatch.from_pylist([dict(zip(("key", "part", "piece", "ids", "digest"), r, strict=True)) for r in out], schema=pa.schema({"key": pa.binary(), "part": pa.int32(), "piece": pa.int32(), "ids": pa.string(), "digest": pa.string()}))
        out.clear()
        return made

    for b in batches:
        keys, ids = b.column(0), b.column(1).to_numpy(zero_copy_only=False).tolist()
        runs = _runs(keys)
        for lo, hi in zip(runs, runs[1:], strict=False):
            own = keys[lo].as_py()
            if own != key:
                if key is not None:
                    close(False)
                    edge = False
                key, held, piece = own, [], 0
            held += ids[lo:hi]
            while len(held) > PIECE:
                out.append((key, part, piece, ",".join(map(str, held[:PIECE])), None))
                held, piece = held[PIECE:], piece + 1
        yield rows()
    if key is not None:
        close(True)
        yield rows()


def _through(batches):
    """The digest of each key's pieces, which come in order."""
    key, state = None, None
    for b in batches:
        done = []
        for own, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if own != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(said.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends"])


def end_digests(members: DataFrame, scratch: Scratch, partitions: int) -> DataFrame:
    """(key, ends): SHA-256 of the ascending ids, comma-joined, of each key's members (key, conv_id)."""
    ordered = members.repartitionByRange(partitions, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = scratch.stored(ordered.mapInArrow(lean(_pieces), "key binary, part int, piece int, ids string, digest string"), "ends")
    left = found.where("digest is null").repartition("key").sortWithinPartitions("key", "part", "piece").select("key", "ids")
    return found.where("digest is not null").select("key", F.col("digest").alias("ends")).unionByName(left.mapInArrow(_through, "key binary, ends string"))


class Louds(NamedTuple):
    """A trie in level order: packed bits, its number of nodes, sizes of their last texts, and where levels begin."""

    bits: np.ndarray
    n: int
    labels: np.ndarray
    sizes: np.ndarray
    levels: list[int]

    def _flags(self) -> np.ndarray:
        return np.unpackbits(self.bits, count=2 * self.n - 1).astype(bool)

    def parents(self) -> np.ndarray:
        """Of node j > 0: how many zeros stand before the j-th one; the root's is -1."""
        ones = self._flags()
        return np.concatenate([[-1], np.cumsum(~ones)[ones]])

    def degrees(self) -> np.ndarray:
        """How many ones stand before each zero, from the one before."""
        return np.diff(np.flatnonzero(~self._flags()), prepend=-1) - 1


def louds(parents: np.ndarray, labels: np.ndarray, sizes: np.ndarray, levels: list[int]) -> Louds:
    """From the parents of nodes 1, 2, ... in level order."""
    n = len(parents) + 1
    ends = np.cumsum(np.bincount(parents, minlength=n)) + np.arange(n)
    flags = np.ones(2 * n - 1, dtype=bool)
    flags[ends] = False
    return Louds(np.packbits(flags), n, labels, sizes, levels)


def build(path: np.ndarray, offs: np.ndarray, sizes: np.ndarray) -> tuple[Louds, np.ndarray]:
    """The trie of sorted paths, and the node where each ends. Path i has the labels path[offs[i]:offs[i + 1]], two words each."""
    length = np.diff(offs)
    at, active = np.zeros(len(length), dtype=np.int64), np.arange(len(length))
    parents, labels, own, levels, depth = [], [np.zeros((1, 2), dtype=np.uint64)], [np.zeros(1, dtype=np.int64)], [0, 1], 0
    while True:
        active = active[length[active] > depth]
        if not len(active):
            break
        where = offs[active] + depth
        now, up = path[where], at[active]
        new = np.ones(len(active), dtype=bool)
        new[1:] = (up[1:] != up[:-1]) | (now[1:] != now[:-1]).any(axis=1)
        at[active] = levels[-1] - 1 + np.cumsum(new)
        parents.append(up[new]), labels.append(now[new]), own.append(sizes[where[new]])
        levels.append(levels[-1] + int(new.sum()))
        depth += 1
    return louds(np.concatenate([np.zeros(0, dtype=np.int64), *parents]), np.concatenate(labels), np.concatenate(own), levels), at


def rollup(trie: Louds, convs: np.ndarray, least: np.ndarray, more: tuple | None = None, apart: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(n_convs, smallest member, n_children, n_leaves, saved) of each node, in reverse level order.

    convs and least are of the members that end at it; more: children, leaves and savings that a
    node has besides those of this trie. Nodes apart give nothing to their parents, and
    have no leaf and no savings of their own yet.
    """
    up, levels = trie.parents(), trie.levels
    apart = np.zeros(trie.n, dtype=bool) if apart is None else apart
    gives = [np.arange(lo, hi)[~apart[lo:hi]] for lo, hi in zip(levels[1:], levels[2:], strict=False)][::-1]
    convs, least = convs.copy(), least.copy()
    children = np.zeros(trie.n, dtype=np.int64)
    for nodes in gives:
        np.add.at(convs, up[nodes], convs[nodes])
        np.minimum.at(least, up[nodes], least[nodes])
        np.add.at(children, up[nodes], 1)
    leaves, saved = np.zeros(trie.n, dtype=np.int64), np.zeros(trie.n, dtype=np.int64)
    if more is not None:
        children, leaves, saved = children + more[0], leaves + more[1], saved + more[2]
    leaves[(children == 0) & ~apart] += 1
    saved += np.where(apart, 0, (convs - 1) * trie.sizes)
    for nodes in gives:
        np.add.at(leaves, up[nodes], leaves[nodes])
        np.add.at(saved, up[nodes], saved[nodes])
    return convs, least, children, leaves, saved


def _prefix_keys(labels: bytes) -> list[bytes]:
    """A key for each prefix of a path, the empty one first."""
    state = hashlib.sha256()
    keys = [state.digest()]
    for i in range(0, len(labels), LABEL):
        state.update(labels[i : i + LABEL])
        keys.append(state.copy().digest())
    return keys


def _shard(batches):
    """Nodes of the paths (path, sizes, n, least, ends) of one partition: whole ones, and open ones with partial sums."""
    table = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    raw, sizes = table.column(0).cast(pa.large_binary()).combine_chunks(), table.column(1).combine_chunks()
    bounds = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    trie, end = build(data.view(np.uint64).reshape(-1, 2), (bounds - bounds[0]) // LABEL, sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    n, up = trie.n, trie.parents()
    keys: list[bytes | None] = [None] * n
    for row in (0, len(raw) - 1):
        node = int(end[row])
        for key in reversed(_prefix_keys(raw[row].as_py())):
            keys[node], node = key, int(up[node])
    opened = np.array([k is not None for k in keys])
    convs, least = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max)
    convs[end], least[end] = table.column(2).to_numpy(), table.column(3).to_numpy()  # paths differ, so do their ends
    ends = np.full(n, None, dtype=object)
    ends[end] = table.column(4).to_pylist()
    convs, least, children, leaves, saved = rollup(trie, convs, least, apart=opened)
    depth = np.repeat(np.arange(len(trie.levels) - 1), np.diff(trie.levels))
    above = np.concatenate([[False], opened[up[1:]]])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.binary()), pa.array([keys[p] if a else None for p, a in zip(up.tolist(), above.tolist(), strict=True)], pa.binary()), pa.array(least, mask=least == np.iinfo(np.int64).max), pa.array(least[up], mask=above | opened),
            pa.array(trie.sizes), *(pa.array(c.astype(np.int64)) for c in (depth, convs, children, leaves, saved)), pa.array(ends, pa.string()),
        ],
        names=["key", "above", "conv_id", "parent_conv_id", "size", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"],
    )


def _merged(batches):
    """The open nodes of all shards, a row a key, as one trie: level order, then the same rollup."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    t = {name: table.column(name).chunk(0) for name in table.column_names}
    depth = t["depth"].to_numpy(zero_copy_only=False)
    key, above = t["key"].to_pylist(), t["above"].to_pylist()
    # a level at a time: nodes stand in the order of their parents
    place: dict[bytes, int] = {}
    order: list[int] = []
    levels, begin = [0], np.argsort(depth, kind="stable")
    for d in range(int(depth.max()) + 1):
        lo, hi = np.searchsorted(depth[begin], [d, d + 1])
        level = sorted(begin[lo:hi].tolist(), key=lambda i: place[above[i]] if d else 0)
        for i in level:
            place[key[i]] = len(order)
            order.append(i)
        levels.append(len(order))
    own = {name: c.to_numpy(zero_copy_only=False)[order] for name, c in t.items() if name not in ("key", "above", "ends", "conv_id")}
    least = t["conv_id"].fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)[order]
    parents = np.array([place[above[i]] for i in order[1:]], dtype=np.int64)
    trie = louds(parents, np.zeros((len(order), 0), dtype=np.uint64), own["size"], levels)
    convs, least, children, leaves, saved = rollup(trie, own["n_convs"].astype(np.int64), least, (own["n_children"], own["n_leaves"], own["saved_tokens"]))
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[i] for i in order], pa.binary()), pa.array(least), pa.array(np.concatenate([[0], least[parents]]), mask=np.arange(len(order)) == 0), *(pa.array(c) for c in (own["depth"], convs, children, leaves, saved)), t["ends"].take(pa.array(order))],
        names=["key", "conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"],
    )


def prefix_trie(paths: DataFrame) -> DataFrame:
    """A row a node of the trie of paths (conv_id, path, sizes): members, children, leaves, savings, and digest of those that end there."""
    spark, scratch = paths.sparkSession, Scratch()
    ship(spark)
    kept = scratch.stored(paths.withColumn("key", _digest(F.col("path"))), "paths")
    distinct = scratch.stored(kept.groupBy("key", "path", "sizes").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")), "distinct")
    size = distinct.agg(F.sum(F.octet_length("path"))).first()[0] or 0
    partitions = range_partitions(spark, ARRAYS * size)
    told = scratch.stored(distinct.join(end_digests(kept.select("key", "conv_id"), scratch, partitions), "key").select("path", "sizes", "n", "least", "ends"), "told")
    nodes = told.repartitionByRange(partitions, "path").sortWithinPartitions("path").mapInArrow(lean(_shard), f"key binary, above binary, conv_id long, parent_conv_id long, size long, {_NODE}")
    nodes = Scratch().stored(nodes, "nodes")
    opened = nodes.where("key is not null").groupBy("key").agg(F.min("conv_id").alias("conv_id"), *[F.max(c).alias(c) for c in ("above", "size", "depth", "ends")], *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    # two paths a shard at most
    upper = Scratch().stored(opened.repartition(1).mapInArrow(_merged, f"key binary, conv_id long, parent_conv_id long, {_NODE}"), "upper")
    scratch.clear()
    whole = nodes.where("key is null").drop("key", "size")
    of_open = upper.select(F.col("key").alias("above"), F.col("conv_id").alias("parent"))
    below = whole.where("above is not null").join(if_few(of_open), "above").withColumn("parent_conv_id", F.col("parent")).drop("above", "parent")
    found = whole.where("above is null").drop("above").unionByName(below).unionByName(upper.drop("key"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256"))
