"""Near-duplicate components: MinHash banding, verification, and alternating stars.

Contract. A text's words are the runs of anything but space and \\x09-\\x0D, with A-Z in
lower case. Its set holds the distinct windows of five words, or its whole word sequence
if it has fewer; without words it is empty and linked with nothing. Two documents are
linked if 100 * intersection >= 75 * union of their full sets. Components are those of
all links.

How every link is found. Documents with one word sequence form a class, and classes, by
their smallest doc_id, are what is compared. Each class has 128 minima of a universal
hash family and falls into 32 buckets of 4 minima; a pair at similarity 0.75 misses all of
them once in 200,000. A bucket never emits all its pairs: first each member meets the
bucket's most central member (the one whose buckets are largest in sum). The links found give
components; only buckets that still span several are looked at again, block against block
inside tasks, between members of different components only. So links within a component
(which can't change the result) are the only ones left out. Of these buckets, one of more than
32 blocks is banded again: its members fall into 32 buckets of the minima i, i + 32, i + 64 and
i + 96, so two of them meet if eight minima agree (seven in four of the buckets); a pair at
similarity 0.75 misses all of them once in 370,000. Blocks first compare signatures. A block with no more near pairs than members returns these pairs, to be verified
as above; another returns its members that have a near partner, and the blocks of these
then compare full sets and return links that join components, at most one fewer than members.

Nulls: a null text has no words. A null doc_id joins nothing and gets a null
component_id and kept = true. Rows that repeat a doc_id are one node that has the links of
each row; every row is returned. Columns other than the two named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, cut, forget, if_few, lean, ship, stored
from .textcore import LOWER, find_words, mix64, random_words, sequence_hash, shingle_set, slices, span_hashes

WIDTH = 5
HASHES = 128
BANDS = 32
ROWS = HASHES // BANDS
#: Of the 128 minima the low bytes are kept to verify pairs. A link's expected agreement is
#: 96 or more with a standard deviation under 5; below this bound (4.5 deviations, once in
#: 300,000 links at the bar itself) a pair isn't read in full.
LEAST_AGREEING = 74
BLOCK = 512

_MULT = (random_words(21, HASHES) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = (random_words(22, HASHES) >> np.uint64(32)).astype(np.uint32)[:, None]
_FOLD = random_words(23, BANDS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the functions (a x + b) mod 2^32 with odd a over the folded shingle hashes."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)[None, :]
    low = np.full((HASHES, 1), 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, x.shape[1], 2048):
            np.minimum(low, (x[:, i : i + 2048] * _MULT + _ADD).min(axis=1, keepdims=True), out=low)
    return low[:, 0]


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, the band's number folded in."""
    with np.errstate(over="ignore"):
        parts = sig.reshape(BANDS, ROWS).astype(np.uint64)
        key = _FOLD.copy()
        for r in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, r])
    return key


def _documents(texts: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text of a batch."""
    for s in slices(texts):
        low = LOWER[s.buf]
        words = find_words(low, s.offs)
        hashes = span_hashes(low, words.starts, words.ends)
        for d in range(s.last - s.first):
            yield hashes[words.bounds[d] : words.bounds[d + 1]]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, a digest of the word sequence, low bytes of the minima, band keys."""
    for b in batches:
        count, digest, sigs, keys = [], [], [], []
        for words in _documents(b.column(1)):
            found = shingle_set(words, WIDTH)
            count.append(len(found))
            if len(found):
                with np.errstate(over="ignore"):
                    second = sequence_hash(mix64(words))
                digest.append(sequence_hash(words).to_bytes(8, "big") + second.to_bytes(8, "big"))
                minima = signature(found)
                sigs.append(minima.astype(np.uint8).tobytes())
                keys.append(band_keys(minima).tobytes())
            else:
                digest.append(None)
                sigs.append(None)
                keys.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, sigs, keys))], names=["doc_id", "n_shingles", "digest", "sig", "keys"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (key, doc_id) for each band."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.int64)
        ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)
        for i in range(0, keys.size, 65536):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 65536]), pa.array(ids[i : i + 65536])], names=["key", "doc_id"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and its whole sorted shingle set."""
    for b in batches:
        ids = b.column(0).to_pylist()
        some: list[tuple] = []
        size = 0
        for i, words in enumerate(_documents(b.column(1))):
            found = shingle_set(words, WIDTH).tobytes()
            some.append((ids[i], found))
            size += len(found)
            if size > 1 << 23 or i == len(ids) - 1:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.binary())], names=["doc_id", "shingles"])
                some, size = [], 0


def _rows(column) -> np.ndarray:
    """Signatures of a column, a row each."""
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, HASHES)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature verification: keep pairs whose minima agree often enough."""
    for b in batches:
        if b.num_rows:
            same = (_rows(b.column(2).to_pylist()) == _rows(b.column(3).to_pylist())).sum(axis=1)
            yield b.select([0, 1]).filter(pa.array(same >= LEAST_AGREEING))


def _similar(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether 100 * intersection >= 75 * union, of sorted sets."""
    if len(p) > len(q):
        p, q = q, p
    if 100 * len(p) < 75 * len(q):
        return False
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    both = int((q[at] == p).sum())
    return 100 * both >= 75 * (len(p) + len(q) - both)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full verification: keep pairs that are linked."""
    for b in batches:
        keep = [_similar(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in pair)) for pair in zip(b.column(2), b.column(3), strict=True)]
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _sets_of(docs: DataFrame, ids: DataFrame, s: Scratch) -> DataFrame:
    """doc_id and full set of the rows with these ids; texts move only if the ids are too many to broadcast."""
    return s.stored(docs.join(if_few(s.stored(ids, "ids")), "doc_id", "left_semi").mapInArrow(lean(_sets), "doc_id long, shingles binary"), "sets", "none")


def _end(df: DataFrame, name: str, value: list[str]) -> DataFrame:
    return df.select(F.col("doc_id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in value])


def _full(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that full verification keeps."""
    full = pairs.join(_end(sets, "b", ["shingles"]), "b").join(_end(sets, "a", ["shingles"]), "a")
    return full.select("a", "b", "shingles_a", "shingles_b").mapInArrow(lean(_linked), "a long, b long")


def _verify(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, s: Scratch) -> DataFrame:
    """The links (a, b) among candidate pairs; stored. Skewed joins are Spark's to split."""
    near = pairs.join(_end(sigs, "b", ["sig", "n_shingles"]), "b").join(_end(sigs, "a", ["sig", "n_shingles"]), "a")
    near = near.where(100 * F.least("n_shingles_a", "n_shingles_b") >= 75 * F.greatest("n_shingles_a", "n_shingles_b"))
    near = s.stored(near.select("a", "b", "sig_a", "sig_b").mapInArrow(lean(_agree), "a long, b long"), "near")
    sets = _sets_of(docs, near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), s)
    return s.stored(_full(near, sets).distinct(), "links")


def alternating_stars(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): rows (doc_id, component_id) for every linked node.

    Each round makes large stars (larger neighbours point to the least of a node and its
    neighbours), then small stars (the smaller ones and the node do), until nothing moves.
    A node's neighbours are never gathered: only minima are grouped, and joined back.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"edges still move after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("doc_id")).distinct().select("doc_id", F.col("doc_id").alias("component_id"))
    return stored(edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).unionByName(roots), "components")


class Cell(NamedTuple):
    """Rows of one block (side 0) or of two (sides 0 and 1), as arrays."""

    key: int
    side: np.ndarray
    ids: np.ndarray
    comps: np.ndarray
    sizes: np.ndarray
    sigs: np.ndarray
    sets: pa.Array | None

    def near(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each row of side 0 with the rows of the other side (or its own, once) that are near by signature."""
        one = not self.side.any()
        other = np.flatnonzero(self.side == (0 if one else 1))
        for nth, i in enumerate(np.flatnonzero(self.side == 0).tolist()):
            rest = other[nth + 1 :] if one else other
            n, m = self.sizes[i], self.sizes[rest]
            rest = rest[(self.comps[rest] != self.comps[i]) & (100 * np.minimum(n, m) >= 75 * np.maximum(n, m))]
            if len(rest):
                hit = rest[(self.sigs[rest] == self.sigs[i]).sum(axis=1) >= LEAST_AGREEING]
                if len(hit):
                    yield i, hit


def _near_members(cell: Cell) -> list[tuple]:
    """Pairs near by signature in different components, (None, a, b), if they are no more than the
    cell's members; else the members that take part, (key, doc_id, None)."""
    pairs, found, most = [], set(), len(cell.ids)
    for i, hit in cell.near():
        x = int(cell.ids[i])
        found.add(x)
        found.update(cell.ids[hit].tolist())
        if len(pairs) <= most:
            pairs += [(None, min(x, y), max(x, y)) for y in cell.ids[hit[: most + 1]].tolist()]
    return pairs if len(pairs) <= most else [(cell.key, i, None) for i in sorted(found)]


def _joining_links(cell: Cell) -> list[tuple[int, int]]:
    """Links that join components, by full sets: a forest."""
    root: dict[int, int] = {c: c for c in cell.comps.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in cell.sets]
    for i, hit in cell.near():
        for k in hit.tolist():
            u, v = find(int(cell.comps[i])), find(int(cell.comps[k]))
            if u != v and _similar(sets[i], sets[k]):
                root[max(u, v)] = min(u, v)
                x, y = int(cell.ids[i]), int(cell.ids[k])
                out.append((min(x, y), max(x, y)))
    return out


def _each_cell(work, names: tuple[str, ...]):
    """Run work on every cell of sorted batches; a cell may lie across batches."""

    def run(batches):
        held = None
        for b in _with_end(batches):
            if b is not None and not b.num_rows:
                continue
            if b is not None:
                held = b if held is None else pa.concat_batches([held, b])
            if held is None:
                continue
            key, i, j = (held.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            bounds = [0, *cuts.tolist(), *([held.num_rows] if b is None else [])]
            side, ids, comps, sizes = (held.column(c).to_numpy() for c in range(3, 7))
            sigs = _rows(held.column(7).to_pylist())
            found = []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                own = slice(lo, hi)
                found += work(Cell(int(key[lo]), side[own], ids[own], comps[own], sizes[own], sigs[own], held.column(8).slice(lo, hi - lo) if held.num_columns > 8 else None))
            held = held.slice(bounds[-1]) if b is not None else None
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(len(names))], names=list(names))

    return run


def _with_end(batches):
    yield from batches
    yield None


def _cells(members: DataFrame, extra: DataFrame, s: Scratch) -> DataFrame:
    """Members (key, doc_id, component_id) with extra columns, dealt and sorted by pairs of blocks of a bucket.

    A bucket of n members has ceil(n / BLOCK) blocks; each pair of blocks is a cell of its
    own, so no cell grows with its bucket.
    """
    size = s.stored(members.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")), "sizes")
    dealt = members.join(size, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.join(extra, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = [c for c in extra.columns if c != "doc_id"]
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "doc_id", "component_id", *columns)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id")


def _banded_again(spread: DataFrame, sigs: DataFrame, s: Scratch) -> DataFrame:
    """Members (key, doc_id, component_id) with those of wide buckets dealt into buckets of other minima.

    Blocks would copy a member of such a bucket more than BANDS times, and compare it with
    all others; this copies it BANDS times, and only buckets that span several components stay.
    """
    wide = s.stored(spread.groupBy("key").count().where(F.col("count") > BLOCK * BANDS).select("key"), "wide")
    if wide.isEmpty():
        return spread
    wide = if_few(wide)
    minima = [[F.substring("sig", i + r * BANDS + 1, 1) for r in range(ROWS)] for i in range(BANDS)]
    keys = F.array(*[F.xxhash64("key", F.lit(i), *four) for i, four in enumerate(minima)])
    again = spread.join(wide, "key", "left_semi").join(sigs.select("doc_id", "sig"), "doc_id").select(F.explode(keys).alias("key"), "doc_id", "component_id")
    again = s.stored(again, "again")
    several = again.groupBy("key").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo <> hi").select("key")
    return s.stored(spread.join(wide, "key", "left_anti").unionByName(again.join(several, "key", "left_semi")), "banded")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    every = stored(docs.mapInArrow(lean(_profile), "doc_id long, n_shingles long, digest binary, sig binary, keys binary"), "profiles", "none")
    able = every.where("doc_id is not null and digest is not null")
    s = Scratch()
    # exact copies: the smallest id of a class stands for it; a class of many rows is Spark's to split
    copied = s.stored(able.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "copied")
    same = stored(able.select("doc_id", "digest").join(copied, "digest", "left").select("doc_id", F.coalesce("least", "doc_id").alias("rep")).distinct(), "classes")
    reps = same.where("doc_id = rep").select("doc_id")

    bands = stored(able.select("doc_id", "keys").join(reps, "doc_id", "left_semi").select("doc_id", "keys").mapInArrow(lean(_bands), "key long, doc_id long"), "bands", "none")
    shared = s.stored(bands.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z").select("key"), "shared")
    members = s.stored(bands.join(shared, "key").distinct(), "members")
    forget(bands)
    sigs = s.stored(able.select("doc_id", "n_shingles", "sig").join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "sigs", "none")

    sizes = s.stored(members.groupBy("key").agg(F.count("*").alias("size")), "sizes")
    central = s.stored(members.join(sizes, "key").groupBy("doc_id").agg(F.sum("size").alias("weight")), "central")
    pivots = s.stored(members.join(central, "doc_id").groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("doc_id"))).alias("p")).select("key", F.col("p.doc_id").alias("x")), "pivots")
    pairs = members.join(pivots, "key").where("doc_id <> x").select(F.least("doc_id", "x").alias("a"), F.greatest("doc_id", "x").alias("b")).distinct()
    links = _verify(pairs, sigs, docs, s)
    comps = alternating_stars(links)

    known = s.stored(members.join(comps, "doc_id", "left").select("key", "doc_id", F.coalesce("component_id", "doc_id").alias("component_id")), "known")
    several = s.stored(known.groupBy("key").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo <> hi").select("key"), "several")
    spread = _banded_again(s.stored(known.join(several, "key"), "spread"), sigs, s)
    near = s.stored(_cells(spread, sigs, s).mapInArrow(lean(_each_cell(_near_members, ("key", "a", "b"))), "key long, a long, b long").distinct(), "near")
    if not near.isEmpty():
        crowded = near.where("key is not null").select("key", F.col("a").alias("doc_id"))
        sets = _sets_of(docs, near.select(F.explode(F.array("a", "b")).alias("doc_id")).where("doc_id is not null").distinct(), s)
        rest = s.stored(spread.join(crowded, ["key", "doc_id"]), "rest")
        more = _cells(rest, sigs.join(sets, "doc_id"), s).mapInArrow(lean(_each_cell(_joining_links, ("a", "b"))), "a long, b long")
        links = s.stored(links.unionByName(s.stored(_full(near.where("key is null").select("a", "b"), sets), "full")).unionByName(more).distinct(), "links")
        comps = alternating_stars(links)

    # rows of different texts under one doc_id can tie classes together: then walk again
    if not same.groupBy("doc_id").count().where("count > 1").isEmpty():
        copies = same.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        found = alternating_stars(links.unionByName(copies))
    else:
        found = same.join(comps.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.coalesce("component_id", "rep").alias("component_id"))
    s.clear()
    out = every.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
