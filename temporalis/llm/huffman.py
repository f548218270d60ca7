"""Token ids in a compact binary form: canonical length-limited Huffman codes.

Format, a folder of two tables. ``code``: (id, bits), the code's length for each id that
occurs; codes are canonical (ascending by length, then id) and at most ``LIMIT`` bits long,
from global counts, optimal under the limit (package-merge). ``blocks``: independent runs of
whole documents in ascending doc_id order, closed once they hold ``BLOCK`` ids: shard, block,
first (ids before it in its shard), doc_ids, counts (ids of each document), checkpoints (bit
offset of every ``STRIDE``-th id) and payload (bits from the highest of each byte). Shards
ascend in doc_id, so the order is shard, block, place.

A reader decodes any block by itself: every checkpoint is a lane, and all lanes of a batch
take one id a step from a table of 2^LIMIT entries.

Nulls: a null text counts as empty (only the end id). A null doc_id comes first. Rows that
repeat a doc_id lie side by side, in an order that is fixed once written. Other columns are
ignored; an empty table gives no blocks and an empty code.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, range_partitions, ship, stored
from .tokens import token_slices

LIMIT = 18
BLOCK = 1 << 15
STRIDE = 128
_BLOCKS = "shard int, block int, first long, doc_ids array<long>, counts array<int>, checkpoints array<int>, payload binary"


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", literal: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 16-bit, little-endian) of every document; stored."""
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, ids, bounds in token_slices(b.column(1), path, literal=literal):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(np.diff(bounds)), packed_ids(ids, bounds)], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(lean(encode), "doc_id long, n_tokens long, ids binary"), "ids", "zstd")


def packed_ids(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    if ids.size and int(ids.max()) > 0xFFFF:
        raise ValueError("ids above 65535 do not fit this format")
    flat = np.ascontiguousarray(ids.astype("<u2"))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64) * 2), pa.py_buffer(flat)]).cast(pa.binary())


def unpacked(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, bounds) of a column of packed ids."""
    col = ids.cast(pa.large_binary())
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64, count=n + 1 + col.offset)[col.offset :]
    data = col.buffers()[2]
    flat = np.frombuffer(data, dtype="<u2", count=offs[-1] // 2) if data is not None and data.size else np.zeros(0, "<u2")
    return flat[offs[0] // 2 : offs[-1] // 2], (offs - offs[0]) // 2


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits, by package-merge; 0 for what never occurs."""
    lengths = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    merged, kinds = weights, [np.ones(len(order), dtype=bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        kinds.append(at < len(weights))
    take = 2 * len(order) - 2
    for own in reversed(kinds):
        singles = int(own[:take].sum())
        lengths[order[:singles]] += 1
        take = 2 * (take - singles)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, as a number of so many bits."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    top = int(lengths.max()) if len(used) else 0
    sizes = (np.uint64(1) << (top - lengths[used]).astype(np.uint64)).astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    codes[used] = at >> (top - lengths[used]).astype(np.uint64)
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for each value of the next limit bits."""
    codes = canonical_codes(lengths)
    symbol, size = np.zeros(1 << limit, dtype=np.uint16), np.ones(1 << limit, dtype=np.uint8)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    spans = 1 << (limit - lengths[used])
    total = int(spans.sum())
    symbol[:total] = np.repeat(used, spans)
    size[:total] = np.repeat(lengths[used], spans)
    if len(used):
        assert int(codes[used[-1]] + np.uint64(1)) << (limit - int(lengths[used[-1]])) == total
    return symbol, size


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(payload, checkpoints) of one block."""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = ends - size
    word = at >> 5
    value = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    joined = np.bitwise_or.reduceat(value, first)
    out = np.zeros(int(ends[-1] >> 5) + 2, dtype=np.uint32)
    where = word[first]
    out[where] |= (joined >> np.uint64(32)).astype(np.uint32)
    out[where + 1] |= joined.astype(np.uint32)
    return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], at[::STRIDE].astype(np.int32)


def decode_blocks(payloads: list, counts: list[int], checkpoints: list[np.ndarray], table) -> np.ndarray:
    """The ids of several blocks, end to end; all lanes advance together."""
    symbol, size = table
    bases, parts, at = [], [], 0
    for p in payloads:
        raw = bytes(p)
        raw += b"\0" * (8 + -len(raw) % 4)
        bases.append(at * 32)
        at += len(raw) // 4
        parts.append(raw)
    words = np.frombuffer(b"".join(parts), dtype=">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    bits = np.concatenate([c.astype(np.int64) + b for c, b in zip(checkpoints, bases, strict=True)])
    lanes = np.concatenate([np.minimum(STRIDE, n - np.arange(0, n, STRIDE)) for n in counts])
    starts = np.cumsum(lanes) - lanes
    out = np.zeros(int(lanes.sum()), dtype=np.uint16)
    order = np.argsort(-lanes, kind="stable")
    bits, starts = bits[order], starts[order]
    live = np.searchsorted(-lanes[order], -np.arange(STRIDE), side="left")
    mask = np.uint64((1 << LIMIT) - 1)
    for t in range(STRIDE):
        k = int(live[t])
        if not k:
            break
        b = bits[:k]
        key = ((pairs[b >> 5] >> (64 - LIMIT - (b & 31)).astype(np.uint64)) & mask).astype(np.int64)
        out[starts[:k] + t] = symbol[key]
        b += size[key]
    return out


def write_ids(ids: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write a stored table (doc_id, n_tokens, ids) in the format above."""
    spark = ids.sparkSession
    ship(spark)

    def count(batches):
        seen = np.zeros(1 << 16, dtype=np.int64)
        for b in batches:
            flat, _ = unpacked(b.column(0))
            seen += np.bincount(flat, minlength=1 << 16)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["id", "n"])

    # at most 2^16 rows, whatever the documents
    found = ids.select("ids").mapInArrow(lean(count), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, dtype=np.int64)
    for r in found:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    codes = canonical_codes(lengths)

    def encode(batches):
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        docs, sizes, parts, held = [], [], [], 0
        rows: list[tuple] = []

        def close():
            nonlocal block, first, held
            payload, marks = encode_bits(np.concatenate(parts).astype(np.int64), codes, lengths)
            rows.append((block, first, list(docs), list(sizes), marks, payload))
            block, first, held = block + 1, first + held, 0
            docs.clear(), sizes.clear(), parts.clear()

        def take():
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int32())), pa.array([r[4] for r in rows], pa.list_(pa.int32())), pa.array([r[5] for r in rows], pa.binary())],
                names=["shard", "block", "first", "doc_ids", "counts", "checkpoints", "payload"],
            )
            rows.clear()
            return out

        for b in batches:
            flat, bounds = unpacked(b.column(1))
            names = b.column(0).to_pylist()
            at = 0
            while at < len(names):
                upto = min(len(names), max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK - held, side="left"))))
                docs += names[at:upto]
                sizes += np.diff(bounds[at : upto + 1]).tolist()
                parts.append(flat[bounds[at] : bounds[upto]])
                held += int(bounds[upto] - bounds[at])
                at = upto
                if held >= BLOCK:
                    close()
                    if len(rows) >= 64:
                        yield take()
            parts[:] = [p.copy() for p in parts]
        if docs:
            close()
        if rows:
            yield take()

    order = [F.col("doc_id").asc_nulls_first()]
    dealt = ids.repartitionByRange(partitions or range_partitions(spark, 2 * int(counts.sum())), *order).sortWithinPartitions(*order, "n_tokens")
    dealt.select("doc_id", "ids").mapInArrow(lean(encode), _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, and if asked ids (packed), of every document of the files."""
    ship(spark)
    lengths = np.zeros(1 << 16, dtype=np.int64)
    for r in spark.read.schema("id int, bits int").parquet(f"{path}/code").collect():
        lengths[r.id] = r.bits
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")

    def decode(batches):
        table = decoding_table(lengths)
        for b in batches:
            for at in range(0, b.num_rows, 32):
                some = b.slice(at, 32)
                counts = [np.array(c, dtype=np.int64) for c in some.column(4).to_pylist()]
                flat = decode_blocks([x.as_buffer() for x in some.column(6)], [int(c.sum()) for c in counts], [np.array(c) for c in some.column(5).to_pylist()], table)
                sizes = np.concatenate(counts)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                wide = flat.astype("<u4")
                crc = [zlib.crc32(wide[bounds[i] : bounds[i + 1]]) for i in range(len(sizes))]
                n = np.array([len(c) for c in counts])
                base = np.repeat(some.column(2).to_numpy() - bounds[np.cumsum(n) - n], n)
                yield pa.RecordBatch.from_arrays([some.column(3).flatten(), pa.array(np.repeat(some.column(0).to_numpy(), n)), pa.array(bounds[:-1] + base), pa.array(sizes), pa.array(crc, pa.int64()), *[packed_ids(flat, bounds)] * with_ids], names=["doc_id", "shard", "local", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    # one row a shard, that is a write task
    base, rows = 0, []
    for r in sorted(blocks.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).collect()):
        rows.append((r.shard, base))
        base += r.n
    bases = spark.createDataFrame(rows, "shard int, base long")
    docs = blocks.mapInArrow(lean(decode), "doc_id long, shard int, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return docs.join(F.broadcast(bases), "shard").select("doc_id", (F.col("local") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
