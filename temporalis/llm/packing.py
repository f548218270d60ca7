"""Packing along a space-filling curve.

Every document's token counts, hashed to ``DIMS`` random signs a token, are projected to
few dimensions, scaled by the root of the token count and squashed to ``BITS`` bits each. Documents are
range-sorted by the Hilbert key of that point (then by doc_id) and laid end to end along
the curve; the line is cut every ``WIDTH`` ids. So each sequence holds neighbours of the
curve and only the very last one can need padding.

Nulls: a null text counts as empty (only the end id); a null doc_id sorts first among
equal keys. Rows that repeat are packed as often as they occur. Other columns are ignored;
an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .huffman import packed_ids, unpacked
from .shared import lean, range_partitions, running_total, ship, stored
from .textcore import mix64, segment_sums
from .tokens import token_slices

WIDTH = 2048
DIMS = 4
BITS = 12
#: Scale of a coordinate before it is squashed to (0, 1).
SPREAD = 3.0


def token_signs(n: int = 1 << 16) -> np.ndarray:
    """+1 or -1 for each token and dimension, from a hash of the token."""
    with np.errstate(over="ignore"):
        h = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([1 - 2 * ((h >> np.uint64(7 * d + 3)) & np.uint64(1)).astype(np.int8) for d in range(DIMS)], axis=1)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates (Skilling's transform, 2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_keys(ids: np.ndarray, bounds: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The Hilbert key of each document."""
    n = np.maximum(np.diff(bounds), 1)
    sums = np.stack([segment_sums(signs[:, d][ids].astype(np.int64), bounds) for d in range(DIMS)], axis=1)
    place = 0.5 + 0.5 * np.tanh(sums / np.sqrt(n)[:, None] / SPREAD)
    return hilbert_keys(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def pack(docs: DataFrame, tokenizer: str, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, literal: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece, and its ids."""
    ship(docs.sparkSession)

    def encode(batches):
        signs = token_signs()
        for b in batches:
            for first, last, ids, bounds in token_slices(b.column(1), tokenizer, literal=literal):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(document_keys(ids, bounds, signs)), pa.array(np.diff(bounds)), packed_ids(ids, bounds)], names=["doc_id", "curve", "doc_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = stored(rows.mapInArrow(lean(encode), "doc_id long, curve long, doc_tokens long, ids binary"), "ids", "zstd")
    total = ids.agg(F.sum("doc_tokens")).first()[0] or 0
    placed = running_total(ids, ["curve", "doc_id"], "doc_tokens", range_partitions(docs.sparkSession, 2 * total), "zstd")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def cut(batches):
        for b in batches:
            flat, bounds = unpacked(b.column(1))
            n, at = np.diff(bounds), b.column(2).to_numpy()
            pieces = (at + n - 1) // width - at // width + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = at[doc] // width + nth
            begin = np.maximum(sequence * width, at[doc])
            size = np.minimum((sequence + 1) * width, at[doc] + n[doc]) - begin
            start = begin - at[doc]
            cuts = np.concatenate([[0], np.cumsum(size)])
            wide = flat.astype("<u4")
            crc = [zlib.crc32(wide[cuts[i] : cuts[i + 1]]) for i in range(len(size))]
            columns = [b.column(0).take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(sequence), pa.array(begin - sequence * width)]
            yield pa.RecordBatch.from_arrays([*columns, packed_ids(flat, cuts)] if with_ids else columns, names=names)

    schema = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names)
    return placed.select("doc_id", "ids", "start").mapInArrow(lean(cut), schema)
