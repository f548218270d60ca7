"""Texts as sequences of chunks, each distinct chunk encoded once a slice.

A chunk is a run of white space and the run of other bytes that follows it. Encoders whose
result for a text is the chain of the results for its chunks need to see each distinct
chunk only once; a bounded cache carries the codes on to the next slices of the same
Python worker. Chunks are compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textcore import span_hashes

#: Entries that a worker's cache may hold; beyond it only those of the last slice stay.
CACHE = 1_000_000
SLICE = 2 << 20
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, *range(9, 14)]] = True
SPACE = np.zeros(256, dtype=bool)
SPACE[32] = True


def _after_wide_space(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the code point that ends before each place is white space beyond ASCII."""
    p1, p2, p3 = (np.where(at >= k, buf[np.maximum(at - k, 0)], 0) for k in (1, 2, 3))
    two = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
    e280 = (p3 == 0xE2) & (p2 == 0x80) & ((p1 <= 0x8A) & (p1 >= 0x80) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF))
    return two | e280 | (p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F) | (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80) | (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)


def cut_chunks(buf: np.ndarray, offs: np.ndarray, white: np.ndarray = WHITE, more: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """(chunks, bounds): those of document d are ``bounds[d]`` up to ``bounds[d + 1]``; more: places to cut as well.

    A cut is left out where wide white space comes right before, so that a run of white
    space always lies in one chunk.
    """
    n = len(buf)
    blank = white[buf]
    at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1 if n else np.zeros(0, dtype=np.int64)
    if n and (buf[np.maximum(at - 1, 0)] >= 128).any():
        at = at[~_after_wide_space(buf, at)]
    first = np.zeros(n + 1, dtype=bool)
    first[at] = True
    first[offs] = True
    if more is not None:
        first[more] = True
    cuts = np.flatnonzero(first).astype(np.int64)
    chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(buf))])
    return chunks, np.searchsorted(cuts, offs)


def chunk_bytes(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offs) of an array of chunks."""
    n = len(chunks)
    offs = np.frombuffer(chunks.buffers()[1], dtype=np.int64, count=n + 1 + chunks.offset)[chunks.offset :]
    data = chunks.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def ragged_take(flat: np.ndarray, offs: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows flat[offs[i]:offs[i + 1]] for each i of index, end to end, and their lengths."""
    size = (offs[1:] - offs[:-1])[index]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    move = offs[:-1][index] - (ends - size)
    return flat[np.arange(total) + np.repeat(move, size)], size


class ChunkCodes:
    """Codes of chunks: ``encode`` takes distinct chunks and returns (flat codes, lengths).

    Known chunks are found by a 64-bit hash and then compared byte for byte; of two with one
    hash only the first is known, the other is encoded again in every slice.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], dtype=np.uint16, limit: int | None = None):
        self.encode, self.limit = encode, limit
        self.known = pa.array([], pa.large_binary())
        self.flat, self.offs = np.zeros(0, dtype=dtype), np.zeros(1, dtype=np.int64)
        self._index(np.zeros(0, dtype=np.uint64))

    def _index(self, hashes: np.ndarray) -> None:
        self.places = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.places]

    def _find(self, distinct: pa.Array, hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The place of each distinct chunk among the known ones, or -1; order sorts the hashes."""
        rows = np.full(len(distinct), -1, dtype=np.int64)
        if len(self.hashes):
            at = np.empty(len(hashes), dtype=np.int64)
            at[order] = np.searchsorted(self.hashes, hashes[order])  # sorted, it stays in the processor's caches
            at[at == len(self.hashes)] = 0
            like = np.flatnonzero(self.hashes[at] == hashes)
            place = self.places[at[like]].astype(np.int64)
            same = pc.equal(distinct.take(pa.array(like)), self.known.take(pa.array(place))).to_numpy(zero_copy_only=False).astype(bool)
            rows[like[same]] = place[same]
        return rows

    def of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, offs, row): chunk i has the codes flat[offs[row[i]]:offs[row[i] + 1]]."""
        coded = chunks.dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        data, offs = chunk_bytes(distinct)
        hashes = span_hashes(data, offs[:-1], offs[1:])
        sort = np.argsort(hashes, kind="stable")
        rows = self._find(distinct, hashes, sort)
        new = np.flatnonzero(rows < 0)
        if len(new):
            missing = distinct.take(pa.array(new))
            flat, size = self.encode(missing)
            if flat.size and int(flat.max()) > np.iinfo(self.flat.dtype).max:
                raise ValueError(f"codes do not fit {self.flat.dtype}")
            rows[new] = len(self.known) + np.arange(len(new))
            order = sort[rows[sort] >= len(self.known)]
            at = np.searchsorted(self.hashes, hashes[order], side="right")
            self.hashes = np.insert(self.hashes, at, hashes[order])
            self.places = np.insert(self.places, at, rows[order])
            self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])
            self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(size)])
            self.known = pa.concat_arrays([self.known, missing])
        result = self.flat, self.offs, rows[index]
        if len(self.known) > (CACHE if self.limit is None else self.limit):
            flat, size = ragged_take(self.flat, self.offs, rows)
            self.known, self.flat, self.offs = distinct, flat, np.concatenate([[0], np.cumsum(size)])
            self._index(hashes)
        return result
