"""Vectorised text primitives that run inside tasks.

Spark hands texts over as Arrow batches; these functions look at the UTF-8 bytes of a
whole slice of documents at once, so the cost is a few numpy passes a byte and no Python
object a word. A slice holds about ``SLICE_BYTES`` (or one longer document).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
HASH_BLOCK = 1 << 22

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def random_words(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random unsigned 64-bit words."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTE = random_words(11, 256)
_BASE = int(random_words(12, 1)[0]) | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = random_words(13, 64) | _U(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        row = np.full(size, base, dtype=_U)
        row[0] = 1
        have = _powers[base] = np.multiply.accumulate(row)
    return have[:n]


def free_tables() -> None:
    """Drop the tables of powers; they come back when they are needed."""
    _powers.clear()


def byte_class(*parts: bytes | range) -> np.ndarray:
    """A table of 256 booleans that is true for the given bytes."""
    table = np.zeros(256, dtype=bool)
    for part in parts:
        table[list(part)] = True
    return table


#: Words are runs of anything but these: space and \x09-\x0D.
WHITE = byte_class(b" ", range(9, 14))
NOT_WHITE = ~WHITE
#: Letters as far as bytes tell: ASCII letters and every byte of a longer code point.
LETTERS = byte_class(range(65, 91), range(97, 123), range(128, 256))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Slice(NamedTuple):
    """Documents ``first`` up to ``last`` of a batch: their bytes and where each begins."""

    first: int
    last: int
    buf: np.ndarray
    offs: np.ndarray


def slices(texts: pa.Array | pa.ChunkedArray, target: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a batch of texts into slices of about target bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + target, side="right")) - 1)
        yield Slice(i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


class Words(NamedTuple):
    """Byte ranges of words; those of document d are ``bounds[d]`` up to ``bounds[d + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def find_words(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray = NOT_WHITE) -> Words:
    """Maximal runs of the bytes of a class; a run ends where its document ends."""
    n = len(buf)
    flags = kind[buf]
    first = flags.copy()
    last = flags.copy()
    if n:
        first[1:] &= ~flags[:-1]
        last[:-1] &= ~flags[1:]
        cuts = offs[(offs > 0) & (offs < n)]
        first[cuts] = flags[cuts]
        last[cuts - 1] = flags[cuts - 1]
    starts = np.flatnonzero(first)
    return Words(starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending byte ranges, from one running polynomial sum a block.

    Blocks keep memory flat for texts of any length.
    """
    out = np.empty(len(starts), dtype=_U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BLOCK, side="right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            size = hi - lo
            if size > 4 * HASH_BLOCK:  # one gigantic word: fold its blocks
                h = _U(0)
                for k in range(lo, hi, HASH_BLOCK):
                    part = _BYTE[buf[k : min(hi, k + HASH_BLOCK)]]
                    h = h * _U(_BASE) + np.sum(part * _power(_BASE, len(part)), dtype=_U)
                out[i] = h
                i = j
                continue
            sums = np.zeros(size + 1, dtype=_U)
            np.cumsum(_BYTE[buf[lo:hi]] * _power(_BASE, size), out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * _power(_BASE_INV, size + 1)[s]
            i = j
        return mix64(out ^ ((ends - starts).astype(_U) * _STEP[63]))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of so many consecutive word hashes (documents not minded)."""
    if len(words) < width:
        return np.zeros(0, dtype=_U)
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=_U)
        for k in range(width):
            total += words[k : k + n] * _STEP[k]
        return mix64(total)


def sequence_hash(words: np.ndarray) -> int:
    """Hash of a whole sequence of word hashes."""
    if not len(words):
        return 0
    with np.errstate(over="ignore"):
        powers = _power(_BASE, len(words))
        return int(mix64(np.array([np.sum(words * powers, dtype=_U) ^ (_U(len(words)) * _STEP[62])], dtype=_U))[0])


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the windows of a document; all its words if they are fewer."""
    if not len(words):
        return np.zeros(0, dtype=_U)
    if len(words) < width:
        return np.array([sequence_hash(words)], dtype=_U)
    return np.unique(window_hashes(words, width))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; 0 where that is empty."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
