"""Quality rules: fixed base rules, and boosted trees over document statistics.

Words are runs of anything but space and \\x09-\\x0D. Base statistics: word_chars (code
points in words), n_symbols (characters of #*$%&|<>), n_dup_lines (lines, cut at \\n, that
hold a word and equal an earlier line), n_repeat_words (words in five-word windows that
the text holds twice or more, first ones included). base_failed: n_words < 10, or
100 * n_repeat_words > 20 * n_words.

The trees are fitted on at most ``SAMPLE`` labelled rows (quality 0 or 1) by second-order
boosting over binned statistics. The score never falls when a statistic of ``RISING`` rises
and never rises when one of ``FALLING`` does: splits whose leaves would break that are not
made, and bounds are handed down. A forest is flat arrays of nodes, walked by all rows of a
batch together. kept is false if base_failed, else whether the score is at least
``KEEP_AT``. Without labels of both kinds every document that passes the base is kept.

Nulls: a null text has no words (so base_failed). Every row is returned, repeated ones
too; a null doc_id stays null. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import labelled_sample
from .shared import lean, ship, stored
from .textcore import byte_class, find_words, segment_sums, slices, span_hashes, window_hashes

SAMPLE = 6000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 60, 3, 32, 0.15, 1.0, 20
KEEP_AT = 0.35
SYMBOLS = byte_class(b"#*$%&|<>")
WIDTH = 5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the trees see, in this order.
STATS = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "words_a_line", "stop_share", "bang_share"]
RISING = ("stop_share",)
FALLING = ("symbol_share", "dup_line_share", "repeat_share")
MONOTONE = np.array([(s in RISING) - (s in FALLING) for s in STATS])

_UPPER = byte_class(range(65, 91))
_DIGIT = byte_class(range(48, 58))
_STOP = byte_class(b".?")
_BANG = byte_class(b"!")
_LEAD = ~byte_class(range(128, 192))  # bytes that begin a code point
_NOT_BREAK = ~byte_class(b"\n")


def _repeat_words(hashes: np.ndarray) -> int:
    """Words covered by windows that occur twice or more."""
    windows = window_hashes(hashes, WIDTH)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WIDTH, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def statistics(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, statistics for the trees) of each document of a slice."""
    words = find_words(buf, offs)
    n = words.counts
    hashes = span_hashes(buf, words.starts, words.ends)
    lead = np.concatenate([[0], np.cumsum(_LEAD[buf])])
    lengths = lead[words.ends] - lead[words.starts]
    chars = segment_sums(lengths, words.bounds)

    def count(kind):
        return segment_sums(kind[buf].astype(np.int64), offs)

    symbols, upper, digits, stops, bangs = map(count, (SYMBOLS, _UPPER, _DIGIT, _STOP, _BANG))
    lines = find_words(buf, offs, _NOT_BREAK)
    first_word = np.searchsorted(words.starts, lines.starts)
    has_word = (first_word < len(words.starts)) & (np.append(words.starts, len(buf))[first_word] < lines.ends)
    line_hash = span_hashes(buf, lines.starts, lines.ends)
    base = np.zeros((len(n), 5), dtype=np.int64)
    n_lines = np.zeros(len(n), dtype=np.int64)
    for d in range(len(n)):
        own = slice(lines.bounds[d], lines.bounds[d + 1])
        with_word = line_hash[own][has_word[own]]
        n_lines[d] = len(with_word)
        base[d, 3] = len(with_word) - len(np.unique(with_word))
        base[d, 4] = _repeat_words(hashes[words.bounds[d] : words.bounds[d + 1]])
    base[:, 0], base[:, 1], base[:, 2] = n, chars, symbols
    some, letters = np.maximum(n, 1), np.maximum(chars, 1)
    stats = np.stack([np.log1p(n), chars / some, symbols / letters, base[:, 3] / np.maximum(n_lines, 1), base[:, 4] / some, upper / letters, digits / letters, n / np.maximum(n_lines, 1), stops / some, bangs / some], axis=1)
    return base, stats


class Forest(NamedTuple):
    """Nodes of all trees: statistic, threshold, left and right child (-1 in a leaf), value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality; all rows go down a tree together."""
        z = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                inner = self.left[at] >= 0
                go = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
            z += self.value[at]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_forest(x: np.ndarray, y: np.ndarray, monotone: np.ndarray = MONOTONE) -> Forest:
    """Boosted trees for the logistic loss, with monotonic constraints."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    z = np.full(len(y), start)
    nodes: list[list] = []
    roots = []

    def leaf(g, h, low, high):
        return float(np.clip(-g / (h + RIDGE), low, high))

    def grow(rows, depth, low, high, g, h):
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        nodes.append([0, 0.0, -1, -1, RATE * leaf(total_g, total_h, low, high)])
        if depth == DEPTH or len(rows) < 2 * LEAST_ROWS:
            z[rows] += nodes[me][4]
            return me
        best = (1e-6, None)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, j]
            gl = np.cumsum(np.bincount(b, weights=g[rows], minlength=len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, weights=h[rows], minlength=len(e) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
            gr, hr = total_g - gl, total_h - hl
            vl, vr = np.clip(-gl / (hl + RIDGE), low, high), np.clip(-gr / (hr + RIDGE), low, high)

            def gain(gg, hh, v):
                return -(gg * v + 0.5 * (hh + RIDGE) * v * v)

            v = leaf(total_g, total_h, low, high)
            won = gain(gl, hl, vl) + gain(gr, hr, vr) - gain(total_g, total_h, v)
            won[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS) | (monotone[j] * (vr - vl) < 0)] = -1
            k = int(np.argmax(won))
            if won[k] > best[0]:
                best = (won[k], (j, k, vl[k], vr[k]))
        if best[1] is None:
            z[rows] += nodes[me][4]
            return me
        j, k, vl, vr = best[1]
        go = binned[rows, j] <= k
        mid = (vl + vr) / 2
        lows, highs = (low, low), (high, high)
        if monotone[j] > 0:
            lows, highs = (low, mid), (mid, high)
        elif monotone[j] < 0:
            lows, highs = (mid, low), (high, mid)
        left = grow(rows[go], depth + 1, lows[0], highs[0], g, h)
        right = grow(rows[~go], depth + 1, lows[1], highs[1], g, h)
        nodes[me][:4] = [j, float(edges[j][k]), left, right]
        return me

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
    f, t, left, right, v = (np.array(c) for c in zip(*nodes, strict=True))
    return Forest(f.astype(np.int64), t, left, right, v, np.array(roots), start)


def train_quality(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """A forest fitted on at most SAMPLE labelled rows, or None without both kinds."""
    ship(docs.sparkSession)

    def seen(batches):
        for b in batches:
            at = 0
            for s in slices(b.column(2)):
                _, stats = statistics(s.buf, s.offs)
                size = s.last - s.first
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, size), b.column(1).slice(at, size), pa.FixedSizeListArray.from_arrays(pa.array(stats.reshape(-1)), len(STATS)).cast(pa.list_(pa.float64()))], names=["doc_id", "label", "stats"])
                at += size

    rows = stored(labelled_sample(docs, labels, F.col("quality"), SAMPLE).mapInArrow(lean(seen), "doc_id long, label int, stats array<double>"), "stats").orderBy("doc_id", "stats").collect()
    y = np.array([r.label > 0 for r in rows], dtype=float)
    return fit_forest(np.array([r.stats for r in rows]), y) if len(set(y)) == 2 else None


def quality_rules(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, quality of every document."""
    ship(docs.sparkSession)

    def judge(batches):
        for b in batches:
            at = 0
            for s in slices(b.column(1)):
                base, stats = statistics(s.buf, s.offs)
                size = s.last - s.first
                failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
                score = forest.score(stats) if forest is not None else np.ones(size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, size), *(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & (score >= KEEP_AT)), pa.array(score)], names=["doc_id", *BASE, "base_failed", "kept", "quality"])
                at += size

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, quality double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(judge), schema)
