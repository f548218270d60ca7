"""Toxicity: a cumulative-link ordinal regression over sparse word features.

P(grade >= k) = sigmoid(w . x - t_k): one weight vector for all ordered thresholds
t_1 < t_2 < ... . x has a 1 for each selected feature that a whole text holds: words (runs
of letters, A-Z in lower case) and their beginnings of ``HEADS`` bytes, which stand for
stems with any ending. The severity is the expected grade, sum over k of P(grade >= k); a
document is toxic if P(grade >= 1) is at least one half.

Labels only tell toxic from not; grades 1 and 2 of toxic rows are told by how many marked
features their texts hold (see ``graded``), unless a grade column is given.

Training takes at most ``SAMPLE`` labelled rows. Features of at least ``LEAST_DOCS`` of them
compete; the ``FEATURES`` with the largest chi-square against grade >= 1 are kept. Without
labelled rows, or with one grade only, nothing is toxic (severity 0).

Nulls: a null text counts as empty (no features). Every row is returned, repeated ones
too; a null doc_id stays null. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import labelled_sample
from .shared import lean, ship, stored
from .textcore import LETTERS, LOWER, find_words, slices, span_hashes

SAMPLE = 6000
FEATURES = 4096
LEAST_DOCS = 4
HEADS = (4, 5)
RIDGE = 0.5
#: A feature is marked if at least this share of the training rows that have it are toxic.
MARKED = 0.8
STEPS = 400
#: A document is toxic from this P(grade >= 1) on.
TOXIC_AT = 0.5


class OrdinalModel(NamedTuple):
    """Sorted feature hashes, their shared weights, and the ascending thresholds."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))


def _features(texts):
    """For each slice: its size, hashes of all features, and where each document's begin."""
    for s in slices(texts):
        low = LOWER[s.buf]
        words = find_words(low, s.offs, LETTERS)
        kinds = [span_hashes(low, words.starts, words.ends)]
        for k, n in enumerate(HEADS):
            own = np.flatnonzero(words.ends - words.starts > n)
            head = kinds[0].copy()
            head[own] = span_hashes(low, words.starts[own], words.starts[own] + n) ^ np.uint64(k + 1)
            kinds.append(head)
        yield s.last - s.first, np.stack(kinds, axis=1).ravel(), words.bounds * len(kinds)


def _distinct(batches):
    for b in batches:
        at = 0
        for size, hashes, bounds in _features(b.column(2)):
            sets = [np.unique(hashes[bounds[d] : bounds[d + 1]]).view(np.int64) for d in range(size)]
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, size), b.column(1).slice(at, size), lists], names=["doc_id", "label", "words"])
            at += size


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, width: int, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the penalised likelihood, by full-batch Adam steps.

    (rows, cols) are the places of ones. Later thresholds are the first plus positive gaps.
    """
    n, k = len(grades), int(grades.max())
    w = np.zeros(width)
    shares = np.clip([(grades >= j).mean() for j in range(1, k + 1)], 1e-4, 1 - 1e-4)
    cuts = np.maximum.accumulate(-np.log(shares / (1 - shares)) + 1e-3 * np.arange(k))
    free = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    first, second = np.zeros(width + k), np.zeros(width + k)
    for step in range(1, steps + 1):
        gaps = np.exp(np.clip(free[1:], -20, 20))
        t = free[0] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(rows, weights=w[cols], minlength=n)
        p = np.ones((n, k + 2))
        p[:, 1 : k + 1] = 1 / (1 + np.exp(np.clip(t[None] - z[:, None], -60, 60)))
        p[:, k + 1] = 0
        slope = p * (1 - p)
        i = np.arange(n)
        likely = np.maximum(p[i, grades] - p[i, grades + 1], 1e-12)
        up, down = slope[i, grades] / likely / n, slope[i, grades + 1] / likely / n
        dz = -(up - down)
        dt = np.bincount(grades, weights=up, minlength=k + 2) - np.bincount(grades + 1, weights=down, minlength=k + 2)
        dt = dt[1 : k + 1]
        tail = np.cumsum(dt[::-1])[::-1]
        grad = np.concatenate([np.bincount(cols, weights=dz[rows], minlength=width) + ridge / n * w, tail[:1], tail[1:] * gaps])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-10)
        w, free = w - move[:width], free - move[width:]
    return w, free[0] + np.concatenate([[0], np.cumsum(np.exp(np.clip(free[1:], -20, 20)))])


def graded(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, width: int) -> np.ndarray:
    """Grades 0, 1, 2 of rows that are only known to be toxic or not, from their places of ones.

    A feature is marked if at least ``MARKED`` of the rows that have it are toxic. A toxic row
    is of grade 2 if it has more marked features than the median toxic row, else of grade 1: of two toxic
    rows, one with more of the marked features never has the lower grade.
    """
    have = np.bincount(cols, minlength=width)
    marked = np.bincount(cols, weights=toxic[rows], minlength=width) >= MARKED * np.maximum(have, 1)
    count = np.bincount(rows, weights=marked[cols], minlength=len(toxic))
    middle = np.median(count[toxic]) if toxic.any() else 0
    return np.where(toxic, np.where(count > middle, 2, 1), 0)


def train_toxicity(docs: DataFrame, labels: DataFrame, grade: Column | None = None) -> OrdinalModel:
    """Fit on at most SAMPLE labelled rows.

    grade is an ordered integer column of labels; without it rows are toxic or not by their
    column toxic, and graded by their texts (see ``graded``).
    """
    ship(docs.sparkSession)
    none = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    label = F.col("toxic") if grade is None else grade
    bags = stored(labelled_sample(docs, labels, label, SAMPLE).mapInArrow(lean(_distinct), "doc_id long, label int, words array<long>"), "bags")
    total = bags.agg(F.count("*").alias("n"), F.count_if(F.col("label") >= 1).alias("bad"), F.countDistinct("label").alias("kinds")).first()
    if total.kinds < 2:
        return none
    n, bad = total.n, total.bad
    each = bags.select("doc_id", "label", F.explode("words").alias("word"))
    a, b = F.count_if(F.col("label") >= 1), F.count("*")
    seen = each.groupBy("word").agg(a.alias("a"), b.alias("b")).where(F.col("b") >= LEAST_DOCS)
    lift = F.col("a") - F.col("b") * F.lit(bad / n)
    picked = seen.orderBy((lift * lift / F.col("b")).desc(), "word").limit(FEATURES).select("word")
    words = sorted(r.word for r in picked.collect())
    hashes = np.sort(np.array(words, dtype=np.int64).view(np.uint64))
    rows = each.join(F.broadcast(picked), "word").groupBy("doc_id").agg(F.collect_set("word").alias("words"))
    bag = bags.select("doc_id", "label").distinct().join(rows, "doc_id", "left").orderBy("doc_id").collect()
    grades = np.array([r.label for r in bag], dtype=np.int64)
    at = np.repeat(np.arange(len(bag)), [len(r.words or ()) for r in bag])
    cols = np.searchsorted(hashes, np.array([w for r in bag for w in sorted(r.words or ())], dtype=np.int64).view(np.uint64))
    if grade is None:
        grades = graded(at, cols, grades >= 1, len(hashes))
    _, grades = np.unique(grades, return_inverse=True)  # grades that never occur are skipped
    w, t = fit_ordinal(at, cols, grades, len(hashes))
    return OrdinalModel(hashes, w, t)


def _judged(texts, model: OrdinalModel):
    """(size, P(grade >= k) of each document) of each slice."""
    hashes, weights, thresholds = model
    first = np.zeros(1 << 16, dtype=bool)
    first[(hashes >> np.uint64(48)).astype(np.int64)] = True
    for size, h, bounds in _features(texts):
        z = np.zeros(size)
        if len(hashes):
            near = np.flatnonzero(first[(h >> np.uint64(48)).astype(np.int64)])
            col = np.searchsorted(hashes, h[near])
            col[col == len(hashes)] = 0
            hit = hashes[col] == h[near]
            docs_of = np.searchsorted(bounds, near[hit], side="right") - 1
            pair = np.unique(docs_of * len(hashes) + col[hit])
            z = np.bincount(pair // len(hashes), weights=weights[pair % len(hashes)], minlength=size)
        yield size, model.at_least(z) if len(thresholds) else np.zeros((size, 1))


def score_toxicity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, p_toxic, severity, toxic, kept of every document, over its whole text."""
    ship(docs.sparkSession)

    def score(batches):
        for b in batches:
            at = 0
            for size, p in _judged(b.column(1), model):
                bad = p[:, 0] >= TOXIC_AT
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, size), pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array(bad), pa.array(~bad)], names=["doc_id", "p_toxic", "severity", "toxic", "kept"])
                at += size

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(score), "doc_id long, p_toxic double, severity double, toxic boolean, kept boolean")


def without_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't toxic: each row's verdict stays with it."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(batches):
        for b in batches:
            bad = [p[:, 0] >= TOXIC_AT for _, p in _judged(b.column(at).cast(pa.string()), model)]
            yield b.filter(pa.array(~np.concatenate([np.zeros(0, dtype=bool), *bad])))

    return docs.mapInArrow(lean(keep), docs.schema)
