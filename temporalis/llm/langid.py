"""Language ID of whole, possibly mixed texts: scripts, word scores, and Viterbi.

Letters are ASCII letters and every byte of a longer code point; a word is a run of them.
A word's score for a language is the sum of log-probabilities of its byte trigrams (ends
included) in that language's training texts. Script ranges narrow the candidates first: a
language stays a candidate for a word only if its training texts use the word's script.
Then Viterbi over all words of the text, with ``SWITCH`` as the price of a change of
language, labels spans of words. The text's language is the one whose spans hold the most
letters (the first in order on ties), the score its share of all letters.

Viterbi is exact for texts of any length: words are cut into chunks, each chunk is solved
for every language that may come before it, side by side, and the chunks are then joined.

Training reads text and non-null lang of rows that aren't held out, at most about
``SAMPLE`` whole texts a language, chosen by a hash of doc_id.

Nulls: a null text, or one without a letter, is ``und`` with score 0; so is everything if
nothing could be learned. Every row is returned, repeated ones too; a null doc_id stays
null and isn't held out. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, ship
from .textcore import LETTERS, LOWER, find_words, segment_sums, slices

SAMPLE = 1500
SWITCH = 12.0
BITS = 16
CHUNK = 256
#: Beyond any sum of word scores: languages without the word's script are never chosen for it.
NOT_A_CANDIDATE = -1e9
SLICE = 2 << 20

_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True

#: First and last lead byte (UTF-8) of each script's ranges; later rows win.
SCRIPTS = [
    ("latin", 0x41, 0x7A), ("other", 0x80, 0xFF), ("latin", 0xC3, 0xC9), ("greek", 0xCD, 0xCF), ("cyrillic", 0xD0, 0xD4),
    ("hebrew", 0xD6, 0xD7), ("arabic", 0xD8, 0xDD), ("indic", 0xE0, 0xE0), ("cjk", 0xE3, 0xE9), ("hangul", 0xEA, 0xED),
]
SCRIPT_NAMES = sorted({s for s, _, _ in SCRIPTS})
_SCRIPT = np.zeros(256, dtype=np.int8)
for _name, _lo, _hi in SCRIPTS:
    _SCRIPT[_lo : _hi + 1] = SCRIPT_NAMES.index(_name)

_FLAT = np.where(LETTERS, LOWER, 32).astype(np.uint8)


class LanguageModel(NamedTuple):
    """Languages in order, trigram log-probabilities [bucket, language], scripts [script, language]."""

    langs: list[str]
    table: np.ndarray
    scripts: np.ndarray


def _trigrams(texts, target=SLICE):
    """For each slice: it, its words, the trigram buckets of all words and how many each word has."""
    for s in slices(texts, target):
        cuts = s.offs[1:-1]
        buf = np.insert(_FLAT[s.buf], cuts, 32)
        offs = s.offs + np.concatenate([[0], np.arange(1, len(s.offs) - 1), [len(cuts)]])
        words = find_words(buf, offs, LETTERS)
        padded = np.concatenate([[32, 32], buf, [32]]).astype(np.uint32)
        last, mid, first = padded[2:], padded[1:-1], padded[:-2]
        code = (np.where(mid == 32, 32, first) << 16) | (mid << 8) | last
        own = np.zeros(len(code), dtype=bool)
        own[:-1] = LETTERS[buf]
        own[words.ends] = True
        with np.errstate(over="ignore"):
            buckets = (code[own] * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        yield s, buf, words, buckets, words.ends - words.starts + 1


def _heads(buf, words):
    """The script of each word, told by its first byte."""
    return _SCRIPT[buf[words.starts]].astype(np.int64)


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each row of scores [word, label], for each document on its own.

    Staying wins over switching on ties, and smaller labels over larger ones.
    """
    n, k = scores.shape
    labels = np.zeros(n, dtype=np.int8)
    if not n:
        return labels
    counts = np.diff(bounds)
    per_doc = -(-counts // CHUNK)
    n_chunks = int(per_doc.sum())
    first_chunk = np.concatenate([[0], np.cumsum(per_doc)])
    doc_of = np.repeat(np.arange(len(counts)), per_doc)
    begin = bounds[doc_of] + (np.arange(n_chunks) - first_chunk[doc_of]) * CHUNK
    length = np.minimum(bounds[doc_of + 1] - begin, CHUNK)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    live = np.searchsorted(-length, -np.arange(CHUNK), side="left")  # chunks longer than t
    # best[c, e, j]: best sum within chunk c that ends in j, if label e came before
    eye = np.where(np.eye(k, dtype=bool), 0.0, -switch)
    best = np.broadcast_to(eye, (n_chunks, k, k)) + scores[begin][:, None, :]
    back = np.zeros((CHUNK, n_chunks, k, k), dtype=np.int8)
    steps = np.arange(k, dtype=np.int8)
    for t in range(1, int(length[0])):
        a = int(live[t])
        now = best[:a]
        top = now.argmax(axis=2)
        jump = np.take_along_axis(now, top[:, :, None], 2) - switch
        stay = now >= jump
        back[t, :a] = np.where(stay, steps, top[:, :, None])
        best[:a] = np.where(stay, now, jump) + scores[begin[:a] + t][:, None, :]
    inverse = np.empty(n_chunks, dtype=np.int64)
    inverse[order] = np.arange(n_chunks)
    # join the chunks of each document: all documents take their i-th chunk together
    total = np.zeros((len(counts), k))
    came = np.zeros((n_chunks, k), dtype=np.int8)  # best label before chunk c, by its last label
    for i in range(int(per_doc.max())):
        docs = np.flatnonzero(per_doc > i)
        c = inverse[first_chunk[docs] + i]
        # before the first chunk every label is as good: the start is free
        ways = total[docs][:, :, None] + best[c]
        came[c] = ways.argmax(axis=1)
        total[docs] = ways.max(axis=1)
    ends = np.zeros(n_chunks, dtype=np.int64)
    entry = np.zeros(n_chunks, dtype=np.int64)
    state = total.argmax(axis=1)
    for i in range(int(per_doc.max()) - 1, -1, -1):
        docs = np.flatnonzero(per_doc > i)
        c = inverse[first_chunk[docs] + i]
        ends[c] = state[docs]
        entry[c] = came[c, ends[c]]
        state[docs] = entry[c]
    now = ends.copy()
    for t in range(int(length[0]) - 1, -1, -1):
        a = int(live[t])
        labels[begin[:a] + t] = now[:a]
        if t:
            now[:a] = back[t, np.arange(a), entry[:a], now[:a]]
    return labels


def held_out():
    """Whether a row is kept from training: crc32 of its doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_languages(docs: DataFrame) -> LanguageModel:
    """Learn from text and lang of the rows that aren't held out."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    wanted = sizes.select("lang", (F.lit(SAMPLE) / F.col("n") * 1_000_000).alias("bar"))
    # one row a language
    some = rows.join(F.broadcast(wanted), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("bar")).select("lang", "text")
    n_scripts = len(SCRIPT_NAMES)

    def counts(batches):
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for lang in sorted(set(langs)):
                own = b.column(1).filter(pa.array([x == lang for x in langs]))
                have = seen.setdefault(lang, np.zeros((1 << BITS) + n_scripts, dtype=np.int64))
                for _, buf, words, buckets, _ in _trigrams(own):
                    have[: 1 << BITS] += np.bincount(buckets, minlength=1 << BITS)
                    have[1 << BITS :] += np.bincount(_heads(buf, words), minlength=n_scripts)
        for lang, have in seen.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(have[at])], names=["lang", "bucket", "n"])

    # at most (buckets + scripts) rows a language
    found = some.mapInArrow(lean(counts), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found.lang.unique())
    table = np.full(((1 << BITS) + n_scripts, len(langs)), 0.0)
    for j, lang in enumerate(langs):
        own = found[found.lang == lang]
        table[own.bucket.to_numpy(), j] = own.n.to_numpy()
    grams, heads = table[: 1 << BITS], table[1 << BITS :]
    grams = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * (1 << BITS)))
    allowed = heads >= 0.001 * np.maximum(heads.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    return LanguageModel(langs, grams.astype(np.float32), allowed)


def label_words(texts, model: LanguageModel):
    """For each slice: it, its words, and the language number of every word."""
    bar = np.where(model.scripts, 0.0, NOT_A_CANDIDATE)
    target = max(1 << 18, SLICE * 16 // max(16, len(model.langs) ** 2))
    for s, buf, words, buckets, sizes in _trigrams(texts, target):
        if len(words.starts):
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            scores = np.add.reduceat(model.table[buckets], at, axis=0) + bar[_heads(buf, words)]
        else:
            scores = np.zeros((0, len(model.langs)))
        yield s, words, viterbi(scores, words.bounds)


def _main_languages(texts, model: LanguageModel):
    """For each slice: its size, and of each document whether it has letters, its main language, this one's share, and its spans.

    Without a learned language, language and share are 0.
    """
    langs, at = model.langs, 0
    for s, words, labels in label_words(texts, model) if langs else ((s, None, None) for s in slices(texts)):
        size = s.last - s.first
        plain = segment_sums(_ASCII_LETTER[s.buf].astype(np.int64), s.offs) > 0
        for d in np.flatnonzero(~plain & (np.diff(s.offs) > 0)):
            plain[d] = bool(_LETTER.search(texts[at + int(d)].as_py()))
        at += size
        if not langs:
            yield size, plain, np.zeros(size, dtype=np.int64), np.zeros(size), np.zeros(size, dtype=np.int64)
            continue
        letters = (words.ends - words.starts).astype(np.float64)
        share = np.stack([segment_sums(np.where(labels == j, letters, 0.0), words.bounds) for j in range(len(langs))], axis=1)
        total = share.sum(axis=1)
        best = share.argmax(axis=1)
        score = np.where(plain, share[np.arange(size), best] / np.maximum(total, 1), 0.0)
        turn = np.ones(len(labels), dtype=np.int64)
        turn[1:] = labels[1:] != labels[:-1]
        turn[words.bounds[:-1][words.counts > 0]] = 1
        yield size, plain, best, score, np.where(plain, segment_sums(turn, words.bounds), 0)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans of every document."""
    ship(docs.sparkSession)
    names = np.array([*model.langs, "und"], dtype=object)

    def predict(batches):
        for b in batches:
            at = 0
            for size, plain, best, score, spans in _main_languages(b.column(1), model):
                said = names[np.where(plain, best, -1)] if model.langs else np.full(size, "und", dtype=object)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, size), b.column(2).slice(at, size), pa.array(said.tolist(), pa.string()), pa.array(score), pa.array(spans.astype(np.int64))], names=["doc_id", "held_out", "lang_pred", "score", "n_spans"])
                at += size

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(lean(predict), "doc_id long, held_out boolean, lang_pred string, score double, n_spans long")


def with_main_language(docs: DataFrame, model: LanguageModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text has a letter and a language with at least this share.

    If no language could be learned, every text with a letter stays.
    """
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(batches):
        for b in batches:
            own = [plain & ((score >= least) if model.langs else True) for _, plain, _, score, _ in _main_languages(b.column(at).cast(pa.string()), model)]
            yield b.filter(pa.array(np.concatenate([np.zeros(0, dtype=bool), *own])))

    return docs.mapInArrow(lean(keep), docs.schema)
