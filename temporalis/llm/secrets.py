"""Secret scans of whole texts: three fixed rules, and Markov models of characters.

Rules, leftmost and non-overlapping for each kind: assign (a keyword, = or :, and a value of
6 or more characters), access (AKIA and capitals or digits, 20 or more in all), hex (24 or
more of 0-9a-f). The method adds kind markov: runs of ``RUN`` characters are cut at the spans
of the rules, and of each part the stretch is taken whose log-likelihood under a first-order
character model of random strings exceeds that under one of ordinary identifiers most (less
``LEAST_EACH`` a character, where that stretch is thinner), widened to the ends of its outer
words of letters, digits and +, and to = signs behind it. It counts if it has ``LEAST_RUN``
characters and its whole part exceeds by ``LEAST_RATIO`` and by ``LEAST_EACH`` a character, or
it does so itself, the former raised by the log of the number of stretches it was chosen from
(chance makes the best of many look random). Then what is left of the part on both sides is searched likewise.

Both models are counted from labelled samples. Random: what the rules find in at most
``SAMPLE`` documents, and ``MADE`` strings of each of the usual alphabets with a fixed seed.
Ordinary, in equal parts: other runs of these documents that are short (under ``SHORT``) or
without digits, and identifiers (``ordinary_names``).

Spans are in code points, end exclusive. Nulls: a null text is empty and has no spans. Every
row is returned, repeated ones too; a null doc_id stays null. Other columns are ignored by
``find_secrets`` and kept by ``mask_secrets``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import importlib
import random
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, ship
from .textcore import byte_class, find_words, segment_sums, slices

SAMPLE = 4000
MADE = 3000
NAMES = 20_000
FEW = 50
#: Modules whose names count as ordinary identifiers, and runs in order.
MODULES = ["argparse", "asyncio", "builtins", "calendar", "codecs", "collections", "configparser", "csv", "ctypes", "datetime", "decimal", "email.message", "errno", "ftplib", "functools", "html.parser", "http.client", "http.cookies", "imaplib", "inspect", "json", "locale", "logging", "mimetypes", "multiprocessing", "os", "pathlib", "pickle", "platform", "shutil", "signal", "smtplib", "socket", "sqlite3", "ssl", "statistics", "subprocess", "tarfile", "threading", "tokenize", "traceback", "unittest", "urllib.request", "uuid", "xml.dom.minidom", "xml.sax.handler", "zipfile"]
ORDERED = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "9876543210", "zyxwvutsrqponmlkjihgfedcba", "qwertyuiop", "asdfghjkl", "zxcvbnm", "xxxxxxxx", "00000000", "========", "--------", "________", "........"]
SHORT = 20
LEAST_RUN = 12
LEAST_RATIO = 12.0
LEAST_EACH = 0.4
KINDS = ["assign", "access", "hex", "markov"]
MASK = "[secret]"

_LETTER_DIGIT = (range(48, 58), range(65, 91), range(97, 123))
#: The rules.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
RUN = byte_class(*_LETTER_DIGIT, b"+/_.=-")
HEX = byte_class(range(48, 58), range(97, 103))
UPPER_DIGIT = byte_class(range(48, 58), range(65, 91))
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
_DIGIT = byte_class(range(48, 58))
_SIGN = byte_class(b":=")
_LEAD = ~byte_class(range(128, 192))
_WORD = byte_class(*_LETTER_DIGIT, b"+")
#: Ratios are summed as whole numbers of this part, so that sums are exact.
_UNIT = 1 << 20


def rule_spans(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows (document, start, end, kind) in bytes of a slice, by the fixed rules."""
    found = []
    raw = buf.tobytes()
    some = np.flatnonzero(segment_sums(_SIGN[buf].astype(np.int64), offs))
    for d in some.tolist():
        lo, hi = int(offs[d]), int(offs[d + 1])
        found += [(d, m.start(), m.end(), 0) for m in ASSIGN.finditer(raw, lo, hi) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if len(buf) >= LEAST_ACCESS:
        akia = np.flatnonzero((buf[:-3] == 65) & (buf[1:-2] == 75) & (buf[2:-1] == 73) & (buf[3:] == 65))
        if len(akia):
            runs = find_words(buf, offs, UPPER_DIGIT)
            run = np.searchsorted(runs.starts, akia, side="right") - 1
            first = np.unique(run, return_index=True)[1]  # the first one takes the rest of its run
            akia, run = akia[first], run[first]
            ends = runs.ends[run]
            own = ends - akia >= LEAST_ACCESS
            found += [(int(d), int(s), int(e), 1) for d, s, e in zip(np.searchsorted(offs, akia[own], side="right") - 1, akia[own], ends[own], strict=True)]
    runs = find_words(buf, offs, HEX)
    own = runs.ends - runs.starts >= LEAST_HEX
    found += [(int(d), int(s), int(e), 2) for d, s, e in zip(runs.docs[own], runs.starts[own], runs.ends[own], strict=True)]
    return np.array(found, dtype=np.int64).reshape(-1, 4)


def _touches(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each range shares a byte with a span."""
    if not len(spans):
        return np.zeros(len(starts), dtype=bool)
    begins, stops = np.sort(spans[:, 1]), np.sort(spans[:, 2])
    return np.searchsorted(begins, ends, side="left") > np.searchsorted(stops, starts, side="right")


def _pairs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of neighbouring bytes of each range, and how many each has."""
    size = np.maximum(ends - starts - 1, 0)
    at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return buf[at].astype(np.int64) * 256 + buf[at + 1], size


def made_counts(n: int = MADE) -> np.ndarray:
    """Pairs of bytes in random strings over usual alphabets, from a fixed seed."""
    r = np.random.default_rng(17)
    digits, upper, lower = b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))
    counts = np.zeros(65536, dtype=np.int64)
    for alphabet in (digits + upper + lower, digits + upper + lower + b"+/", digits + upper, digits + lower, digits + b"abcdef"):
        drawn = np.frombuffer(alphabet, dtype=np.uint8)[r.integers(0, len(alphabet), (n, 32))].astype(np.int64)
        counts += np.bincount((drawn[:, :-1] * 256 + drawn[:, 1:]).ravel(), minlength=65536)
    return counts


def ordinary_names(n: int = NAMES) -> list[str]:
    """Identifiers known to be ordinary: public names of Python's standard library, and n names made
    of their words by a fixed seed in usual styles (camel, snake, kebab, dotted, paths), with versions and dates."""
    own: set[str] = set(sys.stdlib_module_names)
    for module in MODULES:
        m = importlib.import_module(module)
        own.update(dir(m))
        for part in vars(m).values():
            if isinstance(part, type):
                own.update([*dir(part), f"{part.__module__}.{part.__qualname__}"])
    names = sorted(x.strip("_") for x in own if len(x) > 3 and x.isascii())
    words = sorted({w.lower() for x in names for w in re.findall(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])", x)})
    r = random.Random(17)
    pick = lambda lo, hi: [r.choice(words) for _ in range(r.randint(lo, hi))]
    ending = lambda: r.choice(["", "", "", str(r.randint(0, 99)), f"-{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", f"_v{r.randint(1, 9)}", f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"])

    def camel(w):
        return "".join(x.upper() if r.random() < 0.08 and len(x) < 5 else x.capitalize() for x in w)

    styles = [
        lambda: camel(pick(2, 6)),
        lambda: r.choice(words) + camel(pick(1, 5)),
        lambda: "_".join(pick(2, 6)),
        lambda: "_".join(pick(1, 5)).upper(),
        lambda: "-".join(pick(2, 5)),
        lambda: ".".join(pick(2, 6)) + "." + camel(pick(1, 4)),
        lambda: r.choice(["", "/"]) + "/".join(r.choice(["_".join(pick(1, 2)), "-".join(pick(1, 2)), r.choice(words)]) for _ in range(r.randint(2, 7))) + r.choice(["", ".", "/"]) + r.choice(words)[:4],
    ]
    return [*names, *(r.choice(styles)() + ending() for _ in range(n))]


def name_counts() -> np.ndarray:
    """Pairs of bytes in ordinary names; alphabets and digits in order count as a small part of them."""
    data = "\n".join([*ordinary_names(), *ORDERED * 100]).encode()
    pairs = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    return np.bincount(pairs[:-1] * 256 + pairs[1:], minlength=65536)


def ratio_table(randoms: np.ndarray, *ordinary: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each pair of bytes, smoothed over the characters of a run.

    The ordinary model is a mixture of one from each table of counts: after a character that
    tables have seen n times, each weighs n / (n + ``FEW``), so about evenly unless it is rare.
    """
    k = np.flatnonzero(RUN)
    out = np.zeros((256, 256))

    def model(counts):
        own = counts.reshape(256, 256)[np.ix_(k, k)] + 0.5
        total = own.sum(axis=1, keepdims=True)
        seen = total - 0.5 * len(k)
        return own / total, seen / (seen + FEW) + 1e-9

    models = [model(c) for c in ordinary]
    mixed = sum(p * w for p, w in models) / sum(w for _, w in models)
    out[np.ix_(k, k)] = np.log(model(randoms)[0]) - np.log(mixed)
    return out.ravel()


def train_secrets(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The table of log-likelihood ratios, from at most so many documents."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    picked = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = rows.join(F.broadcast(picked), "doc_id").select("text")  # at most sample ids

    def count(batches):
        kept = np.zeros((2, 65536), dtype=np.int64)
        for b in batches:
            for s in slices(b.column(0)):
                spans = rule_spans(s.buf, s.offs)
                runs = find_words(s.buf, s.offs, RUN)
                hit = _touches(runs.starts, runs.ends, spans)
                long = runs.ends - runs.starts >= SHORT
                digits = np.concatenate([[0], np.cumsum(_DIGIT[s.buf])])
                plain = ~long | (digits[runs.ends] == digits[runs.starts])
                for kind, own in ((0, hit & long), (1, ~hit & plain)):
                    kept[kind] += np.bincount(_pairs(s.buf, runs.starts[own], runs.ends[own])[0], minlength=65536)
        kind, pair = np.nonzero(kept)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(kept[kind, pair])], names=["kind", "pair", "n"])

    # at most 2 * 67^2 rows
    kept = np.zeros((2, 65536), dtype=np.int64)
    for r in some.mapInArrow(lean(count), "kind int, pair int, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect():
        kept[r.kind, r.pair] = r.n
    return ratio_table(kept[0] + made_counts(), kept[1], name_counts())


def _outside(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ranges that lie outside all spans."""
    hit = _touches(starts, ends, spans)
    order = np.argsort(spans[:, 1], kind="stable")
    begins, stops = spans[order, 1], np.maximum.accumulate(spans[order, 2])
    parts = []
    for at, end in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True):
        i = int(np.searchsorted(stops, at, side="right"))
        while i < len(begins) and begins[i] < end:
            if begins[i] > at:
                parts.append((at, int(begins[i])))
            at = max(at, int(stops[i]))
            i += 1
        if at < end:
            parts.append((at, end))
    more = np.array(parts, dtype=np.int64).reshape(-1, 2)
    return np.concatenate([starts[~hit], more[:, 0]]), np.concatenate([ends[~hit], more[:, 1]])


def _best(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretch of each range (of two bytes or more) with the largest sum of ratios, and this sum."""
    code, size = _pairs(buf, starts, ends)
    value = ratios[code]
    # before each range the sum falls below all that came before, so that a running minimum is its own
    head = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    fall = segment_sums(np.abs(value), np.concatenate([[0], np.cumsum(size)])) + 1
    steps = np.insert(value, np.concatenate([[0], np.cumsum(size)[:-1]]), -np.concatenate([[0], fall[:-1]]))
    total = np.cumsum(steps)
    low = np.minimum.accumulate(total)
    gain = total - low
    most = np.maximum.reduceat(gain, head)
    at = np.flatnonzero(gain == np.repeat(most, size + 1))
    last = at[np.searchsorted(at, head)]
    first = np.maximum.accumulate(np.where(total == low, np.arange(len(total)), 0))[last]
    return starts + first - head, starts + last - head + 1, most


def _widened(buf: np.ndarray, lo: int, hi: int, start: int, end: int) -> tuple[int, int]:
    """A stretch up to the ends of its outer words, within lo and hi."""
    while start > lo and _WORD[buf[start]] and _WORD[buf[start - 1]]:
        start -= 1
    while end < hi and _WORD[buf[end - 1]] and _WORD[buf[end]]:
        end += 1
    while end < hi and buf[end] == 61:
        end += 1
    return start, end


def _random(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, ratios: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
    """Whether each whole range exceeds both bars, the first raised by more."""
    code, size = _pairs(buf, starts, ends)
    score = segment_sums(ratios[code], np.concatenate([[0], np.cumsum(size)]))
    return (score >= round(LEAST_RATIO * _UNIT) + more) & (score >= round(LEAST_EACH * _UNIT) * size)


def markov_spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Rows (document, start, end, kind) of the stretches outside spans that look random."""
    runs = find_words(buf, offs, RUN)
    long = runs.ends - runs.starts >= LEAST_RUN
    starts, ends = _outside(runs.starts[long], runs.ends[long], spans)
    ratios = np.rint(table * _UNIT).astype(np.int64)
    least, each = round(LEAST_RATIO * _UNIT), round(LEAST_EACH * _UNIT)
    found: list[np.ndarray] = []
    while True:
        long = ends - starts >= LEAST_RUN
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        begin, stop, score = _best(buf, starts, ends, ratios)
        own = score >= least
        starts, ends, begin, stop, score = starts[own], ends[own], begin[own], stop[own], score[own]
        thin = np.flatnonzero(score < each * (stop - begin - 1))
        if len(thin):
            begin[thin], stop[thin], _ = _best(buf, starts[thin], ends[thin], ratios - each)
        wide = np.array([_widened(buf, *x) for x in np.stack([starts, ends, begin, stop], axis=1).tolist()], dtype=np.int64).reshape(-1, 2)
        size = (ends - starts).astype(np.float64)
        chosen = np.rint(np.log(size * (size - 1) / 2) * _UNIT).astype(np.int64)
        hit = (_random(buf, wide[:, 0], wide[:, 1], ratios, chosen) | _random(buf, starts, ends, ratios)) & (wide[:, 1] - wide[:, 0] >= LEAST_RUN)
        found.append(wide[hit])
        starts, ends = np.concatenate([starts, wide[:, 1]]), np.concatenate([wide[:, 0], ends])
    at = np.concatenate([np.zeros((0, 2), dtype=np.int64), *found])
    return np.stack([np.searchsorted(offs, at[:, 0], side="right") - 1, at[:, 0], at[:, 1], np.full(len(at), 3)], axis=1)


def all_spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Rows (document, start, end, kind) of a slice, by start, then kind."""
    spans = rule_spans(buf, offs)
    spans = np.concatenate([spans, markov_spans(buf, offs, table, spans)])
    return spans[np.lexsort((spans[:, 3], spans[:, 1]))]


def _scan(texts, table: np.ndarray) -> Iterator[tuple]:
    """For each slice: it, its spans in bytes, and the same in code points of each document."""
    for s in slices(texts):
        spans = all_spans(s.buf, s.offs, table)
        points = spans
        if len(spans):
            lead = np.concatenate([[0], np.cumsum(_LEAD[s.buf])])
            base = lead[s.offs[spans[:, 0]]]
            points = np.stack([spans[:, 0], lead[spans[:, 1]] - base, lead[spans[:, 2]] - base, spans[:, 3]], axis=1)
        yield s, spans, points


def find_secrets(docs: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every document."""
    ship(docs.sparkSession)
    nothing = hashlib.sha256(b"").hexdigest()

    def scan(batches):
        for b in batches:
            for s, _, points in _scan(b.column(1), table):
                size = s.last - s.first
                counts = [np.bincount(points[points[:, 3] == k, 0], minlength=size) for k in range(4)]
                digest, text = [nothing] * size, [""] * size
                for d in np.unique(points[:, 0]).tolist():
                    own = points[points[:, 0] == d].tolist()
                    said = [(k, f"{KINDS[k]}:{x}:{y}") for _, x, y, k in own]
                    digest[d] = hashlib.sha256(",".join(t for k, t in said if k < 3).encode()).hexdigest()
                    text[d] = ",".join(t for _, t in said)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, size), *(pa.array(c.astype(np.int64)) for c in counts[:3]), pa.array(digest), pa.array(text), pa.array(counts[3].astype(np.int64))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(scan), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def mask_secrets(docs: DataFrame, table: np.ndarray, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """docs with every secret replaced in the text; a null text stays null."""
    ship(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_col)

    def masked(raw: memoryview, start: int, end: int, spans: list) -> str:
        out, done = [], start
        for _, x, y, _ in spans:
            if y > done:
                out += [raw[done : max(x, done)], mask.encode() if x >= done else b""]
                done = y
        return b"".join([*out, raw[done:end]]).decode("utf-8", "replace")

    def hide(batches):
        for b in batches:
            column = b.column(at)
            parts, done = [], 0  # texts without spans pass through as they are
            for s, spans, _ in _scan(column, table):
                raw = memoryview(s.buf)
                for d in np.unique(spans[:, 0]).tolist():
                    parts += [column.slice(done, s.first + d - done), pa.array([masked(raw, int(s.offs[d]), int(s.offs[d + 1]), spans[spans[:, 0] == d].tolist())], column.type)]
                    done = s.first + d + 1
            if parts:
                column = pa.concat_arrays([*parts, column.slice(done)])
            yield pa.RecordBatch.from_arrays([column if i == at else b.column(i) for i in range(len(names))], names=names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(lean(hide), docs.withColumn(text_col, F.col(text_col).cast("string")).schema)
