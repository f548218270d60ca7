"""Whole texts to token ids with the public tokenizers, a distinct chunk at a time.

Both tokenizers cut a text by a pattern that never crosses from other characters to white
space, so a text's ids are the chain of its chunks' ids (see chunks.py). A run of white
space stays whole within a chunk.

The word tokenizer drops white space and case, and its pattern cuts between letters, digits
and other characters. So its new chunks are cut into words first (``cut_words``) and only
distinct words go to the library: ``Word``, `` word,`` and ``word!`` cost it one word.

The library takes a special token that a text holds literally (``<|endoftext|>``) for that
token: texts are cut around these strings, and each is a chunk of its own. With ``literal``
they are encoded like any other characters instead.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .chunks import SLICE, WHITE, ChunkCodes, _after_wide_space, chunk_bytes, cut_chunks, ragged_take
from .textcore import LOWER, segment_sums, slices

END_ID = 1
_JOINED = 1 << 18
#: Bytes of a text for the library at about; longer ones take it more time a byte.
_TEXT = 1 << 9
#: One token of the word tokenizer, put between chunks to find where each begins.
_MARK = "\U0001f602"
#: Byte kinds: 0 white space, 1 letter, 2 digit, 3 other, 4 not to be told from bytes alone.
_KIND = np.full(256, 4, dtype=np.int8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = 1
_KIND[48:58] = 2
_KIND[[32, *range(9, 14)]] = 0
_KIND[39] = 4  # an apostrophe may begin a contraction
_made: dict[tuple[str, bool], tuple[ChunkCodes, list[bytes]]] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _groups(ends: np.ndarray, target: int = _JOINED) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about target bytes; ends are the summed sizes."""
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + target)))
        yield i, j
        i = j


def _place(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bring (chunk numbers, flat, sizes) parts into the order of the chunks."""
    where, flat, size = (np.concatenate([p[k] for p in parts]) for k in range(3))
    offs = np.concatenate([[0], np.cumsum(size)])
    back = np.empty(n, dtype=np.int64)
    back[where] = np.arange(n)
    return ragged_take(flat, offs, back)


def _alone(tok, chunks: pa.Array, at: np.ndarray):
    ids = [e.ids for e in tok.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks.take(pa.array(at)).to_pylist()], add_special_tokens=False)]
    return at, np.array([x for e in ids for x in e], dtype=np.int64), np.array([len(e) for e in ids], dtype=np.int64)


def _ids(tok, texts: list[bytes]) -> np.ndarray:
    """The ids of several texts, end to end."""
    found = tok.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
    return np.array([x for e in found for x in e.ids], dtype=np.int64)


def _chained(tok, chunks: pa.Array, at: np.ndarray, closes):
    """Chunks that may be encoded as one text; closes(ids, bytes, offs) tells where each one's ids end."""
    some = chunks.take(pa.array(at))
    data, offs = chunk_bytes(some)
    for i, j in _groups(offs[1:]):
        lo, hi = offs[i], offs[j]
        here = offs[i : j + 1] - lo
        ids = _ids(tok, [data[lo + here[a] : lo + here[b]].tobytes() for a, b in _groups(here[1:], _TEXT)])
        upto = closes(ids, data[lo:hi], here)
        yield at[i:j], ids, np.diff(upto, prepend=0)


def cut_words(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, bounds) of chunks: those of chunk c are ``bounds[c]`` up to ``bounds[c + 1]``, each behind one space.

    Besides white space, cuts lie where ASCII letters, ASCII digits and other ASCII characters
    meet, before and after every such digit, and behind a letter of Latin-1; none beside an
    apostrophe, which may begin a contraction. ASCII letters become small ones, unless a
    character beyond ASCII follows, which might compose with them.
    """
    kind = np.where(data < 128, _KIND[data], np.int8(4))
    before, follows = np.zeros(len(data), dtype=np.int8), np.zeros(len(data), dtype=np.uint8)
    before[1:], follows[:-1] = kind[:-1], data[1:]
    before[2:][(data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] < 0xC0) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)] = 1
    solid = ~WHITE[data]
    first = solid & ((before == 0) | (before != 4) & (kind != 4) & ((kind != before) | (kind == 2)))
    first[offs[:-1]] = solid[offs[:-1]]
    begins = np.flatnonzero(first[solid])
    flat = np.insert(np.where(follows < 128, LOWER[data], data)[solid], begins, 32)
    cuts = np.append(begins, int(solid.sum())) + np.arange(len(begins) + 1)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
    return words, np.searchsorted(np.flatnonzero(first), offs)


def chunk_encoder(path: str, literal: bool = True) -> tuple[ChunkCodes, list[bytes]]:
    """Codes of chunks under a tokenizers file, and the special tokens to cut around; one a worker process, file and mode."""
    if (path, literal) in _made:
        return _made[path, literal]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = literal
    special = [] if literal else [t for t in tok.get_added_tokens_decoder().values() if t.special]
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in special):
        raise ValueError(f"{path}: special tokens must stand for themselves")
    vocab = tok.get_vocab()
    by_bytes = not any(w.endswith("</w>") for w in vocab)
    widths = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
    for word, i in vocab.items():
        widths[i] = len(word)  # byte-level pieces have a character a byte
    closing = np.zeros(len(widths), dtype=np.int64)
    for word, i in vocab.items():
        closing[i] = word.endswith("</w>")
    mark = tok.encode(_MARK, add_special_tokens=False).ids
    if not by_bytes and len(mark) != 1:
        raise ValueError(f"{path}: the mark must be one token")

    def level(chunks: pa.Array):
        data, offs = chunk_bytes(chunks)
        joins = WHITE[data[offs[:-1]]] & ~WHITE[data[offs[1:] - 1]] & ~_after_wide_space(data, offs[1:])
        ends = lambda ids, _, offs: np.searchsorted(np.cumsum(widths[ids]), offs[1:]) + 1
        return _place([_alone(tok, chunks, np.flatnonzero(~joins)), *_chained(tok, chunks, np.flatnonzero(joins), ends)], len(chunks))

    def worded(chunks: pa.Array):
        data, offs = chunk_bytes(chunks)
        # plain: words can be counted from bytes alone (ASCII and the letters of Latin-1)
        after = np.concatenate([[0], data[:-1]])
        kind = _KIND[data]
        kind[(after == 0xC3) & (data >= 0x80) & (data != 0x97) & (data != 0xB7)] = 1
        kind[offs[:-1]] = _KIND[data[offs[:-1]]]
        plain = WHITE[data[offs[:-1]]] & (segment_sums((kind == 4).astype(np.int64), offs) == 0)
        own = _MARK.encode()
        rest = np.flatnonzero(~plain)
        odd = np.array([own in c for c in chunks.take(pa.array(rest)).to_pylist()], dtype=bool)

        def ends(ids, data, offs):
            after = np.concatenate([[0], data[:-1]])
            kind = _KIND[data]
            kind[(after == 0xC3) & (data >= 0x80)] = 1
            new = (kind == 2) | (kind > 0) & (kind != np.concatenate([[0], kind[:-1]]))
            return np.searchsorted(np.cumsum(closing[ids]), np.cumsum(segment_sums(new.astype(np.int64), offs)), side="left") + 1

        parts = [_alone(tok, chunks, rest[odd])]
        parts += [(a, i, s) for a, i, s in _chained(tok, chunks, np.flatnonzero(plain & (segment_sums((kind > 0).astype(np.int64), offs) > 0)), ends)]
        empty = np.flatnonzero(plain & (segment_sums((kind > 0).astype(np.int64), offs) == 0))
        parts.append((empty, np.zeros(0, np.int64), np.zeros(len(empty), np.int64)))
        at = rest[~odd]
        some = chunks.take(pa.array(at)).to_pylist()
        for i, j in _groups(np.cumsum([len(c) + 6 for c in some])):
            ids = _ids(tok, [(b" " + own + b" ").join([*some[i + a : i + b], b""]) for a, b in _groups(np.cumsum([len(c) + 6 for c in some[i:j]]), _TEXT)])
            cut = ids == mark[0]
            at_mark = np.flatnonzero(cut)
            parts.append((at[i:j], ids[~cut], np.diff(at_mark - np.arange(len(at_mark)), prepend=0)))
        return _place(parts, len(chunks))

    strings = sorted((t.content.encode() for t in special), key=lambda t: (-len(t), t))
    words = ChunkCodes(worded)

    def spelled(chunks: pa.Array):
        """Chunks by their words; those that hold a special token, in small letters too, as they are."""
        data, offs = chunk_bytes(chunks)
        whole = np.zeros(len(chunks), dtype=bool)
        if any(t.lower() in data.tobytes().lower() for t in strings):
            whole[:] = [any(t.lower() in c.lower() for t in strings) for c in chunks.to_pylist()]
        rest, parts = np.flatnonzero(~whole), []
        if len(rest):
            cut, bounds = cut_words(*chunk_bytes(chunks.take(pa.array(rest))) if whole.any() else (data, offs))
            flat, upto, row = words.of(cut)
            ids, size = ragged_take(flat, upto, row)
            parts.append((rest, ids, segment_sums(size, bounds)))
        if whole.any():
            at = np.flatnonzero(whole)
            parts.append((at, *worded(chunks.take(pa.array(at)))))
        return _place(parts, len(chunks))

    _made[path, literal] = ChunkCodes(level if by_bytes else spelled), strings
    return _made[path, literal]


def _special_cuts(buf: np.ndarray, offs: np.ndarray, special: list[bytes]) -> np.ndarray | None:
    """Where special tokens begin and end in the documents of a slice."""
    raw = buf.tobytes() if special else b""
    if not any(t in raw for t in special):
        return None
    any_of = re.compile(b"|".join(map(re.escape, special)))
    return np.array([x for lo, hi in zip(offs.tolist(), offs[1:].tolist(), strict=False) for m in any_of.finditer(raw, lo, hi) for x in m.span()], dtype=np.int64)


def token_slices(texts, path: str, target: int = SLICE, literal: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, ids, bounds) of a batch's documents; each one's ids end with END_ID."""
    codes, special = chunk_encoder(path, literal)
    for s in slices(texts, target):
        chunks, bounds = cut_chunks(s.buf, s.offs, more=_special_cuts(s.buf, s.offs, special))
        flat, offs, row = codes.of(chunks)
        ids, size = ragged_take(flat, offs, row)
        ends = np.concatenate([[0], np.cumsum(size)])[bounds[1:]]
        ids = np.insert(ids, ends, END_ID)
        counts = segment_sums(size, bounds) + 1
        yield s.first, s.last, ids, np.concatenate([[0], np.cumsum(counts)])
