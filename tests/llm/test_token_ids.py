import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from temporalis.llm import chunks, huffman, tokens
from temporalis.llm.huffman import code_lengths, decode_blocks, decoding_table, encode_bits, read_ids, tokenised, write_ids
from temporalis.llm.packing import BITS, DIMS, WIDTH, hilbert_keys, pack
from temporalis.llm.shared import scratch_path
from temporalis.llm.tokens import token_slices, tokenizer_path

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = ["a", "B", "é", "é", " ", "  ", "\n", " ", "　", "'s", "12", "!", "\U0001f602", "\t", "İ", "ß", "한", "<|endoftext|>", "\xa0", "x" * 20, "́", "\x85", "'", "ll", "×", "\x1c"]


def made(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def plain(name, texts):
    tok = Tokenizer.from_file(tokenizer_path(name))
    tok.encode_special_tokens = True
    return [e.ids + [1] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("cache", [0, 1 << 20])
def test_chunks_equal_whole_texts(name, cache, monkeypatch):
    monkeypatch.setattr(chunks, "CACHE", cache)
    texts = made(1500)
    want = plain(name, texts)
    for first, last, ids, bounds in token_slices(pa.array(texts), tokenizer_path(name), 1 << 12):
        for i in range(first, last):
            assert ids[bounds[i - first] : bounds[i - first + 1]].tolist() == want[i], repr(texts[i])


def test_code_lengths_are_optimal_and_limited():
    import heapq

    r = np.random.default_rng(0)
    counts = np.concatenate([r.integers(0, 50, 200), [10**6]])
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    lengths = code_lengths(counts, 40)
    assert (lengths * counts).sum() == cost
    tight = code_lengths(counts, 8)
    assert tight.max() <= 8 and abs(sum(2.0 ** -float(x) for x in tight if x) - 1) < 1e-12
    assert code_lengths(np.array([0, 5])).tolist() == [0, 1] and code_lengths(np.zeros(3, int)).sum() == 0


def test_blocks_decode_alone():
    r = np.random.default_rng(1)
    ids = np.minimum(r.geometric(0.01, 5000), 3000)
    lengths = code_lengths(np.bincount(ids, minlength=1 << 16))
    codes = huffman.canonical_codes(lengths)
    cuts = [0, 1, 130, 131, 3000, 5000]
    packed = [encode_bits(ids[a:b], codes, lengths) for a, b in zip(cuts, cuts[1:], strict=False)]
    table = decoding_table(lengths)
    sizes = np.diff(cuts).tolist()
    assert (decode_blocks([p for p, _ in packed], sizes, [c for _, c in packed], table) == ids).all()
    assert (decode_blocks([packed[3][0]], [sizes[3]], [packed[3][1]], table) == ids[131:3000]).all()


def rows_of(spark):
    texts = made(300, 5) + [None, "", "word " * 50_000, "same", "same"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x"), (None, "none", "x")]
    random.Random(2).shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)


def test_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK", 500)
    rows, docs = rows_of(spark)
    path = scratch_path(spark, "ids")
    write_ids(tokenised(docs, tokenizer_path(FILES[0])), path)
    got = sorted(read_ids(spark, path).collect(), key=lambda r: r.start)
    want = sorted(zip(rows, plain(FILES[0], [r[1] for r in rows]), strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r, _ in want]
    at = 0
    for r, (_, ids) in zip(got, want, strict=True):
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert np.frombuffer(r.ids, "<u2").tolist() == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = scratch_path(spark, "ids")
    write_ids(tokenised(docs.where("false"), tokenizer_path(FILES[0])), empty)
    assert read_ids(spark, empty).count() == 0


def test_hilbert_keys_walk_the_grid():
    bits = 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
    assert BITS * DIMS < 63


def test_packing(spark):
    rows, docs = rows_of(spark)
    got = pack(docs, tokenizer_path(FILES[1]), with_ids=True).collect()
    ids = plain(FILES[1], [r[1] for r in rows])
    total = sum(map(len, ids))
    line = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in line:
        assert r.sequence_id * WIDTH + r.offset == at and 0 < r.length <= WIDTH - r.offset
        at += r.length
    assert at == total
    docs_seen = []
    for r in line:
        part = np.frombuffer(r.ids, "<u2").tolist()
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == r.length
        if r.start == 0:
            docs_seen.append([r.doc_id, []])
        assert docs_seen[-1][0] == r.doc_id and len(docs_seen[-1][1]) == r.start
        docs_seen[-1][1].extend(part)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(docs_seen, key=key) == sorted(([r[0], i] for r, i in zip(rows, ids, strict=True)), key=key)
    assert pack(docs.where("false"), tokenizer_path(FILES[1])).count() == 0


def as_library(name, texts):
    tok = Tokenizer.from_file(tokenizer_path(name))
    return [e.ids + [1] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_special_tokens_as_the_library_takes_them(name):
    r = random.Random(6)
    parts = [*PARTS, "<|startoftext|>", "<|endof", "text|>", "<|ENDOFTEXT|>", "<|endoftext|>"]
    texts = ["hello <|endoftext|> world", "x<|endof", "text|>y", None, "<|endoftext|><|startoftext|>", *("".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(1500))]
    want = as_library(name, texts)
    assert want[0] == ([31373, 220, 50256, 995, 1] if name.startswith("byte") else [3306, 49407, 1002, 1])
    for target in (1 << 12, 1 << 24):
        for first, last, ids, bounds in token_slices(pa.array(texts), tokenizer_path(name), target, literal=False):
            for i in range(first, last):
                assert ids[bounds[i - first] : bounds[i - first + 1]].tolist() == want[i], repr(texts[i])


def test_queries_take_special_tokens(spark, tmp_path):
    from temporalis.llm.queries import queries

    texts = ["hello <|endoftext|> world", "plain", "<|startoftext|>a<|endoftext|>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query, name, size in (("op4_token_ids", FILES[0], "n_tokens"), ("op10_packing", FILES[1], "doc_tokens")):
        got = {x.doc_id: x for x in queries()[query](spark, str(tmp_path)).collect()}
        for i, ids in enumerate(as_library(name, texts)):
            assert (got[i][size], got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_a_word_goes_to_the_library_once(monkeypatch):
    given, plain_ids = [], tokens._ids

    def counted(tok, texts):
        given.append(len(texts) if isinstance(texts, bytes) else sum(map(len, texts)))
        return plain_ids(tok, texts)

    monkeypatch.setattr(tokens, "_made", {})
    monkeypatch.setattr(tokens, "_ids", counted)
    r = random.Random(8)
    words = sorted({"".join(r.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(8)) for _ in range(500)})
    forms = [w[0].upper() + w[1:] if w.isascii() else w for w in words] + words
    texts = [" ".join(a + w + b for w in r.sample(forms, 200)) for a in ("", "(", "\n", "1") for b in ("", ",", ".", "!?", "\t", "77", '",') for _ in range(6)]
    want = as_library(FILES[0], texts)
    for first, last, ids, bounds in token_slices(pa.array(texts), tokenizer_path(FILES[0]), 1 << 12, literal=False):
        for i in range(first, last):
            assert ids[bounds[i - first] : bounds[i - first + 1]].tolist() == want[i], repr(texts[i])
    assert sum(given) < 2 * sum(len(w.encode()) + 9 for w in words)


@pytest.mark.parametrize("literal", [False, True])
@pytest.mark.parametrize("cache", [0, 1 << 20])
def test_words_are_cut_as_the_library_cuts_them(literal, cache, monkeypatch):
    monkeypatch.setattr(chunks, "CACHE", cache)
    r = random.Random(9)
    parts = [*"aSTJKzI09.,=<|>_-é×÷ÉÃãß", "'", "'S", "'re", "'LL", "\u0301", "\u030c", "\u0338", "\u0307", "\u212a", "İ", "ǅ", "²", "ª", "٣", " ", "\n", "\xa0", "\u2003", "\x1c", "\x00", "\x7f", "한", "\u1100", "\u1161", "\U0001f602", "ﬁ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|endof", "text|>"]
    texts = ["J\u030c j\u030c", "x',s y's, ('s) '12 'stop", "<|ENDOFTEXT|><|endoftext|>A", "A\u0301,B 1a1A", *("".join(r.choice(parts) for _ in range(r.randint(0, 24))) for _ in range(6000))]
    want = (plain if literal else as_library)(FILES[0], texts)
    for first, last, ids, bounds in token_slices(pa.array(texts), tokenizer_path(FILES[0]), 1 << 13, literal=literal):
        for i in range(first, last):
            assert ids[bounds[i - first] : bounds[i - first + 1]].tolist() == want[i], repr(texts[i])
