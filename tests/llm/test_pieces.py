import zlib

import numpy as np
import pyarrow as pa
import pytest

from temporalis.llm import pieces
from temporalis.llm.pieces import decode_ids, encode_nbest, load_vocabulary, search_long, segment
from temporalis.llm.tokens import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
TEXTS = ["", "a", "the cat", " a  b", "hé\nx", "日本 の", "xyzab c d", "a b", "﷽ a", "zz", "   ", "tab\t!"]


def brute(v, text, n):
    """All paths of the whole text, by recursion."""
    if not text:
        return [(0.0, ())]
    data = (" " + text).encode()
    by = {v.pieces[i]: i for i in np.flatnonzero(v.normal)}
    found = []

    def walk(at, ids, score):
        if at == len(data):
            found.append((score, tuple(ids)))
            return
        width = 1
        while at + width < len(data) and 128 <= data[at + width] < 192:
            width += 1
        for e in range(at + 1, min(len(data), at + 49) + 1):
            if data[at:e] in by:
                walk(e, [*ids, by[data[at:e]]], score + v.scores[by[data[at:e]]])
        if data[at : at + width] not in by:
            walk(at + width, [*ids, *(int(v.byte_ids[c]) for c in data[at : at + width])], score + v.unknown)

    walk(0, [], 0.0)
    return sorted(found, key=lambda x: -x[0])[:n]


@pytest.mark.parametrize("n", [1, 3, 4])
def test_equals_all_paths(n):
    v = load_vocabulary(PATH)
    for f in segment(pa.array(TEXTS), PATH, n):
        for d, text in enumerate(TEXTS, f.first):
            want = brute(v, text, n)
            got = [(f.scores[d, r], tuple(f.paths[r][0][f.paths[r][1][d] : f.paths[r][1][d + 1]].tolist())) for r in range(n) if f.scores[d, r] > -np.inf]
            assert np.allclose([g[0] for g in got], [w[0] for w in want], rtol=1e-12), text
            assert got[0][1] == want[0][1] and len({g[1] for g in got}) == len(got)
            scores = dict(map(reversed, brute(v, text, 10**6)))
            assert all(np.isclose(scores[ids], s, rtol=1e-12) for s, ids in got)


def test_heap_search_equals_side_by_side():
    v = load_vocabulary(PATH)
    for word in ("internationalisation", "a\nbé", "日本x", "qwertyuiop" * 9):
        cell = (" " + word).encode()
        flat, size, scores = pieces.search_cells(v, np.frombuffer(cell, np.uint8), np.array([0, len(cell)]), 5)
        paths, totals = search_long(v, cell, 5)
        assert np.allclose(scores[0][: len(totals)], totals) and [*flat[: size[0]]] == paths[0]
        assert [len(p) for p in paths] == [s for s, t in zip(size, scores[0], strict=True) if t > -np.inf]


def test_operator_round_trip_nulls_long(spark):
    rows = [(1, "the cat"), (2, None), (2, ""), (None, "x  y"), (3, "ab" * 200_000 + " end"), (4, "日本\r\n\x00é" * 50)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, rank string")
    out = encode_nbest(docs, PATH, 3, with_ids=True)
    got = out.collect()
    assert all(r.decodes for r in got)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_pieces == len(r.ids) for r in got)
    assert sorted(r.rank for r in got if r.doc_id == 1) == [1, 2, 3] and sorted(r.rank for r in got if r.doc_id == 2) == [1, 1]
    back = {r.doc_id: r.text for r in decode_ids(out.where("rank = 1"), PATH).collect() if r.doc_id != 2}
    assert back == {i: t for i, t in rows if i != 2}
    assert encode_nbest(docs.where("false"), PATH).count() == 0


def test_vocabularies_that_cross_cells_are_refused(monkeypatch):
    import sentencepiece

    class Model:
        def __init__(self, model_file):
            pass

        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "▁of▁the"

        get_score = is_byte = is_control = is_unknown = is_unused = lambda self, i: 0

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    with pytest.raises(ValueError, match="of▁the"):
        pieces.load_vocabulary("no such file")
