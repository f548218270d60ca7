import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from temporalis.llm import counts, queries
from temporalis.llm.tokens import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
ODD = ["<s>", "</s>", "<unk>", "<0x0A>", "▁", "▁▁", "  ", " ", "\n", "\t", "\x00", "é", "　", "\U0001f602", "漢字", "the", "aaaa", "ing", "ﬁ", "\r\n"]


@pytest.fixture(scope="module")
def model():
    return counts.counter(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD) | st.text(max_size=6), max_size=20).map("".join), max_size=5), st.integers(1, 9), st.integers(1, 60))
def test_counts_of_cut_texts_equal_the_library(texts, piece, batch):
    c = counts.counter(PATH)
    size, tokens = c.counts(pa.array(texts, pa.string()), piece, batch)
    assert size.tolist() == [len(t.encode()) for t in texts]
    assert tokens.tolist() == [len(c.model.encode(t)) for t in texts]


def test_parts_are_the_text(model):
    r = random.Random(1)
    text = "".join(r.choice(ODD) for _ in range(3000))
    parts = list(model.parts(text, 10))
    assert len(parts) > 100 and parts[0] + "".join(p[1:] for p in parts[1:]) == text
    assert list(model.parts("a" * 500, 10)) == ["a" * 500]  # no safe boundary


def test_query_equals_the_library(spark, tmp_path, model):
    r = random.Random(2)
    long = " ".join("".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(1, 9))) for _ in range(60_000))
    texts = [None, "", " ", "hello world", "hello world", long, "漢字" * 60_000, "<s>x</s>", *(" ".join(r.choices(ODD, k=r.randint(0, 40))) for _ in range(60))]
    rows = [(i if i != 4 else None, t, "x", 1) for i, t in enumerate(texts)] + [(3, "hello world", "y", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, _part int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_token_counts(spark, str(tmp_path)).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(model.model.encode(t or "")), n > 4096) for i, t, *_ in rows]
    assert got == sorted(want, key=str) and sum(x[3] for x in got) == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert counts.token_counts(empty, PATH).collect() == []
