import itertools
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from temporalis.llm.langid import _SCRIPT, BITS, CHUNK, NOT_A_CANDIDATE, SWITCH, held_out, predict_languages, train_languages, viterbi

WORDS = {"aa": "tha the thing with wren that then".split(), "bb": "qué ción nño ñandú ario oso".split(), "cc": "это слово речь дом".split()}


def path_score(scores, labels):
    return sum(s[j] for s, j in zip(scores, labels, strict=True)) - SWITCH * sum(a != b for a, b in itertools.pairwise(labels))


def test_viterbi_is_exact():
    r = np.random.default_rng(2)
    sizes = [0, 1, 5, 0, 6, 4]
    scores = r.normal(0, 12, (sum(sizes), 3))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    got = viterbi(scores, bounds)
    for d, n in enumerate(sizes):
        own = scores[bounds[d] : bounds[d + 1]]
        if n:
            best = max(path_score(own, p) for p in itertools.product(range(3), repeat=n))
            assert abs(path_score(own, got[bounds[d] : bounds[d + 1]]) - best) < 1e-9


def test_viterbi_over_chunks_equals_one_pass():
    r = np.random.default_rng(3)
    n = 3 * CHUNK + 17
    scores = np.repeat(r.normal(0, 3, (n // 40 + 1, 4)), 40, axis=0)[:n] + r.normal(0, 6, (n, 4))
    best, back = scores[0].copy(), []
    for t in range(1, n):
        jump = best.max() - SWITCH
        back.append(np.where(best >= jump, np.arange(4), best.argmax()))
        best = np.maximum(best, jump) + scores[t]
    got = viterbi(scores, np.array([0, n]))
    assert abs(path_score(scores, got) - best.max()) < 1e-6 and len(set(got)) > 1


def test_held_out_accuracy_mixed_nulls(spark):
    r = np.random.default_rng(0)
    rows = [(i, " ".join(r.choice(WORDS[g], 30)), g) for i in range(240) for g in [list(WORDS)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_languages(docs)
    assert model.langs == ["aa", "bb", "cc"]
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "12 34 -- ²", None), (1003, "的" * 5, None), (None, "the thing that", None), (1004, " ".join(WORDS["aa"] * 9 + WORDS["bb"] * 5), "cc")]
    got = predict_languages(spark.createDataFrame(rows + odd + rows[:1], "doc_id long, text string, lang string").withColumn("score", F.lit("x")), model).collect()
    assert len(got) == 247
    by = {x.doc_id: x for x in got}
    test = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert test and all(by[i].held_out for i, _ in test)
    assert np.mean([by[i].lang_pred == g for i, g in test]) > 0.97
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by[1004].lang_pred == "aa" and by[1004].n_spans == 2 and 0.5 < by[1004].score < 1
    assert by[None].held_out is False and by[1003].lang_pred in model.langs
    none = train_languages(docs.where("false"))
    assert {r.lang_pred for r in predict_languages(docs, none).collect()} == {"und"}
    assert docs.where(held_out()).count() == len(test)


def brute(text, model):
    """Language and share of a text, word by word, with one pass of Viterbi over lists."""
    words = [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())]
    if not re.search(r"[^\W\d_]", text or ""):
        return "und", 0.0
    k = range(len(model.langs))
    scores = []
    for w in words:
        p = b"  " + w + b" "
        at = [(((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> (32 - BITS) for a, b, c in zip(p, p[1:], p[2:], strict=False)]
        scores.append([sum(float(model.table[i, j]) for i in at) + (0 if model.scripts[_SCRIPT[w[0]], j] else NOT_A_CANDIDATE) for j in k])
    best, back = scores[0], []
    for s in scores[1:]:
        top = max(k, key=lambda j: best[j])
        back.append([j if best[j] >= best[top] - SWITCH else top for j in k])
        best = [max(best[j], best[top] - SWITCH) + s[j] for j in k]
    labels = [max(k, key=lambda j: best[j])]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    letters = [sum(len(w) for w, j in zip(words, reversed(labels), strict=True) if j == i) for i in k]
    main = max(k, key=lambda j: letters[j])
    return model.langs[main], letters[main] / sum(letters)


def test_whole_query_equals_brute_force(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choices(WORDS[g], k=30)), g) for i in range(120) for g in [list(WORDS)[i % 3]]]
    model = train_languages(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    mixed = []
    for i in range(150):
        runs = [" ".join(r.choices(WORDS[r.choice(list(WORDS))], k=r.randint(0, 25))) for _ in range(r.randint(0, 6))]
        mixed.append((i, r.choice([" ", ". ", " 12 — "]).join(runs).title() if r.random() < 0.3 else "\n".join(runs)))
    mixed.append((900, " ".join(r.choices(WORDS["aa"] + WORDS["bb"], k=60_000))))
    mixed += [(901, "x" * 2_000_000), (902, None), (903, "7" * 2_000_000)]
    got = {x.doc_id: (x.lang_pred, x.score) for x in predict_languages(spark.createDataFrame([(*x, None) for x in mixed], "doc_id long, text string, lang string"), model).collect()}
    assert len(got) == len(mixed)
    for i, text in mixed:
        lang, share = brute(text, model)
        assert got[i][0] == lang and abs(got[i][1] - share) < 1e-3, (i, got[i], lang, share)
