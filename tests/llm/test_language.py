"""PPM language ID (op5): code lengths against a plain recursion, held-out accuracy, edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spendloom.llm import language as L


def plain_bits(text, train, order=L.ORDER):
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        s = b" " * order + t.encode()
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[k][s[i - k : i]][s[i]] += 1
    s = b" " * order + text.encode()

    def cost(i, k):
        if k < 0:
            return 8.0
        c = seen[k].get(s[i - k : i])
        if not c:
            return cost(i, k - 1)
        total = sum(c.values()) + len(c)
        return math.log2(total / c[s[i]]) if s[i] in c else math.log2(total / len(c)) + cost(i, k - 1)

    return sum(cost(i, order) for i in range(order, len(s)))


def test_code_lengths(spark, monkeypatch):
    rnd = random.Random(5)
    texts = {k: ["".join(rnd.choice(k + " é漢") for _ in range(60)) for _ in range(5)] for k in ("abcd", "cdef", "efgh")}
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate((k, t) for k in texts for t in texts[k])], "doc_id long, text string, lang string")
    model = L.train(docs)
    tests = ["abc dcba", "", "fedc é zz Z9", "x" * 30, "ab漢 é字", " "]
    got = L.code_lengths(tests, model)
    for i, t in enumerate(tests):
        for j, k in enumerate(model.languages):
            assert abs(got[i, j] / L.UNIT - plain_bits(t, texts[k])) < 0.001 * (len(t) + 1) * 8
    monkeypatch.setattr(L, "GROUP", 1)  # the groups don't matter
    assert (L.code_lengths(tests, L.train(docs)) == got).all()


def test_index():
    rnd = np.random.default_rng(2)
    held = np.unique(rnd.integers(0, 1 << 40, 5000))
    wanted = np.concatenate([held, rnd.integers(0, 1 << 40, 5000)])
    at = {k: i for i, k in enumerate(held.tolist())}
    assert L.Index(held).find(wanted).tolist() == [at.get(k, -1) for k in wanted.tolist()]
    assert L.Index(held[:0]).find(wanted[:3]).tolist() == [-1] * 3


def test_all_grams_of_the_sample_count(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abc abc abc xyz", "a"), (2, "q r s t u", "b")], "doc_id long, text string, lang string")
    model = L.train(docs)
    assert L.code_lengths(["abc"], model)[0, 0] < L.code_lengths(["xyz"], model)[0, 0] < L.code_lengths(["pno"], model)[0, 0]
    monkeypatch.setattr(L, "MOST_GRAMS", 10)
    with pytest.raises(ValueError, match="sample_docs"):
        L.train(docs)


def test_blocks_equal_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.train(docs.limit(60))
    texts = [r.text for r in docs.limit(40).collect()] + ["", "a" * 400_000]
    whole = L.code_lengths(texts, model)
    assert (np.vstack([L.code_lengths([t], model) for t in texts]) == whole).all()


def test_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in L.op5_ppm_language(spark, sf_dir).collect()}
    want = {r.doc_id: r for r in docs.collect()}
    assert got.keys() == want.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert held and sum(got[i].lang_pred == want[i].lang for i in held) / len(held) > 0.97


def test_edges(spark):
    rows = [(None, None, "en", "x"), (1, "", None, "y"), (2, "123 ... 😀", "de", "y"), (3, "the the the", "en", "z"), (3, "the the the", "en", "z"), (4, "der die das", "de", "z"), (5, "ohne", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = L.train(docs)
    got = L.predict(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    by = {r.text: r for r in got.collect()}
    assert by[None].lang_pred == by[""].lang_pred == by["123 ... 😀"].lang_pred == "und"
    assert by["the the the"].lang_pred == "en" and by["der die das"].lang_pred == "de"
    empty = L.train(docs.where("false"))
    assert {r.lang_pred for r in L.predict(docs, empty).collect()} == {"und"}
    assert L.predict(docs.where("false"), model).collect() == []
