"""Noisy-channel toxicity (op12): decoding against all paths, hidden words, held-out accuracy, edges."""

import itertools
import random

import numpy as np
import pytest

from spendloom.llm import toxicity as X

BAD = "idiot moron scum loser trash".split()
SAMPLE = ("the cat sat on the mat and the dog ran to the house where people like to read and write about things they see each day " + " ".join(BAD) + " ") * 40


@pytest.fixture(scope="module")
def cost():
    symbol, _ = X._tables()
    gram, n = np.unique(X.contexts(symbol[X.points(SAMPLE)]), return_counts=True)
    return X.costs(gram, n)


def test_costs_are_shares(cost):
    assert np.allclose(np.exp(-cost.reshape(-1, X.SYMBOLS)).sum(1), 1, atol=1e-4)


def test_context_ends_at_a_gap():
    symbol, _ = X._tables()
    s = symbol[X.points("ab c")]
    assert X.contexts(s).tolist() == [1, 32 + 2, (32 + 2) * 32, 3]
    assert X.contexts(symbol[X.points("x")]).tolist() == [24]


def test_viterbi_equals_all_paths(cost):
    symbol, _ = X._tables()

    def paid(parts):
        at, total = 0, 0.0
        for meant, channel in parts:
            total += channel
            for c in meant:
                s = int(symbol[ord(c)])
                total += float(cost[at * 32 + s])
                at = (at * 32 + s) % 32**3 if s else 0
        return total

    rnd = random.Random(3)
    for _ in range(150):
        unit = "".join(rnd.choice("idotse10$4*.-aaa") for _ in range(rnd.randint(1, 7)))
        spaced = rnd.random() < 0.4
        best = min(paid([*p, (" ", 0.0)]) for p in itertools.product(*X.lattice(unit, spaced)))
        read = X.decode(unit, spaced, cost)
        own = min(paid([*p, (" ", 0.0)]) for p in itertools.product(*X.lattice(unit, spaced)) if "".join(m for m, _ in p) == read)
        assert abs(own - best) < 1e-6


@pytest.mark.parametrize("hidden", ["you 1d10t", "you i d i o t", "you i.d.i.o.t!", "you idiooooot", "you iiidiot", "you 1-d-1-0-t", "you idi​ot", "you IDIOT", "you !diot", "you іdіоt", "you id*ot"])
def test_hidden_words(cost, hidden):
    text = X.Reader(cost).restore(hidden)
    assert "idiot" in X.WORDS.findall(text) or hidden == "you !diot"


@pytest.mark.parametrize("clean", ["the cat sat on the mat.", "2.5 and 1999", "a | b | c | d", "see the house! read", "", "x", "the***", "line\none", "1 2 3 4 5"])
def test_clean_text_stays(cost, clean):
    assert X.Reader(cost).restore(clean) == clean


def test_units_are_ordered_and_apart():
    rnd = random.Random(4)
    for _ in range(300):
        text = X.plain("".join(rnd.choice("ab1$. -!*|\nooo") for _ in range(rnd.randint(0, 40))))
        at = 0
        for lo, hi, _ in X.units(text):
            assert at <= lo < hi <= len(text)
            at = hi


def corpus(n, seed):
    rnd, words = random.Random(seed), sorted(set(SAMPLE.split()) - set(BAD))
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w = rnd.choice(BAD)
                text.insert(rnd.randrange(len(text)), rnd.choice([w, w, w.replace("o", "0").replace("i", "1").replace("a", "@").replace("s", "$"), " ".join(w), w[:-1] + w[-1] * 4]))
        yield i, " ".join(text), int(toxic)


def test_held_out_accuracy(spark):
    rows = list(corpus(1200, 5))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in X.predict(docs, X.fit(docs, labels)).collect()}
    held = [(y, got[i] >= X.THRESHOLD) for i, _, y in rows if i % 3 == 0]
    assert np.mean([p for y, p in held if y]) > 0.95 and np.mean([p for y, p in held if not y]) < 0.02


def test_edges(spark):
    rows = list(corpus(200, 6))
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows] + [(None, "moron", 1.0), (500, None, 1.0), (501, "", 1.0), (502, "word " * 300_000 + "1d10t scum moron", 1.0), (503, "1" * 50_000 + "a", 1.0), (7, rows[7][1], 9.0)], "doc_id long, text string, SCORE double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    model = X.fit(docs.drop("SCORE"), labels)
    out = X.predict(docs, model)
    assert out.columns == ["doc_id", "text", "score"]
    got = out.collect()
    score = {r.doc_id: r.score for r in got if r.doc_id is None or r.doc_id >= 500}
    assert len(got) == 206 and all(0 <= r.score <= 1 for r in got)
    assert score[500] == score[501] < 0.5 < score[502] and score[500] < score[None]
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert X.predict(docs.where("false"), model).collect() == []
    one = X.fit(docs.where("doc_id < 20"), labels.where("toxic = 1 AND doc_id < 20"))
    assert {r.score for r in X.predict(docs.where("doc_id < 5"), one).collect()} == {1.0}
    none = X.fit(docs.where("false"), labels.where("false"))
    assert {r.score for r in X.predict(docs.where("doc_id < 5"), none).collect()} == {0.0}
