"""MinHash near-dedup with odd sketches (op8) against all pairs."""

import random
import re

import numpy as np
import pytest

from spendloom.llm import near_dedup as N


def plain_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                c = len(sets[i] & sets[j])
                if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                    root[find(i)] = find(j)
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp[find(i)] = min(comp.get(find(i), d), d)
    return sorted((d, len(sets[i]), comp[find(i)], d == comp[find(i)]) for i, (d, _) in enumerate(rows))


def family(rnd, n, words=120, drift=False):
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rnd.randrange(0, 4)):
            t[rnd.randrange(words)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(t))
        if drift:
            base = t
    return out


def test_shingles():
    texts = ["", None, "a", "A b\tc\nd", "a b c d e f a b c d e f", "É é A", "  lead  trail  ", "x" * 100, "a b c d e f"]
    for t, s in zip(texts, N.shingle_sets(texts)):
        assert len(s) == len(plain_set(t))
    a, b = N.shingle_sets(["One TWO three four five", "one two three\nfour\x0bfive"])
    assert (a == b).all()
    long = " ".join(f"w{i % 977}" for i in range(400_000))
    assert (N.shingle_sets([long])[0] == np.unique(np.concatenate(N.shingle_sets([long[:100], long])[1:]))).all()


def test_estimate():
    rnd = np.random.default_rng(3)
    for share in (0.5, 0.7, 0.85, 0.95):
        got = []
        for _ in range(60):
            x = rnd.integers(0, 1 << 64, 1000, dtype=np.uint64)
            y = np.concatenate([x[: int(2000 * share / (1 + share))], rnd.integers(0, 1 << 64, 1000 - int(2000 * share / (1 + share)), dtype=np.uint64)])
            p, q = (N.odd_sketch(N.minhash(np.unique(v))).view(np.uint64) for v in (x, y))
            got.append(N.estimate(int(np.bitwise_count(p ^ q).sum())))
        assert abs(np.mean(got) - share) < 0.03


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string")
    return sorted(tuple(r) for r in N.link_components(docs).drop("row").collect())


def test_against_all_pairs(spark, monkeypatch):
    rnd = random.Random(7)
    texts = family(rnd, 25) + family(rnd, 25, drift=True) + family(rnd, 12, words=30) + [f"short {i % 3}" for i in range(7)] + [None, "", "\n", "one", "one"] + family(rnd, 2, words=9)
    rnd.shuffle(texts)
    rows = list(zip(rnd.sample(range(1000), len(texts)), texts))
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(N, "ROUNDS", 0)  # everything in blocks
    monkeypatch.setattr(N, "MEMBERS", 8)
    assert run(spark, rows) == want


def test_bounds_follow_threshold():
    assert (N.band_count(85), N.floor(85)) == (24, 0.695) and (N.band_count(80), N.floor(80)) == (34, 0.626)
    for threshold in (75, 80, 85, 95):
        t, most = threshold / 100, N.most_differing(threshold)
        assert (1 - t**N.ROWS) ** N.band_count(threshold) <= N.MISS
        assert N.estimate(most) >= N.floor(threshold) > N.estimate(most + 1)
        assert (t - N.floor(threshold)) / (t * (1 - t) / N.SAMPLES) ** 0.5 >= 6
    with pytest.raises(ValueError):
        N.band_count(50)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, None), (1, "a b"), (2, "A  b")]) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    got = N.link_components(spark.createDataFrame([(None, "x y"), (4, "x y"), (4, "x y"), (None, "z")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 4, False), (4, 4, True), (4, 4, True)]


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in N.op8_minhash_odd_sketch(spark, sf_dir).collect()) == brute([tuple(r) for r in docs])
