"""Bit-sliced top-k (op7) against brute force."""

import math

import numpy as np

from spendloom.llm import bsi


def test_digits():
    for v in range(-70, 71):
        ds = bsi.digits(v)
        assert sum(s << i for s, i in ds) == v and all(b[1] - a[1] > 1 for a, b in zip(ds, ds[1:]))


def test_sums_and_selection():
    rnd = np.random.default_rng(1)
    for rows, dims, top in ((1, 1, 1), (63, 5, 3), (300, 64, 20), (130, 7, 900), (200, 3, 2)):
        x = rnd.integers(-top, top + 1, (rows, dims))
        index = bsi.slices_of(x)
        every = np.packbits(np.arange(index[0].shape[1] * 64) < rows, bitorder="little").view(np.uint64)
        for q in [*rnd.integers(-top, top + 1, (6, dims)), np.zeros(dims, np.int64)]:
            want = x @ q
            for k in (1, 5, rows, rows + 9):
                got, score = bsi.top_rows(bsi.add_up(index, q), every, k)
                best = np.lexsort((np.arange(rows), -want))[:k]
                assert got.tolist() == best.tolist() and score.tolist() == want[best].tolist()


def brute(rows, k):
    out = set()
    fit = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for i, q in {i: q for i, q in fit if i % 20 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fit if j != i and len(v) == len(q))[:k]
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


def test_edges(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.normal(size=6).tolist()) for i in range(70)] + [(100 + i, [0.5] * 6) for i in range(40)]
    rows += [(200, None), (220, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (240, [math.nan] * 6), (260, [math.inf] * 6), (280, []), (None, [0.1] * 6), (300, [0.0] * 6), (320, [-3.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    for block in (16, 65_536):
        got = {tuple(r) for r in bsi.search(df, df.where("vec_id % 20 = 0"), block=block, query_block=4).collect()}
        assert got == brute(rows, 20)
    few = df.where("vec_id < 10")
    assert {tuple(r) for r in bsi.search(few, few.where("vec_id % 20 = 0")).collect()} == brute([r for r in rows if r[0] is not None and r[0] < 10], 20)
    assert bsi.search(df.where("false"), df.where("false")).collect() == []
