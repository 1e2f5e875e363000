"""Line diffs against plain dynamic programming and round trips; counters of tokens."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendloom.functions import tokens
from spendloom.operators import line_diff as D


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def edited(rnd, lines):
    out = []
    for x in lines:
        r = rnd.random()
        out += [] if r < 0.15 else [x, rnd.choice("pqr")] if r < 0.3 else [rnd.choice("pqr")] if r < 0.4 else [x]
    return out


def texts(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        a = [rnd.choice("abcdefgh") * rnd.randint(0, 2) for _ in range(rnd.randint(0, 25))]
        b = edited(rnd, a) if rnd.random() < 0.8 else [rnd.choice("abcx") for _ in range(rnd.randint(0, 9))]
        yield "\n".join(a) + "\n" * rnd.randint(0, 1), "\n".join(b) + "\n" * rnd.randint(0, 1)


@pytest.mark.parametrize("cells", [D.MAX_CELLS, 30, 0])
def test_round_trip_and_longest(cells):
    for old, new in [*texts(1, 400), ("", ""), ("", "a"), ("a", ""), ("a\n", "a"), ("\n", "\n\n"), ("a\r\nb", "a\r\nc\r\n"), ("\\ No newline at end of file\n", "-x\n+y"), ("@@ -1,1 +1,1 @@\n", "@@\n")]:
        a, b = D.lines_of(old), D.lines_of(new)
        assert "".join(a) == old and "".join(b) == new
        kept, exact = D.matched(a, b, cells)
        assert all(a[i] == b[j] for i, j in kept) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(kept, kept[1:]))
        assert len(kept) == longest(a, b) if exact else len(kept) <= longest(a, b)
        for context in (0, 1, 3):
            diff = D.unified(a, b, kept, context)
            assert D.applied(old, diff) == new
            assert (diff == "") == (old == new or kept == [(i, i) for i in range(max(len(a), len(b)))])


def test_hunks_are_those_of_a_unified_diff():
    a = [f"{i}\n" for i in range(40)]
    b = a[:5] + ["new\n"] + a[5:12] + a[13:30] + ["x\n"] + a[31:]
    got = D.unified(a, b, D.matched(a, b)[0])
    want = "".join(x for x in difflib.unified_diff(a, b, n=3) if not x.startswith(("---", "+++")))
    assert [x for x in D.lines_of(got) if x[0] != "@"] == [x for x in D.lines_of(want) if x[0] != "@"]
    assert got.count("@@ -") == want.count("@@ -") == 3


def test_a_diff_that_does_not_fit():
    diff = D.unified(["a\n", "b\n"], ["a\n", "c\n"], [(0, 0)])
    assert D.applied("a\nb\n", diff) == "a\nc\n"
    for text, d in (("a\nx\n", diff), ("", diff), ("a\nb\n", diff + "junk"), ("a\nb\n", diff[:-2]), ("a\nb\n", "hello")):
        assert D.applied(text, d) is None


def test_large_files_stay_bounded():
    rnd = random.Random(3)
    a = [f"line {i}\n" if i % 3 else "same\n" for i in range(20_000)]
    b = [x for x in a if rnd.random() > 0.02]
    kept, exact = D.matched(a, b, 10_000)
    assert not exact and len(kept) > 0.95 * len(b)
    assert D.applied("".join(a), D.unified(a, b, kept)) == "".join(b)


def test_anchors():
    x = np.array([1, 2, 3, 4, 5, 5, 6])
    assert D.anchors(x, np.array([3, 1, 2, 4, 5, 6, 6])) == [(0, 1), (1, 2), (3, 3)]
    assert D.anchors(x, np.array([9])) == []


def test_choices(spark):
    long = "".join(f"line number {i}\n" for i in range(100))
    rows = [("same", long, long), ("one", long, long.replace("number 50\n", "number fifty\n")), ("other", long, "".join(f"another {i}\n" for i in range(100))), ("short", "a\nb\nc\n", "a\nb\nd\n"), ("none", None, "x"), ("gone", long, None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "id string, old string, new string, kept int")
    got = {r.id: r for r in D.choices(D.diffs(df, "old", "new")).collect()}
    assert {k: (r.choice, r.reason) for k, r in got.items()} == {"same": ("rewrite", "identical"), "one": ("diff", "cheaper"), "other": ("rewrite", "mostly changed"), "short": ("rewrite", "not smaller"), "none": ("rewrite", "mostly changed"), "gone": ("rewrite", "mostly changed")}
    one = got["one"]
    assert one.kept == 99 and one.verified and one.saved_tokens == one.rewrite_tokens - one.diff_tokens == tokens.quarter(rows[1][2]) - tokens.quarter(one["diff"])
    assert {r.reason for r in D.choices(D.diffs(df.where("id = 'other'"), "old", "new", max_cells=9)).collect()} == {"too large"}
    assert D.diffs(df.where("false"), "old", "new").collect() == []


def test_documents_choose(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text is not None}
    got = D.f40_diff_or_rewrite(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got[:150]:
        lines = docs[r.doc_id].split("\n")
        new = "\n".join(x + "\n" + x if i % 11 == 10 else x for i, x in enumerate(lines) if i % 7 != 6)
        a, b = D.lines_of(docs[r.doc_id]), D.lines_of(new)
        assert r.kept == longest(a, b) if len(a) < 60 else True
        assert (r.removed, r.added, r.rewrite_tokens) == (len(a) - r.kept, len(b) - r.kept, tokens.quarter(new))
    assert {r.choice for r in got} == {"diff", "rewrite"}


def test_exact_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    exact = tokens.Exact(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = ["hello world", "", None, "été 123"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(tokens.counted(F.col("t"), exact)).collect()]
    assert got == [None if t is None else exact(t) for t in rows] and got[0] == 2
    assert (tokens.quarter("abcde"), tokens.third("abcd")) == (2, 2)
    pair = spark.createDataFrame([("a b\n", "a c\n")], "old string, new string")
    assert D.diffs(pair, "old", "new", tokens=exact).first().rewrite_tokens == exact("a c\n")
