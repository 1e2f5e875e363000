"""Part codes (op11) and hard negatives (op13) against plain loops."""

import hashlib
import math
from collections import defaultdict

import numpy as np

from pyspark.sql import functions as F

from spendloom.llm import ball_trees, part_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, rank int"


def made(n, dims, seed, spread=0.3):
    rnd = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rnd.normal(0, spread, dims)], int(rnd.integers(0, 4))) for i in range(n)]


ODD = [(900, None, 1), (901, [0.1, None] + [0.0] * 6, 1), (902, [math.nan] * 8, 1), (903, [math.inf] * 8, 1), (904, [0.5] * 8, None), (905, [0.5] * 8, None), (None, [0.25] * 8, 2)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


def fits(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if fits(v)]
    width = -(-max(len(q) for _, q in kept) // parts) * parts
    kept = sorted(((i, q + [0] * (width - len(q))) for i, q in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = width // parts
    cut = [[q[p * size : (p + 1) * size] for p in range(parts)] for _, q in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for c in cut:
                of[best(p, c[p])[1]].append(c[p])
            for k, xs in of.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    out = []
    for (i, _), c in zip(kept, cut):
        found = [best(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return sorted(out, key=str), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_codes_equal_plain_loops(spark):
    cases = [made(90, 8, 1), made(90, 8, 1) + ODD + [(5, [0.5] * 8, 1), (5, [0.5] * 8, 1)], made(7, 8, 2) + ODD, made(40, 6, 3) + [(300, [], 1), (301, [0.1], 2)], [(i, [0.5] * 8, 1) for i in range(80)]]
    for rows in cases:
        coded, books = part_codes.compress(frame(spark, rows), parts=4, entries=16, rounds=2)
        want, digest = plain_codes(rows, 4, 16, 2)
        assert sorted(((r["vec_id"], r["code"], r["error"]) for r in coded.collect()), key=str) == want
        assert part_codes.digest(books) == digest


def test_codes_do_not_depend_on_blocks(spark):
    rows = part_codes.integers(frame(spark, made(200, 8, 4)).repartition(7))
    first = part_codes.first_books(rows, 8, 4, 16)
    for size in (3, 64, 10_000):
        books = part_codes.learn(part_codes.blocks(rows, 8, 200, size), first)
        assert part_codes.digest(books) == plain_codes(made(200, 8, 4), 4, 16, 2)[1]


def test_label_errors_and_edges(spark, tmp_path):
    rows = [(i, v * 8, lab) for i, v, lab in made(60, 8, 5)] + [(900, [0.5] * 64, None), (901, [0.25] * 64, None), (902, None, 3)]
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = part_codes.op11_part_codes(spark, str(tmp_path)).collect()
    want, digest = plain_codes(rows, 16, 64, 2)
    label = {i: lab for i, _, lab in rows}
    total = defaultdict(int)
    for i, _, e in want:
        total[label[i]] += e
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out), key=str) == sorted(((i, c, e, total[label[i]], digest) for i, c, e in want), key=str)
    none, books = part_codes.compress(frame(spark, rows).where("false"))
    assert none.collect() == [] and books.size == 0
    assert part_codes.compress(frame(spark, ODD[:4]))[0].collect() == []


def test_books_move_down_and_unused_stay():
    books = np.array([[[0], [100], [7]]])
    sums, counts = np.array([[[-3], [205], [0]]]), np.array([[2, 2, 0]])
    assert part_codes.moved(books, (sums, counts)).tolist() == [[[-2], [102], [7]]]
    codes, least = part_codes.nearest(np.array([[4, 4, 60]]), np.array([[[0], [8], [60]]]))
    assert codes.tolist() == [[0, 0, 2]] and least.tolist() == [[16, 16, 0]]


def plain_negatives(rows, every, positives, negatives):
    kept = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and fits(v)]
    anchors = {}
    for i, lab, q in kept:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (lab, q)), (lab, q))
    out = []
    for a, (lab, q) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(q, v)), i, other) for i, other, v in kept if len(v) == len(q)]
        for s, p, _ in sorted(x for x in scored if x[2] == lab and x[1] != a)[:positives]:
            found = sorted(x for x in scored if x[2] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s)[:negatives]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(found, 1)]
    return sorted(out)


def test_hard_negatives_equal_plain_loops(spark):
    copies = [(1000 + i, [0.5] * 8, i % 3) for i in range(300)]
    cases = [made(300, 8, 6), made(40, 8, 7) + copies + ODD, made(60, 8, 8) + [(10, [0.9] * 8, 2), (10, [0.1] * 8, 1), (20, [0.9] * 8, 0), (21, [0.9] * 8, 0), (30, [0.2] * 5, 1), (31, [0.2] * 5, 1), (32, [0.17] * 5, 2), (40, [], 1), (41, [], 1), (42, [], 2)]]
    for rows in cases:
        got = ball_trees.hard_negatives(part_codes.integers(frame(spark, rows)), F.col("vec_id") % 10 == 0)
        assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 10, 5, 5)
    assert ball_trees.hard_negatives(part_codes.integers(frame(spark, ODD).where("false")), F.lit(True)).collect() == []


def test_cells_do_not_change_results(spark):
    rows = part_codes.integers(frame(spark, made(400, 8, 9)).repartition(6)).dropna()
    tree = ball_trees.trees(rows, 50, 400, 8)
    asked = rows.where("vec_id % 4 = 0").withColumns({"low": F.array(F.lit(-(1 << 60))), "high": F.array(F.lit(900).cast("long"))})
    want = None
    for held, size in ((10_000, 256), (60, 3)):
        got = sorted(map(tuple, ball_trees.best_rows(tree, asked, 400, 100, True, 3, held, size).select("vec_id", "id", "score", "rank").collect()))
        assert want in (None, got) and len(got) > 200
        want = got


def test_branch_and_bound_prunes_and_is_exact():
    rnd = np.random.default_rng(10)
    centres = rnd.normal(0, 200, (20, 6))
    q = np.rint(centres[rnd.integers(0, 20, 4000)] + rnd.normal(0, 5, (4000, 6))).astype(np.int64)
    ids, labels = rnd.permutation(4000), rnd.integers(0, 3, 4000)
    tree = ball_trees.grown(ids, labels, q, 32)
    x = q[:50]
    for same in (True, False):
        w = ball_trees.Wanted(x, labels[:50], ids[:50], np.full(50, -20_000), np.full(50, 60_000), same, 4)
        search = ball_trees.Search(w)
        search.over(tree)
        for i in range(50):
            score = q @ x[i]
            fit = [(-s, j) for s, j, lab in zip(score.tolist(), ids.tolist(), labels.tolist()) if -20_000 <= s <= 60_000 and (lab == labels[i]) == same and (j != ids[i] or not same)]
            want = sorted(fit)[:4]
            assert [(-int(s), int(j)) for s, j in zip(search.score[i], search.id[i]) if s > ball_trees.NONE] == want
        assert search.leaves < 50 * 128 / 3  # of 128 leaves
    # One vector a thousand times over: ties go to the smallest ids and other balls are left out.
    tree = ball_trees.grown(np.arange(1000), np.ones(1000, np.int64), np.full((1000, 3), 5), 16)
    search = ball_trees.Search(ball_trees.Wanted(np.array([[1, 1, 1]]), np.array([1]), np.array([2]), np.array([-99]), np.array([99]), True, 3))
    search.over(tree)
    assert search.id.tolist() == [[0, 1, 3]] and search.leaves <= 64
