"""Distributions, ranks, exact tests and the gate against plain numbers."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from spendloom.functions import distributions as D
from spendloom.operators import quality, ranked
from spendloom.plans.prefix import running


def column(spark, f, *args):
    names = "abc"[: len(args[0])]
    rows = spark.createDataFrame([(i, *map(float, a)) for i, a in enumerate(args)], "i int, " + ", ".join(f"{n} double" for n in names))
    return [r[0] for r in rows.orderBy("i").select(f(*[F.col(n) for n in names])).collect()]


def close(got, want, error=1e-9):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w or abs(g - w) <= error * max(1, abs(w)), (g, w)


def test_normal(spark):
    zs = [-8, -3, -1, -0.1, 0, 0.5, 1.959963985, 4]
    close(column(spark, D.normal_cdf, *[(z,) for z in zs]), [0.5 * math.erfc(-z / math.sqrt(2)) for z in zs], 2e-7)
    ps = [0.5, 0.975, 0.01, 0.999, 1e-6, 0.02425, 0.97575, 0.8, 1e-12]
    close(column(spark, D.normal_quantile, *[(p,) for p in ps]), [statistics.NormalDist().inv_cdf(p) for p in ps], 2e-9)
    assert column(spark, D.normal_quantile, (0,), (1,), (-1,), (2,)) == [-math.inf, math.inf, -math.inf, math.inf]


def test_gamma(spark):
    xs = [0.1, 0.5, 1, 1.5, 2, 10, 25.5, 170, 1000]
    close(column(spark, D.log_gamma, *[(x,) for x in xs]), [math.lgamma(x) for x in xs], 1e-12)
    # Whole shapes: sums of Poisson terms; a half: erfc.
    pairs = [(s, x) for s in (1, 2, 5, 30) for x in (0.01, 0.9, 2, 6.5, 29, 31, 80)]
    close(column(spark, D.gamma_q, *pairs), [sum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(s)) for s, x in pairs], 1e-11)
    chi = [0.001, 0.5, 1, 3.841458820694124, 10, 40]
    close(column(spark, D.chi_square_sf, *[(x, 1) for x in chi]), [math.erfc(math.sqrt(x / 2)) for x in chi], 1e-11)
    assert column(spark, D.chi_square_sf, (0, 1), (-3, 2)) == [1.0, 1.0]


def test_binomial(spark):
    pairs = [(k, n) for n in (0, 1, 2, 7, 24, 60) for k in range(n + 1)]
    want = [min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n) if n else 1.0 for k, n in pairs]
    close(column(spark, D.binomial_two_sided, *pairs), want, 1e-11)


def test_mcnemar(spark):
    rows = [(0, 0), (1, 0), (12, 12), (3, 21), (5, 20), (40, 20), (100, 100)]
    got = spark.createDataFrame(rows, "b long, c long").select("b", "c", quality.mcnemar(F.col("b"), F.col("c")).alias("t")).select("b", "c", "t.*").collect()
    for r in got:
        n, low = r.b + r.c, min(r.b, r.c)
        assert r.exact == (n < 25)
        if n < 25:
            want = min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n) if n else 1.0
            assert r.statistic == low and abs(r.p - want) < 1e-11
        else:
            chi2 = (abs(r.b - r.c) - 1) ** 2 / n
            assert abs(r.statistic - chi2) < 1e-12 and abs(r.p - math.erfc(math.sqrt(chi2 / 2))) < 1e-11


def plain_ranks(values):
    out = {}
    for v in values:
        less, same = sum(x < v for x in values), sum(x == v for x in values)
        out[v] = (less + (same + 1) / 2, same)
    return out


def test_ranks_and_running_totals(spark):
    rnd = random.Random(1)
    values = [rnd.choice([0.0, 1.5, rnd.randint(0, 30) * 1.0]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    assert {r.v: (r["rank"], r.ties) for r in ranked.average_ranks(df, "v").collect()} == plain_ranks(values)
    ids = spark.createDataFrame([(i, i % 7) for i in range(100)], "i long, x long").repartition(9)
    got = running(ids, [F.col("i")], {"total": (F.sum, "x"), "top": (F.max, "x")}).orderBy("i").collect()
    for r in got:
        before = [j % 7 for j in range(r.i)]
        assert (r.total, r.top) == ((sum(before), max(before)) if before else (None, None))
    assert running(ids.where("false"), [F.col("i")], {"total": (F.sum, "x")}).collect() == []


@pytest.mark.parametrize("alternative", ["two-sided", "greater", "less"])
def test_wilcoxon(spark, alternative):
    rnd = random.Random(2)
    for d in ([], [0, 0], [1.0], [rnd.randint(-6, 8) for _ in range(80)], [rnd.uniform(-2, 1) for _ in range(41)]):
        df = spark.createDataFrame([(float(x),) for x in d] + [(None,)], "d double")
        got = ranked.wilcoxon(ranked.signed_ranks(df), alternative).first()
        some = [abs(x) for x in d if x]
        if not some:
            assert (got.n, got.statistic, got.p) == (0, 0, 1)
            continue
        rank, n = plain_ranks(some), len(some)
        plus, minus = (sum(rank[abs(x)][0] for x in d if x * s > 0) for s in (1, -1))
        var = n * (n + 1) * (2 * n + 1) / 24 - sum(t**3 - t for t in {v: t for v, (_, t) in rank.items()}.values()) / 48
        mean = n * (n + 1) / 4
        cdf = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
        if alternative == "two-sided":
            z = (abs(min(plus, minus) - mean) - 0.5) / math.sqrt(var)
            want = min(1, 2 * (1 - cdf(abs(z))))
        else:
            z = (plus - mean + (0.5 if plus < mean else -0.5)) / math.sqrt(var)
            want = 1 - cdf(z) if alternative == "greater" else cdf(z)
        assert got.statistic == (min(plus, minus) if alternative == "two-sided" else plus) and abs(got.p - want) < 1e-6


def test_pareto(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 12), rnd.randint(0, 12)) for i in range(120)] + [(900, None, 3), (901, 3, None)]
    got = ranked.pareto(spark.createDataFrame(rows, "id long, cost long, quality long"), "cost", "quality").collect()
    fit = [r for r in rows if None not in r]
    best = {r[0] for r in fit if not any(o[1] <= r[1] and o[2] >= r[2] and o[1:] != r[1:] for o in fit)}
    assert {r.id for r in got} == best


@pytest.mark.parametrize("seed", range(5))
def test_greedy(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randint(0, 5), i, rnd.choice([None, 0, rnd.randint(1, 60), rnd.randint(1, 9)])) for i in range(rnd.choice([0, 1, 90]))]
    df = spark.createDataFrame(rows, "a int, id long, tokens int")
    for budget in (0, 25, 170, 10_000):
        used, want = 0, {}
        for a, i, t in sorted(rows, key=lambda r: r[:2]):
            fits = used + (t or 0) <= budget
            used += (t or 0) * fits
            want[i] = (fits, used)
        assert {r.id: (r.included, r.running) for r in ranked.greedy(df, ["a", "id"], "tokens", budget).collect()} == want


PAIRS = "control_accepted boolean, control_distance double, control_passed boolean, treatment_accepted boolean, treatment_distance double, treatment_passed boolean"


def test_gate(spark):
    def go(rows):
        return {r.metric: r for r in quality.gate(spark.createDataFrame(rows, PAIRS)).collect()}

    same = [(True, 1.0 + i, True, True, 1.0 + i, True) for i in range(50)]
    got = go(same)  # no spread: the margin is kept; no differences
    assert all(r.non_inferior and r.passed for r in got.values()) and got["acceptance_rate"].statistic == math.inf
    worse = go(same + [(True, 1.0, True, True, 5.0 + i, True) for i in range(30)])
    assert not worse["edit_distance"].non_inferior and worse["acceptance_rate"].non_inferior and not worse["edit_distance"].passed
    untested = go([(True, 1.0, None, True, 1.0, True)] * 9)
    assert untested["test_pass_rate"].n == 0 and untested["test_pass_rate"].p == 1 and not untested["test_pass_rate"].non_inferior
    lost = go(same[:30] + [(True, 1.0, True, False, 1.0, False)] * 20 + [(None, None, True, True, 1.0, True)] * 3)
    r = lost["acceptance_rate"]
    pt, pc, n = 33 / 53, 50 / 53, 53
    z = (pt - pc + 0.01) / math.sqrt(pt * (1 - pt) / n + pc * (1 - pc) / n)
    assert abs(r.statistic - z) < 1e-9 and not r.non_inferior and lost["edit_distance"].n == 30
    none = go([])
    assert len(none) == 3 and not any(r.passed for r in none.values())
