"""Envelopes with parents, verdicts, and the staged cost model on small tables worked out by hand and by plain loops."""

import json
import math
import random

import pytest

from spendloom.operators import budgets as B
from spendloom.operators import cost_model as C
from spendloom.sources.keyed import Folder

ENVELOPES = "envelope_id string, parent_id string, starts string, ends string, limit_usd double, soft double, hard double"


def envelopes(spark, *rows):
    return spark.createDataFrame([(i, p, "2024-01-01", "2024-02-01", limit, 0.75, 1.0) for i, p, limit in rows], ENVELOPES)


def test_charges_count_above_and_cycles_end(spark):
    e = envelopes(spark, ("dev", "team", 10.0), ("team", "firm", 100.0), ("firm", None, 1000.0), ("lost", "nobody", 5.0), ("x", "y", 1.0), ("y", "x", 1.0), ("self", "self", 1.0))
    got = {(r.envelope_id, r.up) for r in B.above(e).collect()}
    assert got == {("dev", "dev"), ("dev", "team"), ("dev", "firm"), ("team", "team"), ("team", "firm"), ("firm", "firm"), ("lost", "lost"), ("x", "x"), ("x", "y"), ("y", "y"), ("y", "x"), ("self", "self")}
    charges = spark.createDataFrame([("c1", "dev", "2024-01-02 00:00:00", 4.0), ("c2", "team", "2024-01-03 00:00:00", 2.0), ("c3", "none", "2024-01-03 00:00:00", 9.0)], "charge_id string, envelope_id string, ts string, cost double")
    rolled = {(r.charge_id, r.envelope_id, r.rolled_up_from) for r in B.rolled(charges, e).collect()}
    assert rolled == {("c1", "dev", None), ("c1#roll:team", "team", "dev"), ("c1#roll:firm", "firm", "dev"), ("c2", "team", None), ("c2#roll:firm", "firm", "team")}


def test_states(spark):
    e = envelopes(spark, ("a", None, 100.0), ("b", None, 50.0), ("c", None, 0.0))
    charges = spark.createDataFrame([("1", "a", "2023-12-31 23:59:59", 99.0), ("2", "a", "2024-01-01 00:00:00", 10.0), ("3", "a", "2024-01-10 12:00:00", 20.0), ("4", "a", "2024-01-12 00:00:00", 7.0), ("5", "a", None, 5.0), ("6", "a", "2024-01-05 00:00:00", None)], "charge_id string, envelope_id string, ts string, cost double")
    s = {r.envelope_id: r for r in B.states(e, charges, "2024-01-11 00:00:00").collect()}
    a = s["a"]
    assert (a.spent, a.remaining, a.spent_share, a.burn, a.days_left, a.expired) == (30.0, 70.0, 0.3, 20.0, 21.0, False)
    assert a.projected == 30 + 20 * 21 and str(a.exhausted_at) == "2024-01-14 12:00:00" and abs(a.elapsed_share - 10 / 31) < 1e-12
    assert (s["b"].spent, s["b"].burn, s["b"].exhausted_at, s["c"].spent_share) == (0.0, 0.0, None, 1.0)
    late = {r.envelope_id: r for r in B.states(e, charges, "2024-03-01 00:00:00").collect()}
    assert late["a"].expired and late["a"].days_left == 0 and late["a"].elapsed_share == 1
    assert {r.envelope_id: r for r in B.states(e, charges, "2023-06-01 00:00:00").collect()}["a"].burn == 0


def test_verdicts(spark):
    e = envelopes(spark, ("a", None, 100.0), ("b", None, 1000.0))
    charges = spark.createDataFrame([("1", "a", "2024-01-10 12:00:00", 60.0), ("2", "b", "2024-01-02 00:00:00", 1.0)], "charge_id string, envelope_id string, ts string, cost double")
    asked = spark.createDataFrame([(1, "a", 1.0, False), (2, "a", 15.0, False), (3, "a", 15.01, True), (4, "a", 40.0, False), (5, "a", 40.01, True), (6, "b", 1.0, False), (7, "b", 1.0, True), (8, "zz", 1.0, False)], "n int, envelope_id string, estimate double, approximate boolean")
    got = {r.n: (r.verdict, r.reason, r.warnings) for r in B.decided(asked, B.states(e, charges, "2024-01-11 00:00:00")).collect()}
    assert got == {
        1: ("warn", None, ["burn_rate"]), 2: ("warn", None, ["burn_rate"]), 3: ("warn", None, ["soft_cap", "burn_rate", "estimated_only"]), 4: ("warn", None, ["soft_cap", "burn_rate"]), 5: ("block", "hard_cap", []),
        6: ("allow", None, []), 7: ("warn", None, ["estimated_only"]), 8: ("block", "no_envelope", []),
    }
    over = B.decided(asked.where("n = 6"), B.states(e, charges, "2024-02-02 00:00:00")).first()
    assert (over.verdict, over.reason) == ("block", "expired")


def test_estimates(spark):
    prices = spark.createDataFrame([("m", 1.0, 10.0)], "model string, in_usd double, out_usd double")
    asked = spark.createDataFrame([(1, "m", 1000, 100), (2, "m", 1000, None), (3, "m", 10_000, None), (4, "zz", 1000, 0)], "n int, model string, tokens_in long, tokens_out long")
    got = {r.n: (round(r.estimate, 9), r.approximate, r.priced) for r in B.estimated(asked, prices, (2.0, 4.0)).collect()}
    assert got == {1: (0.002, False, True), 2: (0.006, True, True), 3: (0.04, True, True), 4: (0.002, False, False)}


SCHEMA = "task string, model string, hour int, repo string, tokens_in double, depth double, cost double"


def made(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        task, model, hour, repo = rnd.choice(["debug", "test", "odd"]), rnd.choice("mn"), rnd.randint(0, 23), rnd.choice(["r1", "r2", None])
        t, d = rnd.uniform(0, 50_000), float(rnd.randint(1, 30))
        yield task, model, hour, repo, t, d, 0.3 + 2e-5 * t + 0.02 * d + {"debug": 0.5, "test": -0.2, "odd": 0}[task] + (0.3 if model == "m" else 0) + (0.2 if hour == 9 else 0) + (0.1 if repo == "r1" else 0) + rnd.gauss(0, 0.05)


def plain(rows):
    n = len(rows)
    mean = lambda xs: sum(xs) / len(xs)
    slope = lambda i: sum((r[i] - mean([q[i] for q in rows])) * (r[6] - mean([q[6] for q in rows])) for r in rows) / sum((r[i] - mean([q[i] for q in rows])) ** 2 for r in rows)
    means = {i: mean([q[i] for q in rows]) for i in (4, 5, 6)}
    slope = lambda i: sum((r[i] - means[i]) * (r[6] - means[6]) for r in rows) / sum((r[i] - means[i]) ** 2 for r in rows)
    a, b = slope(4), slope(5)
    left = [r[6] - a * r[4] - b * r[5] for r in rows]
    coefs = {}
    for i, (kind, _, least) in enumerate(C.STAGES):
        for key in {r[i] for r in rows if r[i] is not None}:
            own = [x for x, r in zip(left, rows) if r[i] == key]
            if len(own) >= least:
                coefs[kind, str(key)] = mean(own)
        left = [x - (coefs.get((kind, str(r[i])), 0) if r[i] is not None else 0) for x, r in zip(left, rows)]
    c = mean(left)
    rest = [x - c for x in left]
    return c, a * 1000, b, coefs, mean([abs(x) for x in rest]), 1 - sum(x * x for x in rest) / sum((r[6] - means[6]) ** 2 for r in rows), n


def test_training_equals_plain_stages(spark, tmp_path):
    rows = list(made(1500, 1))
    odd = [(None, "m", 1, "r1", None, 1.0, 1.0), ("debug", "m", 1, "r1", 1.0, float("nan"), 1.0), ("debug", "m", 1, "r1", 1.0, 1.0, float("inf"))]
    model = C.train(spark.createDataFrame(rows + odd, SCHEMA))
    c, a, b, coefs, mae, r2, n = plain(rows)
    got = model.numbers
    for x, y in ((got.intercept, c), (got.context, a), (got.depth, b), (got.mae, mae), (got.r2, r2)):
        assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)
    held = {(r.kind, r.key): r.value for r in model.coefs.collect()}
    assert got.events == n and all(math.isclose(held[k], v, rel_tol=1e-8, abs_tol=1e-12) for k, v in coefs.items())
    assert set(held) - set(coefs) == {("task", "refactor"), ("task", "feature"), ("task", "unknown")}
    asked = spark.createDataFrame([("debug", "m", 9, "r1", 20_000.0, 5.0, 1), ("strange", "none", 99, None, 1000.0, 1.0, 2), (None, "n", 0, "r9", 0.0, -500.0, 3)], "task string, model string, hour int, repo string, tokens_in double, depth double, _value int")
    out = {r._value: r for r in C.predict(asked, model).collect()}
    value = c + 20 * a + 5 * b + sum(coefs[k] for k in (("task", "debug"), ("model", "m"), ("hour", "9"), ("repo", "r1")))
    cents = lambda x: math.floor(x * 100 + 0.5) / 100
    assert (out[1].predicted, out[1].low, out[1].high) == (cents(value), max(0.01, cents(value - 1.96 * mae)), cents(value + 1.96 * mae))
    assert out[2].predicted == cents(max(0.01, c + a + b + 0.05)) and out[3].predicted == 0.01 and out[1].confidence == min(0.95, max(0.3, r2 * 0.7 + 0.15))
    C.save(model, f"file://{tmp_path}/m")
    again = C.load(spark, f"file://{tmp_path}/m")
    assert again.numbers == model.numbers and sorted(map(tuple, again.coefs.collect())) == sorted(map(tuple, model.coefs.collect()))
    C.save(model, f"file://{tmp_path}/m")
    assert C.load(spark, f"file://{tmp_path}/m").numbers == model.numbers


def test_little_data(spark):
    few = C.train(spark.createDataFrame(list(made(50, 2)), SCHEMA))
    assert few.numbers == C.Numbers(**C.START, events=50) and {r.key: r.value for r in few.coefs.collect()} == C.TASKS
    asked = spark.createDataFrame([("debug", "m", 0, None, 1_000_000.0, 1.0), ("odd", "zz", 0, None, 1_000_000.0, 1.0)], "task string, model string, hour int, repo string, tokens_in double, depth double")
    prices = spark.createDataFrame([("m", 1.0, 5.0)], "model string, in_usd double, out_usd double")
    got = {r.task: r for r in C.predict(asked, few, prices).collect()}
    assert math.isclose(got["debug"].predicted, 2.0 * 1.3) and math.isclose(got["odd"].predicted, 4.5) and got["odd"].confidence == 0.1 and math.isclose(got["odd"].high, 13.5)
    assert C.train(spark.createDataFrame([], SCHEMA)).numbers.events == 0


def test_load_refuses(spark, tmp_path):
    model = C.train(spark.createDataFrame(list(made(120, 3)), SCHEMA))
    where = f"file://{tmp_path}/m"
    C.save(model, where)
    files = Folder(spark, where)
    held = json.loads(files.text("model.json"))

    def refused(match, **changes):
        files.put("model.json", json.dumps(held | changes), replace=True)
        with pytest.raises(ValueError, match=match):
            C.load(spark, where)

    refused("version", version=2)
    refused("version", schema="kind string")
    refused("numbers", numbers={"intercept": 1})
    refused("finite", numbers=held["numbers"] | {"mae": float("nan")})
    spark.createDataFrame([("task", "x", "1")], "kind string, key string, value string").write.parquet(f"{where}/other")
    refused("schema", coefs="other")
    spark.createDataFrame([("task", None, 1.0)], C.COEFS).write.parquet(f"{where}/holes")
    refused("missing", coefs="holes")
    files.put("model.json", json.dumps(held), replace=True)
    assert C.load(spark, where).numbers == model.numbers
