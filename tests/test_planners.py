"""Planners on small tables worked out by hand: ties, nulls, empty tables."""

import datetime as dt

from spendloom.operators import planners as P


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_recompression_takes_the_later_of_equal_starts_and_holds_without_savings(spark):
    schema = "k int, pos int, saved long, rebuild long, remaining int"
    df = spark.createDataFrame([(1, 0, 100, 50, 10), (1, 1, None, None, 10), (2, 0, 0, 5, 9), (3, 0, 40, 0, 0), (3, 1, 40, 0, 0)], schema)
    assert rows(P.recompression(df, ["k"], "pos")) == [(1, 0, 100, 50, 6.25, True), (2, None, 0, 0, None, False), (3, 1, 40, 0, 0.0, True)]
    assert rows(P.recompression(df.limit(0), ["k"], "pos")) == []


def test_delta_resend_edit_append_and_nothing_new(spark):
    schema = "k int, pos int, h string, t long"
    was = spark.createDataFrame([(1, 0, "a", 5), (1, 1, "b", 5), (1, 2, "c", 7), (2, 0, "a", 5), (3, 0, None, 5)], schema)
    now = spark.createDataFrame([(1, 0, "a", 5), (1, 1, "x", 6), (1, 2, "c", 7), (2, 0, "a", 5), (2, 1, "b", 9), (3, 0, None, 5), (4, 0, "n", None)], schema)
    got = [(r.k, r.diverged_at, r.surviving, r.rewritten, r.stranded, r.cacheable) for r in P.delta_resend(was, now, ["k"], "pos", "h", "t", 5, 3.0).orderBy("k").collect()]
    assert got == [(1, 1, 5, 13, 7, True), (2, 1, 5, 9, 0, True), (3, None, 5, 0, 0, True), (4, 0, 0, 0, 0, False)]


def test_breakpoints_restart_after_volatile_blocks_and_keep_the_longest(spark):
    df = spark.createDataFrame([(1, i, "s", 10, i == 2) for i in range(5)] + [(2, 0, "s", 10, None), (3, 0, "s", 3, False)], "k int, pos int, segment string, tokens long, volatile boolean")
    assert rows(P.breakpoints(df, ["k"], "pos", 10)) == [(1, 1, 20), (1, 4, 20)]
    assert rows(P.breakpoints(df, ["k"], "pos", 10, most=1)) == [(1, 4, 20)]


def test_breaker_opens_on_a_miss_and_closes_after_the_cooldown(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, i, t0 + dt.timedelta(hours=i), i != 11) for i in range(40)], "k int, id int, ts timestamp, ok boolean")
    got = {r.id: r.disabled for r in P.breaker(df, ["k"], ["ts", "id"], "ts", "ok").collect()}
    assert [i for i, d in got.items() if d] == list(range(11, 35))
    assert rows(P.breaker(df.limit(0), ["k"], ["ts", "id"], "ts", "ok")) == []


def test_relevance_of_equal_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, "alpha beta", "Alpha, beta!"), (2, "alpha", None), (3, "", "x"), (4, "alpha", "gamma")], "k int, a string, b string")
    assert rows(P.relevance(df, ["k"], "a", "b")) == [(1, 1.0, 2, "relevant"), (2, 0.5, 0, "peripheral"), (3, 0.5, 0, "peripheral"), (4, 0.0, 0, "noise")]


def test_route_takes_the_first_intent(spark):
    df = spark.createDataFrame([(1, "Rename x", 10, 0, False), (2, "Explain the race condition", 10, 0, None), (3, None, None, None, None), (4, "create it", 30000, 0, False), (5, "show me", 1, 0, True)], "k int, p string, t int, f int, e boolean")
    assert rows(P.route(df, "p", "t", "f", "e").select("k", "intent", "difficulty")) == [(1, "refactor", "trivial"), (2, "explain", "hard"), (3, "generate", "standard"), (4, "generate", "hard"), (5, "debug", "hard")]


def test_tab_audit_shares_absent_weights_out(spark):
    df = spark.createDataFrame([(1, 0, None, None, None, False, None), (2, None, None, None, None, None, None), (3, 9, None, 0.0, 10**6, False, True)], "k int, hops int, opened long, task_match double, tokens long, active boolean, dirty boolean")
    assert [(r.k, r.relevance, r.keep) for r in P.tab_audit(df, ["k"]).orderBy("k").collect()] == [(1, 1.0, True), (2, 0.0, False), (3, 0.005288, True)]


def test_recommend_needs_samples_and_tests(spark):
    arms = [("c", "base", True, True, 10.0)] * 40 + [("c", "good", True, True, 5.0)] * 40 + [("c", "few", True, True, 5.0)] * 5 + [("c", "untested", True, None, 5.0)] * 40 + [("c", "dear", True, True, 9.0)] * 40
    df = spark.createDataFrame(arms, "c string, arm string, accepted boolean, tested boolean, cost double")
    assert {r.arm: r.recommended for r in P.recommend(df, "c", "arm", "base").collect()} == {"good": True, "few": False, "untested": False, "dear": False}


def test_supersede_ignores_a_second_store_of_the_same_fact(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 3, "a"), ("n", 1, None)], "key string, at int, v string")
    got = {(r.key, r.at): r.current for r in P.supersede(df, ["key"], ["at"], ["v"]).collect()}
    assert got == {("k", 1): False, ("k", 2): True, ("n", 1): True}
