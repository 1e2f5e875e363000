"""Entities, what compactions lose, read gates, guards and tool audits on small tables worked out by plain Python."""

import random
import re

import pytest

from spendloom.operators import entities as E
from spendloom.operators import guards as G


def plain(text):
    out = {}
    for category, patterns in E.PATTERNS.items():
        for p in patterns:
            for m in re.finditer(p, text, re.ASCII):
                v = m[1].strip()
                if len(v) >= 3 and v.lower() not in E.COMMON:
                    out.setdefault((category, v.lower()), v)
    return {(c, k, v) for (c, k), v in out.items()}


TEXTS = [
    "open file src/app/main.ts and `lib/util.py`; README.md, then packages/core/index.js",
    "const handler = async (x) => y; function Run() {} def run(self): fn Go_1; class Foo extends Bar",
    "GET /users/:id, POST '/api/v2/items' and endpoint: /v1/health; timeout: 30s, port 8080 limit: 5",
    "We must always keep the cache warm. Approach: write through everything, then test: the total is right",
    "interface Props struct Point enum Color let total = (a) option: depth = 'deep'",
    "const const = 1; let if = 2; ab", "", None, "Foo.ts foo.TS FOO.ts in Foo.ts",
]


def test_entities(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = {}
    for r in E.entities(df, ["i"], "text").collect():
        got.setdefault(r.i, set()).add((r.category, r.key, r.value))
    for i, t in enumerate(TEXTS):
        assert got.get(i, set()) == plain(t or "")
    assert len(got) == 6 and E.entities(df.where("false"), ["i"], "text").collect() == []


def test_lost(spark):
    before = spark.createDataFrame([("s", 1, "file a1.ts and const Total = 1"), ("s", 2, "file A1.ts, file b2.ts"), ("s", 3, None), ("t", 1, "file c3.ts")], "s string, turn int, text string")
    after = spark.createDataFrame([("s", "we kept file B2.ts")], "s string, text string")
    got = [tuple(r) for r in E.lost(before, after, "s", "turn", "text").orderBy("s", "nth").collect()]
    assert got == [("s", "file_name", "a1.ts", 1, 1), ("s", "variable_name", "Total", 1, 2), ("t", "file_name", "c3.ts", 1, 1)]
    assert [r.nth for r in E.lost(before, after.where("false"), "s", "turn", "text", shown=1).collect()] == [1, 1]


def walk(rows):
    """One session's reads by hand."""
    epoch, held, out = 0, {}, []
    for turn, path, digest, e, tokens in sorted(rows):
        was = held.get(path)
        if e != epoch:
            out.append((turn, "allow", "epoch_advanced", 0, None))
        elif was is None:
            out.append((turn, "allow", "not_resident", 0, None))
        elif was[0] != digest or digest is None:
            out.append((turn, "allow", "content_changed", 0, None))
        else:
            out.append((turn, "deny", "already_resident", max(0, tokens or 0), was[1]))
        if e > epoch:
            epoch, held = e, {}
        if e == epoch:
            was = held.get(path)
            held[path] = (digest, was[1] if was and was[0] == digest and digest is not None else turn)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_read_gate(spark, seed):
    rnd = random.Random(seed)
    rows = [(s, t, rnd.choice("ab"), rnd.choice(["x", "y", None]), max(0, t // 6 + rnd.choice([0, 0, 0, -1, 1])), rnd.choice([None, -3, 10])) for s in "pq" for t in range(40)]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "session string, turn int, path string, digest string, epoch int, tokens int, note string")
    got = G.read_gate(df)
    assert got.columns == [*df.columns, "decision", "reason", "reclaimed", "first_turn"]
    for s in "pq":
        mine = got.where(f"session = '{s}'").orderBy("turn").select("turn", "decision", "reason", "reclaimed", "first_turn").collect()
        assert [tuple(r) for r in mine] == walk([r[1:] for r in rows if r[0] == s])


@pytest.mark.parametrize("sent", [1_000_000, 1])
def test_guarded(spark, monkeypatch, sent):
    monkeypatch.setattr(G, "SENT", sent)
    actions = spark.createDataFrame([("a", 1), ("b", 2), ("", 3), (None, 4), ("a", 5)], "step string, n int")
    held = spark.createDataFrame([("a", 0), ("a", 1), ("", 2), (None, 3), ("z", 4)], "step string, blocked int")
    assert {(r.n, r.blocked) for r in G.guarded(actions, held, "step").collect()} == {(1, True), (2, False), (3, False), (4, False), (5, True)}
    assert G.guarded(actions, held.where("false"), "step").where("blocked").count() == 0


def test_tool_audit(spark):
    tools = [("read", 100, 300, 0, 40, True), ("busy", 200, 8, 1, 10, False), ("rare", 300, 2, 3, 20, None), ("dead", 400, 0, None, 20, False), ("new", 500, 0, 10, 0, False), ("null", 600, None, 99, None, False)]
    df = spark.createDataFrame(tools, "name string, tokens int, calls int, idle_days int, loaded int, protected boolean")
    got = {r.name: r for r in G.tool_audit(df, 56, 80).collect()}
    assert {k: (r.utility, r.remove) for k, r in got.items()} == {"read": ("critical", False), "busy": ("high", False), "rare": ("low", False), "dead": ("waste", True), "new": ("low", False), "null": ("waste", True)}
    assert got["rare"].wasted_per_week == 10 * 300 * 0.9 and got["dead"].wasted_per_week == 4000 and got["read"].wasted_per_week == 0
    assert not any(r.remove for r in G.tool_audit(df, 7, 80).collect())
