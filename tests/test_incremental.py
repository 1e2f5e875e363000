"""Growing files, keyed tables and the session view: many small steps against one whole read."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from spendloom.operators import session_view
from spendloom.sources import appended, keyed

T0 = dt.datetime(2024, 1, 1)


def taken(spark, folder, path):
    spark.dataSource.register(appended.AppendedLines)
    q = spark.readStream.format("appended_lines").load(path).writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(appended.SCHEMA).parquet(f"{folder}/out").select("file", "version", "at", "value").collect())


def test_growing_file_in_many_batches(spark, tmp_path):
    (tmp_path / "log").mkdir()
    path, rnd = tmp_path / "log" / "a.jsonl", random.Random(1)
    data = "".join(f'{{"i": {i}, "x": "{"é" * rnd.randint(0, 9)}"}}\n' + "\n" * (i % 3 == 0) for i in range(40)).encode()
    at = 0
    while at < len(data):  # cut anywhere, also inside a character or a line
        n = rnd.randint(1, 300)
        with path.open("ab") as f:
            f.write(data[at : at + n])
        at += n
        got = taken(spark, tmp_path, str(tmp_path / "log"))
        assert [r[3] for r in sorted(got, key=lambda r: r[2])] == [x for x in data[: data[:at].rfind(b"\n") + 1].decode().split("\n") if x]
    once = sorted(tuple(r) for r in spark.read.format("appended_lines").load(str(tmp_path / "log")).collect())
    assert once == got and len(got) == 40
    with path.open("ab") as f:
        f.write(b'{"half"')
    assert taken(spark, tmp_path, str(tmp_path / "log")) == got


def test_truncated_and_replaced_files(spark, tmp_path):
    (tmp_path / "log").mkdir()
    a, b = tmp_path / "log" / "a", tmp_path / "log" / "b"
    a.write_text("one\ntwo\nthree\n")
    b.write_text("first\n")
    taken(spark, tmp_path, str(tmp_path / "log"))
    a.write_text("one\n")  # shorter: read from its start
    b.write_text("other\nsecond\n")  # longer, but another file
    got = taken(spark, tmp_path, str(tmp_path / "log"))
    assert sorted(r[3] for r in got) == ["first", "one", "one", "other", "second", "three", "two"]
    assert len({r[1] for r in got if r[0].endswith("b")}) == 2
    os.remove(a)
    assert taken(spark, tmp_path, str(tmp_path / "log")) == got


def test_ranges_cover_each_line_once(tmp_path, monkeypatch):
    rnd = random.Random(2)
    path = tmp_path / "a"
    path.write_bytes(b"".join(bytes(rnd.choice(b"xyz") for _ in range(rnd.randint(0, 30))) + b"\n" for _ in range(200)) + b"half")
    for size in (1, 2, 7, 64, 10_000):
        monkeypatch.setattr(appended, "RANGE", size)
        got = [(r["at"], r["value"]) for s in appended.stretches(str(path), {}, appended.ends(str(path))) for b in appended.lines(s) for r in b.to_pylist()]
        want, at = [], 0
        for line in path.read_bytes().split(b"\n")[:-1]:
            if line.strip():
                want.append((at, line.decode()))
            at += len(line) + 1
        assert got == want
    assert appended.ends(str(tmp_path / "none")) == {}


def test_keyed_table_replaces_and_repeats_change_nothing(spark, tmp_path):
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ["id"], 4)
    assert table.read() is None
    batch = lambda *rows: spark.createDataFrame(rows, "id long, seq long, x string")
    latest = table.replace(F.col("seq"))
    assert table.apply(batch((1, 1, "a"), (2, 1, "b"), (2, 2, "c"), (None, 1, "n")), 0, latest)
    assert table.apply(batch((1, 3, "d"), (3, 1, "e"), (2, 1, "old")), 1, latest)
    assert not table.apply(batch((9, 9, "again")), 1, latest)
    rows = lambda: sorted((tuple(r) for r in table.read().collect()), key=str)
    want = [(1, 3, "d"), (2, 2, "c"), (3, 1, "e"), (None, 1, "n")]
    assert rows() == want
    table.apply(batch((4, 1, "f")), 2, latest)
    table.vacuum(1)
    assert rows() == sorted([*want, (4, 1, "f")], key=str) and len(table.folder.names("manifest")) == 1


def test_unique_refuses_and_leaves_no_trace(spark, tmp_path):
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ["id"], 4)
    batch = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    table.apply(batch(1, 2), 0, table.unique())
    for bad in ((2,), (5, 5)):
        with pytest.raises(keyed.Conflict):
            table.apply(batch(*bad), 1, table.unique())
    table.apply(batch(3), 1, table.unique())
    assert sorted(r.id for r in table.read().collect()) == [1, 2, 3]


def test_a_batch_that_dies_is_taken_once_when_it_comes_again(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ["id"], 4)
    for n in range(3):
        spark.createDataFrame([(i, n) for i in range(n, n + 3)], "id long, seq long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        read = spark.readStream.schema("id long, seq long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = read.writeStream.foreachBatch(table.sink(table.replace(F.col("seq")))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    put, deaths = keyed.Folder.put, []

    def dies(self, name, text, replace=False):
        if "00000001" in name and len(deaths) < 1:
            deaths.append(name)
            raise OSError("killed before the manifest")
        put(self, name, text, replace)
        if "00000002" in name and len(deaths) < 2:
            deaths.append(name)
            raise OSError("killed after the manifest")

    monkeypatch.setattr(keyed.Folder, "put", dies)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    assert sorted(tuple(r) for r in table.read().collect()) == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 2)]
    assert len(table.folder.names("manifest")) == 3


def test_two_writers_conflict(spark, tmp_path):
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ["id"], 2)
    one = spark.createDataFrame([(1,)], "id long")
    table.apply(one, 0, table.unique())

    def slow(old, new):
        keyed.KeyedTable(spark, f"file://{tmp_path}/t", ["id"], 2).apply(spark.createDataFrame([(2,)], "id long"), 1, table.unique())
        return old.unionByName(new)

    with pytest.raises(keyed.Conflict):
        table.apply(spark.createDataFrame([(3,)], "id long"), 1, slow)
    assert sorted(r.id for r in table.read().collect()) == [1, 2]
    assert len(table.folder.names("data")) == 2


def test_forwarding_stops_at_a_failure_and_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=i // 3)) for i in range(25)] + [(99, None)], "event_id long, ts timestamp")
    folder, sent = keyed.Folder(spark, f"file://{tmp_path}/cursor"), []

    def deliver(row, bad=()):
        if row["event_id"] in bad:
            raise OSError("down")
        sent.append(row["event_id"])
        return True

    go = lambda **k: keyed.forward(rows, "ts", "event_id", k.pop("deliver", deliver), folder, "at.json", page=4, **k)
    first = go(deliver=lambda r: deliver(r, {6}))
    assert (first.attempted, first.sent, first.stopped) == (7, 6, True) and sent == list(range(6))
    assert go(most=5).sent == 5 and go(deliver=lambda r: False).stopped
    last = go()
    assert not last.stopped and sent == list(range(25)) and go().attempted == 0


def plain_sessions(rows, gap=30 * 60):
    out = {}
    for u, ts, v in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        mine = out.setdefault(u, [])
        if mine and (ts - mine[-1][1]).total_seconds() <= gap:
            mine[-1] = (mine[-1][0], ts, mine[-1][2] + 1, mine[-1][3] + (v or 0))
        else:
            mine.append((ts, ts, 1, v or 0))
    return sorted(((u, i, *s[:3], round(s[3], 6)) for u, m in out.items() for i, s in enumerate(m)), key=str)


EVENTS = "user_id long, ts timestamp, value double"


def test_view_equals_sessions_of_all_rows(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 1, 2, 3]), T0 + dt.timedelta(minutes=rnd.randint(0, 4000)), rnd.choice([None, round(rnd.uniform(0, 9), 2)])) for _ in range(400)] + [(7, None, 1.0), (7, T0, 1.0)]
    view = session_view.SessionView(spark, f"file://{tmp_path}/v", buckets=3)
    shown = lambda: sorted(((*tuple(r)[:-1], round(r.spend, 6)) for r in view.read().collect()), key=str)
    held = []
    for n, lo in enumerate(range(0, 402, 67)):  # times come in no order: sessions are opened, lengthened and joined
        some = rows[lo : lo + 67]
        assert view.add(spark.createDataFrame(some, EVENTS), n)
        assert not view.add(spark.createDataFrame(some, EVENTS), n)
        held += some
        assert shown() == plain_sessions(held)
    gone = [r for i, r in enumerate(rows) if i % 9 == 0 and r[1]]
    left = rows[:]
    for g in gone:
        left.remove(g)
    assert view.remove(spark.createDataFrame(gone, EVENTS), spark.createDataFrame(left, EVENTS), 50)
    assert shown() == plain_sessions(left)


def test_view_of_the_tables_equals_the_query(spark, sf_dir, tmp_path):
    from spendloom.catalog import QUERIES

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    view = session_view.SessionView(spark, f"file://{tmp_path}/v")
    for n in range(3):
        view.add(events.where(F.col("event_id") % 3 == n), n)
    rows = lambda d: sorted((r.user_id, r.session, str(r.started), str(r.ended), r.events, round(r.spend, 4)) for r in d.collect())
    assert rows(view.read()) == rows(QUERIES["w1_sessions"](spark, sf_dir))
