"""Transcript lines, keyed tables, CSV, streams and graph iterations on small inputs."""

import csv
import glob
import json

from pyspark.sql import functions as F
from spendloom.operators.graphs import pagerank, reach
from spendloom.sources.transcripts import last_written, parse_lines, repeated_keys, write_csv
from spendloom.streaming.events import keyed_sink, sessions, tail, tumbling


def test_transcript_lines(spark):
    rows = [json.dumps({"type": "user", "timestamp": "2024-01-01T00:00:00Z", "role": "outer", "content": "o", "message": {"role": "user", "content": "hi"}}), "", "  ", "{broken", "3", json.dumps({"type": "x"}), json.dumps({"type": "assistant", "role": "assistant", "content": "yes"})]
    good, bad = parse_lines(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert sorted((r.role, r.content) for r in good.collect()) == [("assistant", "yes"), ("user", "hi")]
    assert sorted(r.raw for r in bad.collect()) == ["3", "{broken"]


def test_keyed_tables(spark):
    t = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, seq int, v string")
    assert sorted((r.k, r.v) for r in last_written(t, ["k"], F.col("seq")).collect()) == [(1, "b"), (2, None)]
    assert [r.k for r in repeated_keys(t, ["k"]).collect()] == [1]
    assert last_written(t.limit(0), ["k"], F.col("seq")).count() == 0


def test_csv(spark, tmp_path):
    write_csv(spark.createDataFrame([('a "b", c', [1, 2])], "x string, y array<int>").coalesce(1), str(tmp_path / "o"))
    with open(glob.glob(str(tmp_path / "o" / "part*.csv"))[0], newline="") as f:
        text = f.read()
    assert list(csv.reader(text.splitlines(True))) == [["x", "y"], ['a "b", c', "[1,2]"]] and text.count("\r\n") == text.count("\n") == 2


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    for name, op in (("tumbling", tumbling), ("sessions", sessions)):
        out = op(tail(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName(name).outputMode("complete")
        out.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        got, want = spark.table(name), op(events)
        assert got.count() == want.count() > 0 and got.select(F.sum(got.columns[2])).first() == want.select(F.sum(want.columns[2])).first()
    sink = tail(spark, str(tmp_path / "in"), schema, 1).writeStream.foreachBatch(keyed_sink(str(tmp_path / "out"), ["event_id"]))
    sink.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("event_id").distinct().count() == batch.count()


def test_keys_of_earlier_batches_are_left_out(spark, tmp_path):
    write = keyed_sink(str(tmp_path / "out"), ["k"])
    rows = lambda *ks: spark.createDataFrame([(k, 1) for k in ks], "k long, v int")
    write(rows(1, 2, 2), 0)
    write(rows(2, 3), 1)
    write(rows(2, 3), 1)
    write(rows(1, 3), 2)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (3, 4), (None, 1)], "src int, dst int")
    got = {r.id: r.rank for r in pagerank(edges).collect()}
    want = dict.fromkeys((1, 2, 3, 4), 0.25)
    out = {1: [2], 2: [3], 3: [1, 4], 4: []}
    for _ in range(200):
        new = dict.fromkeys(want, (0.15 + 0.85 * want[4]) / 4)
        for a, to in out.items():
            for b in to:
                new[b] += 0.85 * want[a] / len(to)
        want = new
    assert all(abs(got[i] - want[i]) < 1e-5 for i in want) and abs(sum(got.values()) - 1) < 1e-9
    start = spark.createDataFrame([(2,)], "id int")
    assert {r.id: r.distance for r in reach(edges, start).collect()} == {2: 0, 3: 1, 1: 2, 4: 2}
    assert {r.id: r.distance for r in reach(edges, start, depth=1, directed=False).collect()} == {2: 0, 3: 1, 1: 1}
    assert pagerank(edges.limit(0)).count() == 0
