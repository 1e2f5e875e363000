"""Stateful streams: the output for any split into batches, with restarts, late rows and idle keys, against plain folds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spendloom.operators import folds, roi
from spendloom.streaming import stateful

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, ts timestamp, event_id long, fill double, reset boolean, spent double, budget double"


def events(n, seed):
    rnd = random.Random(seed)
    for i in range(n):
        at = T0 + dt.timedelta(minutes=10 * i + rnd.randint(0, 5) if i % 7 else 10 * i)
        yield (rnd.randint(0, 3), at, i, rnd.choice([rnd.random(), 0.9, 0.8, None, float("nan")]), rnd.random() < 0.1, rnd.uniform(0, 40), 20.0)


def plain(rows, fold, idle=None):
    """The fold of each key's rows in order: (key, event_id, what the step returned)."""
    out, state, last = [], {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        row = dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r))
        row["fill"] = None if row["fill"] != row["fill"] else row["fill"]
        ms = int(r[1].replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        if r[0] not in state or idle is not None and ms - last[r[0]] > idle * 1000:
            state[r[0]] = fold.start()
        last[r[0]] = ms
        out.append((r[0], r[2], *fold.step(state[r[0]], row)))
    return sorted(out)


def streamed(spark, folder, batches, fold, late="2 hours", idle=None, restart=True):
    """Each batch is a file; with restart each is read by a query of its own that goes on from the checkpoint."""
    source, n = f"{folder}/in", 0
    end = (None, dt.datetime(2200, 1, 1), -1, None, None, None, None)
    stream = None
    for rows in [*batches, [end]]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        n += 1
        if restart or rows == [end] or stream is None:
            read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            stream = stateful.folded(read, fold, ["user_id"], "ts", "event_id", late, idle)
            stateful.run(stream, folder)
    names = [c.split()[0] for c in fold.schema.split(", ")]
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").select("user_id", "event_id", *names).collect())


def split(rows, sizes):
    out, at = [], 0
    for s in sizes:
        out.append(rows[at : at + s])
        at += s
    return [x for x in [*out, rows[at:]] if x]


@pytest.mark.parametrize("fold", [stateful.Cusum(), stateful.Price()], ids=["cusum", "price"])
def test_any_split_with_restarts(spark, tmp_path, fold):
    rows = list(events(60, 1))
    want = plain(rows, fold)
    mixed = rows[:]
    for i in range(0, 56, 4):  # within 40 minutes, rows come in any order
        part = mixed[i : i + 4]
        random.Random(i).shuffle(part)
        mixed[i : i + 4] = part
    for n, (given, sizes, restart) in enumerate([(rows, [60], True), (mixed, [7, 1, 20, 3], True), (mixed, [30, 10], False)]):
        assert streamed(spark, f"{tmp_path}/{n}", split(given, sizes), fold, restart=restart) == want


def test_late_rows_are_dropped_and_idle_keys_start_anew(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(hours=h), i, 0.9, False, 1.0, 1.0) for i, h in enumerate([0, 1, 10, 11, 40, 41])]
    late = (1, T0 + dt.timedelta(hours=2), 99, 0.9, False, 1.0, 1.0)
    fold = stateful.Cusum()
    got = streamed(spark, str(tmp_path), [rows[:4], rows[4:5], [late], rows[5:]], fold, late="1 hour", idle=5 * 3600)
    assert got == plain(rows, fold, 5 * 3600) and 99 not in [r[1] for r in got]
    assert [r[2] for r in got] == [0.4, 0.8, 0.4, 0.8, 0.4, 0.8]


def test_cusum_rules():
    f = stateful.Cusum()
    state = f.start()
    steps = [f.step(state, {"fill": x, "reset": r}) for x, r in [(None, False), (0.1, False), (0.6, False), (float("nan"), False), (0.0, False), (1.0, False), (0.2, False), (None, True), (0.52, False), (0.52, True)]]
    assert [s[2] for s in steps] == ["insufficient_data", "healthy", "warning", "warning", "warning", "critical", "warning", "healthy", "healthy", "healthy"]
    assert [s[3] for s in steps] == [False, True, True, False, False, True, True, True, False, False]
    assert [s[0] for s in steps[2:7]] == [0.1, 0.1, 0.0, 0.5, 0.2] and steps[9][0] == 0.02


def test_price_equals_the_batch_fold(spark):
    rows = [r for r in events(80, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = folds.prices(df.select("user_id", "ts", "event_id", "spent", "budget"), ["user_id"], ["ts", "event_id"], "spent", "budget").select("user_id", "event_id", "price", "integral")
    assert sorted(map(tuple, got.collect())) == plain(rows, stateful.Price())


def test_walk_equals_the_batch_windows(spark, tmp_path):
    rnd = random.Random(4)
    words = "error: boom\nfix file test failed ok done retry again\n".split(" ")
    rows = [(s, T0 + dt.timedelta(minutes=t), t, rnd.choice([0, 40, 100]), rnd.choice([None, "", " ".join(rnd.choices(words, k=rnd.randint(1, 8)))]), rnd.sample(["a.py", "b.py", "c.py"], rnd.randint(0, 2)), rnd.choices(["x.py", "y.py"], k=rnd.randint(0, 3)), rnd.random() < 0.3) for s in range(4) for t in range(12)]
    schema = "session long, ts timestamp, turn long, tokens long, content string, written array<string>, read array<string>, passed boolean"
    df = spark.createDataFrame(rows, schema)
    names = ["similarity", "roi", "productive", "recursive", "class", "cumulative_roi", "streak"]
    want = roi.session_roi(roi.turn_roi(df)).select("session", "turn", *names)
    for i in range(0, 48, 16):
        df.where((F.col("session") * 12 + F.col("turn")).between(i, i + 15)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = stateful.replayed(stream, stateful.RoiWalk(), ["session"], "ts", "turn", late="1 day").select("session", "turn", *names)
    plainly = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())
    assert plainly(got) == plainly(want) and len(rows) == got.count()


def test_a_key_has_one_timer_a_batch():
    """Rows of a key set the timer of the first alone; when it fires, all that is due goes and the next one's is set."""
    import pandas as pd

    class Held:
        def __init__(self):
            self.rows, self.timers, self.value = [], [], None

        def getValueState(self, *_):
            return type("V", (), {"exists": lambda s: self.value is not None, "get": lambda s: self.value, "update": lambda s, v: setattr(self, "value", v)})()

        def getListState(self, *_):
            return type("L", (), {"appendList": lambda s, r: self.rows.extend(r), "get": lambda s: iter(self.rows), "clear": lambda s: self.rows.clear(), "put": lambda s, r: self.rows.extend(r)})()

        def registerTimer(self, at):
            self.timers.append(at)

    names = ["at_us", "event_id", "spent", "budget"]
    fold = stateful.OrderedFold(stateful.Price(), "event_id", "", names, ["k", "at_us", "event_id", "price", "integral"], None)
    handle = Held()
    fold.init(handle)
    fold.handleInputRows((1,), iter([pd.DataFrame([(t, t * 1000, t, 1.0, 1.0) for t in (30, 10, 20, 40)], columns=["at_ms", *names])]), None)
    assert handle.timers == [10]
    now = type("T", (), {"getCurrentWatermarkInMs": lambda s: 25})()
    assert [list(d.event_id) for d in fold.handleExpiredTimer((1,), now, None)] == [[10, 20]]
    assert handle.timers == [10, 30] and sorted(r[0] for r in handle.rows) == [30, 40]
