"""Stateful stream operators: folds over each key's rows in order of event time, with state that outlives micro-batches.

A row waits in its key's list until the watermark passes its time; a timer then
steps the fold through the rows that are due, in order of time and tie-break,
and emits one row for each. So the output doesn't depend on how the rows were
split into batches or in which order they came, as long as none is later than
the watermark; those that are, Spark drops. A key that has been idle for longer
than its time to live starts anew, and a timer frees its state. The checkpoint
holds state, timers and offsets: a query that is stopped or killed goes on where
it was.

The folds are plain objects (state as a dict that JSON can hold), which tests
hold against the batch queries: those are windows over whole tables.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import roi
from ..plans.storage import new_folder
from ..sources.keyed import Folder

#: Times that a watermark (it starts in 1970) and the workers' data frames can deal with; rows outside are dropped, as null times are.
FIRST, LAST = "1970-01-02 00:00:00", "2262-01-01 00:00:00"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def millionths(x: float) -> int:
    return math.floor(x * 1e6 + 0.5)


class Fold(Protocol):
    """inputs: columns read besides the key, time and tie-break; schema: columns that a step returns."""

    inputs: list[str]
    schema: str

    def start(self) -> dict[str, Any]: ...

    def step(self, state: dict[str, Any], row: dict[str, Any]) -> tuple: ...


@dataclass(frozen=True)
class Cusum:
    """Two one-sided sums over a fill from 0 to 1, and the regime they show.

    insufficient_data until the first good sample; critical once the sum over
    k_crit reaches h_crit, else warning once that over k_warn reaches h_warn;
    otherwise a regime above healthy stays until a reset. A reset (its column is
    true) comes before the row's sample: sums to zero, regime healthy. A null or
    non-finite sample is skipped. Samples and levels count in whole millionths,
    so that sums are exact.
    """

    sample: str = "fill"
    reset: str = "reset"
    k_warn: float = 0.5
    k_crit: float = 0.75
    h_warn: float = 0.05
    h_crit: float = 0.1
    schema = "s_warn double, s_crit double, regime string, changed boolean, skipped boolean"

    @property
    def inputs(self) -> list[str]:
        return [self.sample, self.reset]

    def start(self) -> dict[str, Any]:
        return {"warn": 0, "crit": 0, "regime": "insufficient_data"}

    def step(self, state: dict[str, Any], row: dict[str, Any]) -> tuple:
        before = state["regime"]
        if row[self.reset]:
            state.update(warn=0, crit=0, regime="healthy")
        x = row[self.sample]
        skipped = x is None or not math.isfinite(x)
        if not skipped:
            state["warn"], state["crit"] = max(0, state["warn"] + millionths(x) - millionths(self.k_warn)), max(0, state["crit"] + millionths(x) - millionths(self.k_crit))
            if state["crit"] >= millionths(self.h_crit):
                state["regime"] = "critical"
            elif state["warn"] >= millionths(self.h_warn):
                state["regime"] = "warning"
            elif state["regime"] == "insufficient_data":
                state["regime"] = "healthy"
        return state["warn"] / 1e6, state["crit"] / 1e6, state["regime"], state["regime"] != before, skipped


@dataclass(frozen=True)
class Price:
    """A PID price for each observation of spend against a budget; the rule of operators.folds.prices."""

    spent: str = "spent"
    budget: str = "budget"
    lowest: float = 0.0
    highest: float = 1.0
    setpoint: float = 1.0
    gains: tuple[float, float, float] = (0.6, 0.1, 0.05)
    limit: float = 5.0
    schema = "price double, integral double"

    @property
    def inputs(self) -> list[str]:
        return [self.spent, self.budget]

    def start(self) -> dict[str, Any]:
        return {"price": (self.lowest + self.highest) / 2, "integral": 0.0, "last": 0.0}

    def step(self, state: dict[str, Any], row: dict[str, Any]) -> tuple:
        b, s = row[self.budget], row[self.spent]
        if b is not None and b > 0 and s is not None and math.isfinite(s):
            (kp, ki, kd), error = self.gains, max(0.0, s) / b - self.setpoint
            integral = min(self.limit, max(-self.limit, state["integral"] + error))
            price = min(self.highest, max(self.lowest, (self.lowest + self.highest) / 2 + kp * error + ki * integral + kd * (error - state["last"])))
            state.update(price=price, integral=integral, last=error)
        return state["price"], state["integral"]


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def _errors(text: str) -> set[str]:
    named = [m.strip() for p in roi.ERRORS for m in re.findall(p.replace(r"\z", r"\Z"), text)]
    return {x for x in [*named, *(m[0] for p in roi.FAILURES for m in re.finditer(p, text))] if re.search(r"\w{3}", x, re.ASCII)}


@dataclass(frozen=True)
class RoiWalk:
    """A session's turns judged as they come: return, running return and the streak of low ones; the rules of operators.roi.

    State: the turn before (words, lines, errors, files written) and how often
    each file was read. Text is held as sets, so a turn's state is at most its
    text.
    """

    inputs = ["tokens", "content", "written", "read", "passed"]
    schema = "similarity double, roi double, productive double, recursive double, class string, cumulative_roi double, streak long"

    def start(self) -> dict[str, Any]:
        return {"before": None, "reads": {}, "tokens": 0, "productive": 0.0, "streak": 0}

    def step(self, state: dict[str, Any], row: dict[str, Any]) -> tuple:
        text, total = row["content"] or "", float(row["tokens"] or 0)
        own = {
            "w": {x for x in re.split(r"\W+", text.lower(), flags=re.ASCII) if len(x) > 2}, "l": {x for x in (re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", y) for y in text.split("\n")) if x},
            "e": _errors(text), "f": set(row["written"] if row["written"] is not None else []),
        }
        last = {k: set(v) for k, v in state["before"].items()} if state["before"] else None
        alike = 0.3 * _jaccard(own["w"], last["w"]) + 0.7 * _jaccard(own["l"], last["l"]) if last else 0.0
        files = sorted(set(row["read"] if row["read"] is not None else []))
        vain = [f for f in files if state["reads"].get(f, 0) >= 2]
        for f in files:
            state["reads"][f] = state["reads"].get(f, 0) + 1
        shared = lambda k: bool(last and own[k] & last[k])
        good = total * roi.WRITTEN * bool(own["f"]) + total * roi.TESTED * bool(row["passed"]) + total * roi.RESOLVED * bool(last and last["e"] - own["e"])
        again = total * roi.REPEAT * (alike > 0.8) + total * roi.SAME_FILES * (shared("f") and alike > 0.5) + total * roi.SAME_ERRORS * shared("e")
        again += math.ceil((sum(map(len, vain)) + len(vain) - 1) / 3) if vain else 0
        p, r = min(good, total), min(again, total)
        if p + r > total:
            p, r = float(math.floor(p * (total / (p + r)))), float(math.floor(r * (total / (p + r))))
        value = max(0.0, min(1.0, p / total)) if total > 0 else 0.0
        state.update(before={k: sorted(v) for k, v in own.items()}, tokens=state["tokens"] + (row["tokens"] or 0), productive=state["productive"] + p, streak=state["streak"] + 1 if value < roi.LOW else 0)
        kind = "productive" if value >= 0.5 else "recursive" if r > p else "unknown"
        return alike, value, p, r, kind, state["productive"] / state["tokens"] if state["tokens"] > 0 else 0.0, state["streak"]


class OrderedFold(StatefulProcessor):
    """Holds a key's rows until they are due and steps a fold through them in order. idle_ms: time to live of a key without rows."""

    def __init__(self, fold: Fold, tie: str, row_schema: str, names: list[str], types: list[str], idle_ms: int | None):
        self.fold, self.tie, self.row_schema, self.names, self.types, self.idle_ms = fold, tie, row_schema, names, types, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "held string, last_ms long")
        self.waiting = handle.getListState("waiting", self.row_schema)

    def handleInputRows(self, key: Any, rows: Iterator, timerValues: Any) -> Iterator:  # noqa: N803
        first = None
        for some in rows:
            some = some[["at_ms", *self.names]]
            self.waiting.appendList([tuple(_plain(x) for x in r) for r in some.itertuples(index=False, name=None)])
            first = int(some["at_ms"].min()) if first is None else min(first, int(some["at_ms"].min()))
        if first is not None:
            self.handle.registerTimer(first)  # takes all rows that are due by then and sets the timer of the next
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator:  # noqa: N803
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        due = sorted((r for r in held if r[0] <= now), key=lambda r: (r[0], r[1 + self.names.index("at_us")], r[1 + self.names.index(self.tie)]))
        saved = self.state.get() if self.state.exists() else None
        if not due:
            # A timer of rows that another one has taken, or that of an idle key.
            if saved and self.idle_ms is not None and not held and now - saved[1] > self.idle_ms:
                self.state.clear()
            return iter([])
        state, last = (json.loads(saved[0]), saved[1]) if saved else (self.fold.start(), None)
        out = []
        for r in due:
            row = dict(zip(self.names, r[1:]))
            if last is not None and self.idle_ms is not None and r[0] - last > self.idle_ms:
                state = self.fold.start()
            last = r[0]
            out.append((*key, row["at_us"], row[self.tie], *self.fold.step(state, row)))
        self.state.update((json.dumps(state), last))
        left = [tuple(r) for r in held if r[0] > now]
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(min(r[0] for r in left))
        if self.idle_ms is not None:
            self.handle.registerTimer(last + self.idle_ms + 1)
        return iter([pd.DataFrame(out, columns=self.types)])

    def close(self) -> None:
        pass


def _plain(x: Any) -> Any:
    """A value of pandas as one that state can hold."""
    import numpy as np

    if isinstance(x, np.ndarray):
        return [_plain(y) for y in x]
    if isinstance(x, np.generic):
        x = x.item()
    return None if isinstance(x, float) and math.isnan(x) else x


def folded(rows: DataFrame, fold: Fold, keys: list[str], at: str, tie: str, late: str = "2 hours", idle: int | None = None) -> DataFrame:
    """keys, at, tie and the fold's columns: a stream of one row for each row of a stream.

    at: a timestamp (rows without one, or with one before FIRST or after LAST, are dropped); tie: a
    column that orders rows of one time. late: how much older than the newest
    row a row may be; idle: seconds after which a key without rows starts anew.
    NaN counts as null. Needs the RocksDB state store, which is set here.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    stamped = rows.withColumn(at, F.col(at).cast("timestamp")).where(F.col(at).between(F.lit(FIRST).cast("timestamp"), F.lit(LAST).cast("timestamp"))).withWatermark(at, late)
    names = ["at_us", tie, *fold.inputs]
    given = stamped.select(*keys, at, F.unix_millis(at).alias("at_ms"), F.unix_micros(at).alias("at_us"), tie, *fold.inputs)
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    row_schema = ", ".join(f"`{n}` {kinds[n]}" for n in ["at_ms", *names])
    out = [*(f"`{k}` {kinds[k]}" for k in keys), "`at_us` bigint", f"`{tie}` {kinds[tie]}"]
    columns = [*keys, "at_us", tie, *(c.split()[0] for c in fold.schema.split(", "))]
    processor = OrderedFold(fold, tie, row_schema, names, columns, None if idle is None else idle * 1000)
    found = given.groupBy(*keys).transformWithStateInPandas(processor, ", ".join([*out, fold.schema]), "Append", "EventTime")
    return found.withColumn("at_us", F.timestamp_micros("at_us")).withColumnRenamed("at_us", at)


def run(stream: DataFrame, folder: str) -> None:
    """Runs a stream over what is there, into Parquet at folder/out, and ends; a later run goes on from folder/checkpoint."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def replayed(source: DataFrame, fold: Fold, keys: list[str], at: str, tie: str, late: str = "2 hours", idle: int | None = None, end: str = LAST) -> DataFrame:
    """The whole output of a fold over a stream that ends: once it is read, a row from the far future, which is never due itself, makes all others due.

    The second run starts from the first one's checkpoint, in the shared folder.
    """
    spark, folder = source.sparkSession, new_folder(source.sparkSession, "fold")
    wanted = source.select(*keys, F.col(at).cast("timestamp").alias(at), tie, *fold.inputs)
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in wanted.schema.fields])
    closing = spark.createDataFrame([(None,) * len(wanted.columns)], nullable).withColumn(at, F.lit(end).cast("timestamp"))
    closing.where("false").write.parquet(f"{folder}/end")
    stream = folded(wanted.unionByName(spark.readStream.schema(nullable).parquet(f"{folder}/end")), fold, keys, at, tie, late, idle)
    run(stream, folder)
    closing.coalesce(1).write.mode("append").parquet(f"{folder}/end")
    run(stream, folder)
    return spark.read.parquet(f"{folder}/out")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; one that is a single file is looked for in its folder."""
    path = f"{sf_dir}/{name}.parquet"
    read = spark.readStream.schema(spark.read.parquet(path).schema)
    return read.parquet(path) if Folder(spark, path).is_folder() else read.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _micros(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.unix_micros("ts"))


def x6_cusum_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as fills: values over 100 are unknown, a purchase is a reset."""
    rows = _stream(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("value") <= 100, F.col("value") / 100).alias("fill"), (F.col("event_type") == "purchase").alias("reset"))
    return _micros(replayed(rows, Cusum(), ["user_id"], "ts", "event_id"))


def x6_price_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price after each event, each against a budget of 20; three idle days end a walk."""
    rows = _stream(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("spent"), F.lit(20.0).alias("budget"))
    out = replayed(rows, Price(), ["user_id"], "ts", "event_id", idle=3 * 86_400)
    return _micros(out).withColumns({"price": F.round("price", 6), "integral": F.round("integral", 6)})


def x6_roi_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk of each conversation, a minute for a turn."""
    c = _stream(spark, sf_dir, "conversations").where("text IS NOT NULL")
    found = lambda p: F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(p), F.lit(0)))
    rows = c.select(F.col("conv_id").alias("session"), F.timestamp_seconds(F.col("turn") * 60 + 1_700_000_000).alias("ts"), "turn", F.ceil(F.length("text") / 4).alias("tokens"), F.col("text").alias("content"), found("[a-z]+tion").alias("written"), found("[a-z]*ing").alias("read"), F.col("text").contains("est").alias("passed"))
    out = replayed(rows, RoiWalk(), ["session"], "ts", "turn").drop("ts")
    return out.withColumns({n: F.round(n, 6) for n in ("similarity", "roi", "productive", "recursive", "cumulative_roi")})


QUERIES = {f.__name__: f for f in (x6_cusum_stream, x6_price_stream, x6_roi_stream)}
#: The walks by recursion over row numbers, and the return of turns by joins: other ways to the same rows.
ORACLE_SQL = {
    "x6_cusum_stream": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS ts, event_id, CASE WHEN value <= 100 THEN CAST(floor(value / 100 * 1e6 + 0.5e0) AS BIGINT) END AS x, coalesce(event_type = 'purchase', false) AS reset, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS ts, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS c, 'insufficient_data' AS regime, 'insufficient_data' AS before, false AS skipped FROM (SELECT DISTINCT user_id FROM e)
          UNION ALL SELECT user_id, i, ts, event_id, w, c, CASE WHEN x IS NULL THEN was WHEN c >= 100000 THEN 'critical' WHEN w >= 50000 THEN 'warning' WHEN was = 'insufficient_data' THEN 'healthy' ELSE was END, before, x IS NULL
          FROM (SELECT e.user_id, e.i, e.ts, e.event_id, e.x, CASE WHEN e.reset THEN 'healthy' ELSE r.regime END AS was, r.regime AS before,
              CASE WHEN e.x IS NULL THEN CASE WHEN e.reset THEN 0 ELSE r.w END ELSE greatest(0, CASE WHEN e.reset THEN 0 ELSE r.w END + e.x - 500000) END AS w,
              CASE WHEN e.x IS NULL THEN CASE WHEN e.reset THEN 0 ELSE r.c END ELSE greatest(0, CASE WHEN e.reset THEN 0 ELSE r.c END + e.x - 750000) END AS c
            FROM r JOIN e ON r.user_id = e.user_id AND e.i = r.i + 1))
        SELECT user_id, ts, event_id, w / 1e6 AS s_warn, c / 1e6 AS s_crit, regime, regime <> before AS changed, skipped FROM r WHERE i > 0""",
    "x6_price_stream": """WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) AS ts, event_id, greatest(0e0, value) / 20 - 1 AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, coalesce(epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 259200000, true) AS anew FROM events),
        r AS (SELECT *, least(5e0, greatest(-5e0, e)) AS integral, 0e0 AS before FROM o WHERE i = 1
          UNION ALL SELECT o.*, least(5e0, greatest(-5e0, CASE WHEN o.anew THEN 0e0 ELSE r.integral END + o.e)), CASE WHEN o.anew THEN 0e0 ELSE r.e END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
        SELECT user_id, ts, event_id, round(least(1e0, greatest(0e0, 0.5e0 + 0.6e0 * e + 0.1e0 * integral + 0.05e0 * (e - before))), 6) AS price, round(integral, 6) AS integral FROM r""",
    "x6_roi_stream": roi._ROI + """SELECT r.session, r.turn, round(similarity, 6) AS similarity, round(roi, 6) AS roi, round(productive, 6) AS productive, round(recursive, 6) AS recursive, CASE WHEN roi >= 0.5e0 THEN 'productive' WHEN recursive > productive THEN 'recursive' ELSE 'unknown' END AS class, round(cumulative_roi, 6) AS cumulative_roi, CAST(streak AS BIGINT) AS streak
        FROM roi r JOIN folded f ON r.session = f.session AND r.turn = f.turn""",
}
