"""Folds whose state depends on order: greedy bursts and budgets, clamped controllers, hash chains.

Rows are dealt by key and sorted; a task streams through them and holds one
key's state, never a key's rows. One key is one task's work, as each step needs
the state that the step before left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

Out = list[tuple]


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, Out]], schema: str, end: Callable[[Any], Out] | None = None) -> DataFrame:
    """keys and what step returns for each row in order (and end, once a key's rows are over).

    step(state, row) -> (state, rows out); schema names the columns out after the
    keys. Null keys are a key of their own. Ties in order must be broken by its
    last column. Empty table: no rows.
    """
    names = df.columns
    typed = df.select(*keys).limit(0)
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in typed.schema.fields)
    out_schema = to_arrow_schema(df.sparkSession.createDataFrame([], f"{held}, {schema}").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, found = object(), None, []

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*found)) if found else [()] * len(out_schema)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, out_schema)], schema=out_schema)

        for b in batches:
            for row in b.to_pylist():
                at = tuple(row[k] for k in keys)
                if at != key:
                    if end and state is not None:
                        found += [(*key, *x) for x in end(state)]
                    key, state = at, start()
                state, more = step(state, row)
                found += [(*at, *x) for x in more]
            yield flushed()
            found.clear()
        if end and state is not None:
            found += [(*key, *x) for x in end(state)]
        yield flushed()

    rows = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).select(*names)
    return rows.mapInArrow(run, f"{held}, {schema}")


def bursts(events: DataFrame, keys: list[str], at: str, tie: str, window_us: int = 60_000_000, least: int = 5) -> DataFrame:
    """keys, started, ended, n of each burst: from an event on, all within window_us, if they are least or more; the next search begins after them, else one event later. at: whole microseconds."""

    def step(held: list, row: dict) -> tuple[list, Out]:
        return _advance([*held, row[at]], window_us, least, False)

    def end(held: list) -> Out:
        return _advance(held, window_us, least, True)[1]

    return ordered_fold(events, keys, [at, tie], list, step, "started long, ended long, n long", end)


def _advance(held: list, window_us: int, least: int, over: bool) -> tuple[list, Out]:
    """Settles the windows that no later event can join. held: the times from the open window's first event on."""
    out: Out = []
    while held and (over or held[-1] - held[0] > window_us):
        n = sum(1 for t in held if t - held[0] <= window_us)
        if n >= least:
            out.append((held[0], held[n - 1], n))
            held = held[n:]
        else:
            held = held[1:]
    return held, out


def packed(items: DataFrame, keys: list[str], order: list[str], tokens: str, item: str, budget: float) -> DataFrame:
    """keys, item, tokens, included, running: greedy under a budget; an item that doesn't fit is skipped and later, smaller ones may still fit. Null tokens count 0."""

    def step(used: float, row: dict) -> tuple[float, Out]:
        n = row[tokens] or 0
        fits = used + n <= budget
        used += n if fits else 0
        return used, [(row[item], n, fits, used)]

    return ordered_fold(items, keys, order, lambda: 0, step, "item long, tokens long, included boolean, running long")


def prices(spend: DataFrame, keys: list[str], order: list[str], spent: str, budget: str, lowest: float = 0.0, highest: float = 1.0, setpoint: float = 1.0, gains: tuple[float, float, float] = (0.6, 0.1, 0.05), limit: float = 5.0) -> DataFrame:
    """keys, the order columns, lambda, integral: a PID price for each observation. The price is clamped, and so is the integral; an observation without a positive budget or finite spend leaves both."""
    kp, ki, kd = gains
    mid = (lowest + highest) / 2

    def step(state: tuple, row: dict) -> tuple[tuple, Out]:
        price, integral, last = state
        b, s = row[budget], row[spent]
        if b is not None and b > 0 and s is not None and abs(s) < float("inf"):
            error = max(0.0, s) / b - setpoint
            integral = min(limit, max(-limit, integral + error))
            price = min(highest, max(lowest, mid + kp * error + ki * integral + kd * (error - last)))
            last = error
        return (price, integral, last), [(*(row[c] for c in order), price, integral)]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spend.select(*order).schema.fields)
    return ordered_fold(spend, keys, order, lambda: (mid, 0.0, 0.0), step, f"{kinds}, price double, integral double")


def chain(records: DataFrame, keys: list[str], order: str, payload: str) -> DataFrame:
    """keys, seq, content_hash, prefix_hash: prefix_hash is the sha256 of the one before (none: '') and content_hash, the sha256 of the payload (null: '')."""

    def step(before: str, row: dict) -> tuple[str, Out]:
        content = hashlib.sha256((row[payload] or "").encode()).hexdigest()
        prefix = hashlib.sha256((before + content).encode()).hexdigest()
        return prefix, [(row[order], content, prefix)]

    return ordered_fold(records, keys, [order], str, step, "seq long, content_hash string, prefix_hash string")


def verify_chain(links: DataFrame, records: DataFrame, keys: list[str], order: str, payload: str) -> DataFrame:
    """keys, records, broken_at: the first seq whose content, prefix or place is wrong (null: the chain holds). Every link is checked against the one before it, side by side."""
    from pyspark.sql import Window

    by = Window.partitionBy(*keys).orderBy("seq")
    both = links.join(records.withColumnRenamed(order, "seq"), [*keys, "seq"], "left")
    content = F.sha2(F.coalesce(F.col(payload), F.lit("")), 256)
    before = F.coalesce(F.lag("prefix_hash").over(by), F.lit(""))
    good = (F.col("content_hash") == content) & (F.col("prefix_hash") == F.sha2(F.concat(before, F.col("content_hash")), 256)) & F.coalesce(F.col("seq") == F.lag("seq").over(by) + 1, F.lit(True))
    checked = both.select(*keys, "seq", F.coalesce(good, F.lit(False)).alias("good"))
    return checked.groupBy(*keys).agg(F.count("*").alias("records"), F.min(F.when(~F.col("good"), F.col("seq"))).alias("broken_at"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


def w15_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts(_events(spark, sf_dir).select("user_id", "at", "event_id"), ["user_id"], "at", "event_id", 6 * 3_600_000_000, 4)


def w24_greedy_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", F.col("p_size").cast("long").alias("p_size"), "p_partkey")
    return packed(part, ["p_brand"], ["p_size", "p_partkey"], "p_size", "p_partkey", 120).where("included").drop("included")


def w25_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(F.round("value", 2).cast("decimal(18,2)")).cast("double").alias("spent")).withColumn("budget", F.lit(100.0))
    return prices(day, ["user_id"], ["day"], "spent", "budget").select("user_id", "day", F.round("price", 6).alias("price"), F.round("integral", 6).alias("integral"))


def w21_hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return chain(turns, ["conv_id"], "turn", "text")


def w21_verify_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    changed = F.when((F.col("turn") == 2) & (F.col("conv_id") % 5 == 0), F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    return verify_chain(chain(turns, ["conv_id"], "turn", "text"), turns.withColumn("text", changed), ["conv_id"], "turn", "text")


QUERIES = {f.__name__: f for f in (w15_bursts, w21_hash_chain, w21_verify_chain, w24_greedy_packing, w25_prices)}
#: By recursion over row numbers: another way to the same rows.
ORACLE_SQL = {
    "w15_bursts": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        n AS (SELECT a.user_id, a.i, a.moment, count(*) AS n, max(b.moment) AS ended FROM e a JOIN e b ON a.user_id = b.user_id AND b.i >= a.i AND b.moment - a.moment <= 21600000000 GROUP BY a.user_id, a.i, a.moment),
        r AS (SELECT user_id, i, moment, n, ended FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.moment, n.n, n.ended FROM r JOIN n ON n.user_id = r.user_id AND n.i = CASE WHEN r.n >= 4 THEN r.i + r.n ELSE r.i + 1 END)
        SELECT user_id, moment AS started, ended, n FROM r WHERE n >= 4""",
    "w24_greedy_packing": """WITH RECURSIVE p AS (SELECT p_brand, p_partkey, CAST(p_size AS BIGINT) AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS i FROM part),
        r AS (SELECT p_brand, p_partkey, size, i, size <= 120 AS fits, CASE WHEN size <= 120 THEN size ELSE 0 END AS running FROM p WHERE i = 1
          UNION ALL SELECT p.p_brand, p.p_partkey, p.size, p.i, r.running + p.size <= 120, r.running + CASE WHEN r.running + p.size <= 120 THEN p.size ELSE 0 END FROM r JOIN p ON p.p_brand = r.p_brand AND p.i = r.i + 1)
        SELECT p_brand, p_partkey AS item, size AS tokens, CAST(running AS BIGINT) AS running FROM r WHERE fits""",
    "w25_prices": """WITH RECURSIVE d AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(CAST(round(value, 2) AS DECIMAL(18,2))) AS DOUBLE) / 100 - 1 AS e FROM events GROUP BY user_id, CAST(ts AS DATE)), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d),
        r AS (SELECT user_id, day, i, e, least(5e0, greatest(-5e0, e)) AS integral, 0e0 AS before FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.day, o.i, o.e, least(5e0, greatest(-5e0, r.integral + o.e)), r.e FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
        SELECT user_id, day, round(least(1e0, greatest(0e0, 0.5e0 + 0.6e0 * e + 0.1e0 * integral + 0.05e0 * (e - before))), 6) AS price, round(integral, 6) AS integral FROM r""",
    "w21_hash_chain": """WITH RECURSIVE t AS (SELECT conv_id, turn, sha256(coalesce(text, '')) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
        r AS (SELECT conv_id, turn, h, i, sha256(h) AS p FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.turn, t.h, t.i, sha256(r.p || t.h) FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
        SELECT conv_id, turn AS seq, h AS content_hash, p AS prefix_hash FROM r""",
    "w21_verify_chain": """SELECT conv_id, count(*) AS records, min(CASE WHEN turn = 2 AND conv_id % 5 = 0 THEN turn END) AS broken_at FROM conversations GROUP BY conv_id""",
}
