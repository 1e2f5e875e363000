"""A materialised view of sessions that is kept up with its events by merging partial aggregates.

Sessions are intervals whose events lie at most a gap apart, with sums. Adding
events makes short intervals of their own; merged with the stored intervals of
the same users they may lengthen a session, open one earlier, or join two. That
needs no stored events. Taking events away may split a session: only the
sessions that held one are made anew, from the events that are left in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import cut, new_folder
from ..sources.keyed import KeyedTable

GAP_US = 30 * 60 * 1_000_000
DAY_US = 24 * 60 * 60 * 1_000_000
PLACES = "decimal(38, 6)"


def fragments(events: DataFrame) -> DataFrame:
    """(user_id, from_us, to_us, events, spend): each event an interval of its own. Null users are one user; null times are left out; null or non-finite values count 0."""
    value = F.when(F.isnan("value") | (F.abs("value") == float("inf")), None).otherwise(F.col("value"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.where(F.col("ts").isNotNull()).select("user_id", at.alias("from_us"), at.alias("to_us"), F.lit(1).cast("long").alias("events"), F.coalesce(value.cast(PLACES), F.lit(0)).cast(PLACES).alias("spend"))


def _islands(parts: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy("from_us", "to_us")
    reach = F.max("to_us").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("cut", F.when(F.col("from_us") - reach > gap_us, 1).otherwise(0))
    island = F.sum("cut").over(by.rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("island", island).groupBy(*keys, "island").agg(F.min("from_us").alias("from_us"), F.max("to_us").alias("to_us"), F.sum("events").alias("events"), F.sum("spend").cast(PLACES).alias("spend"))
    return out.drop("island")


def merged(parts: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Intervals of a user that lie at most a gap apart become one. Sums are exact, so their order doesn't matter.

    First within each day of a user, so that no task sorts all events of a busy
    one, then among the intervals that are left.
    """
    days = _islands(parts.withColumn("day", F.expr(f"from_us div {DAY_US}")), ["user_id", "day"], gap_us)
    return _islands(days.drop("day"), ["user_id"], gap_us)


def over_days(sessions: DataFrame) -> DataFrame:
    """Sessions once for each day they touch: what lies in them is then found by user and day."""
    return sessions.withColumn("day", F.explode(F.expr(f"sequence(from_us div {DAY_US}, to_us div {DAY_US})")))


class SessionView:
    """The view in a keyed table; add and remove take batches with numbers that grow, each once."""

    def __init__(self, spark: SparkSession, folder: str, gap_us: int = GAP_US, buckets: int = 64):
        self.gap_us, self.table = gap_us, KeyedTable(spark, folder, ["user_id"], buckets)

    def add(self, events: DataFrame, number: int) -> bool:
        fresh = merged(fragments(events), self.gap_us)
        return self.table.apply(fresh, number, self._joined)

    def _joined(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Sessions of users without news pass through unsorted; the others' meet their news."""
        users = new.select(F.col("user_id").alias("touched")).distinct()
        same = old["user_id"].eqNullSafe(users["touched"])
        stay, meet = old.join(users, same, "left_anti"), old.join(users, same, "left_semi")
        return stay.unionByName(merged(meet.unionByName(new), self.gap_us))

    def remove(self, gone: DataFrame, left: DataFrame, number: int) -> bool:
        """gone: the events taken away; left: those that are still there (the sessions that held one of gone are read from it again)."""

        def rebuilt(old: DataFrame, new: DataFrame) -> DataFrame:
            dated = lambda x: fragments(x).withColumn("day", F.expr(f"from_us div {DAY_US}"))
            g, inside = dated(gone).select(F.col("user_id").alias("u"), F.col("from_us").alias("at"), "day").alias("g"), "{0}.day = s.day AND {0}.{1} <=> s.user_id AND {0}.{2} BETWEEN s.from_us AND s.to_us"
            hit = over_days(old).alias("s").join(g, F.expr(inside.format("g", "u", "at")), "left_semi")
            broken = cut(hit.select("user_id", "from_us", "to_us").distinct(), "broken-sessions")
            stay = old.alias("s").join(broken.alias("b"), F.expr("s.user_id <=> b.user_id AND s.from_us = b.from_us"), "left_anti")
            again = dated(left).alias("e").join(over_days(broken).alias("s"), F.expr(inside.format("e", "user_id", "from_us")), "left_semi").drop("day")
            return stay.unionByName(merged(again, self.gap_us))

        return self.table.apply(fragments(gone), number, rebuilt)

    def read(self) -> DataFrame:
        """user_id, session (from 0, in order of time), started, ended, events, spend."""
        held = self.table.read()
        if held is None:
            raise ValueError("the view has had no batch yet")
        number = F.row_number().over(Window.partitionBy("user_id").orderBy("from_us")) - 1
        return held.select("user_id", number.cast("long").alias("session"), F.timestamp_micros("from_us").alias("started"), F.timestamp_micros("to_us").alias("ended"), "events", F.col("spend").cast("double").alias("spend"))


def s5_session_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events that come in three batches in no order of time; then one in ten is taken away again."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value")
    view = SessionView(spark, new_folder(spark, "session-view"), buckets=16)
    for n in range(3):
        view.add(events.where(F.pmod("event_id", F.lit(3)) == n), n)
    view.remove(events.where("event_id % 10 = 7"), events.where("event_id % 10 <> 7"), 3)
    return view.read().select("user_id", "session", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "events", F.round("spend", 4).alias("spend"))


QUERIES = {"s5_session_view": s5_session_view}
#: From the events that are left, at once: an event starts a session if no other of its user lies in the gap before it.
ORACLE_SQL = {
    "s5_session_view": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, value FROM events WHERE event_id % 10 <> 7),
        f AS (SELECT DISTINCT a.user_id, a.t FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.t < a.t AND a.t - b.t <= 1800000000)),
        s AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS session, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), 9e18::BIGINT) AS next FROM f)
        SELECT s.user_id, s.session, min(e.t) AS started, max(e.t) AS ended, count(*) AS events, round(sum(value), 4) AS spend FROM s JOIN e ON e.user_id = s.user_id AND e.t >= s.t AND e.t < s.next GROUP BY s.user_id, s.session""",
}
