"""Guards over what is held: reads of what is still resident, actions on what may not be touched, tools that nobody uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys that are sent to all tasks at most.
SENT = 1_000_000
#: Calls a week of a useful tool, and of one that goes if it was idle for longer than so many days; days below which nothing goes.
HIGH, LOW, IDLE_DAYS, LEAST_DAYS = 1.0, 0.1, 30, 14


def guarded(actions: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """actions with blocked: whether the key is among those of held. A null or empty key is never blocked.

    held may be any table with the key, repeated or not. Its distinct keys are
    counted and sent to all tasks, or, if they are many, joined, which Spark may
    precede by a filter at the scan.
    """
    keys = held.select(key).where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).distinct().withColumn("_held", F.lit(True))
    if keys.limit(SENT + 1).count() <= SENT:
        keys = F.broadcast(keys)
    return actions.join(keys, key, "left").withColumn("blocked", F.coalesce("_held", F.lit(False))).drop("_held").select(*actions.columns, "blocked")


def read_gate(reads: DataFrame, session: str = "session", turn: str = "turn", path: str = "path", digest: str = "digest", epoch: str = "epoch", tokens: str = "tokens") -> DataFrame:
    """reads with decision, reason, reclaimed and first_turn, turn by turn of a session.

    A read is denied if its path was read with the same content in the same
    epoch. A later epoch (the first is 0) clears all that is resident; a read of
    an earlier one proves nothing and isn't kept. first_turn: since when the
    content is resident, if the read is denied. Null digests are never the same;
    null tokens count 0. Turns of a session are distinct. Sorts by session and
    by session, epoch and path; nothing else.
    """
    by = Window.partitionBy(session).orderBy(turn)
    now = F.greatest(F.lit(0), F.coalesce(F.max(epoch).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = reads.withColumn("_now", now).withColumn("_kept", F.coalesce(F.col(epoch) >= F.col("_now"), F.lit(False)))
    one = Window.partitionBy(session, epoch, path, "_kept").orderBy(turn)
    d = d.withColumn("_last", F.lag(digest).over(one)).withColumn("_new", F.when(F.col(digest) == F.col("_last"), 0).otherwise(1)).withColumn("_nth", F.row_number().over(one))
    since = F.max(F.when(F.col("_new") == 1, F.col(turn))).over(one.rowsBetween(Window.unboundedPreceding, 0))
    reason = F.when(~F.coalesce(F.col(epoch) == F.col("_now"), F.lit(False)), "epoch_advanced").when(F.col("_nth") == 1, "not_resident").when(F.col("_new") == 1, "content_changed").otherwise("already_resident")
    d = d.withColumn("_since", since).withColumn("reason", reason)
    deny = F.col("reason") == "already_resident"
    out = d.withColumns({"decision": F.when(deny, "deny").otherwise("allow"), "reclaimed": F.when(deny, F.greatest(F.lit(0), F.coalesce(tokens, F.lit(0)))).otherwise(0).cast("long"), "first_turn": F.when(deny, F.col("_since"))})
    return out.select(*reads.columns, "decision", "reason", "reclaimed", "first_turn")


def tool_audit(tools: DataFrame, window_days: float, sessions: int, high: float = HIGH, low: float = LOW, idle_days: float = IDLE_DAYS, least_days: float = LEAST_DAYS) -> DataFrame:
    """tools (name, tokens, calls, idle_days, loaded, protected) with per_week, utility, wasted_per_week and remove.

    Null calls and loads count 0, a null idle time is for ever. A protected tool
    is critical; else the calls a week and the idle time decide. Waste is what
    definitions cost in sessions that don't use the tool. Nothing goes while the
    window is shorter than least_days.
    """
    weeks = max(window_days / 7, 1e-9)
    calls, loaded = F.coalesce("calls", F.lit(0)), F.coalesce("loaded", F.lit(0))
    rate = F.when(loaded > 0, F.least(F.lit(1.0), calls / loaded)).otherwise(0.0)
    d = tools.withColumns({"per_week": calls / weeks, "wasted_per_week": sessions / weeks * F.col("tokens") * (1 - rate)})
    idle = F.col("idle_days").isNull() | (F.col("idle_days") > idle_days)
    utility = F.when(F.coalesce("protected", F.lit(False)), "critical").when(F.col("per_week") >= high, "high").when((F.col("per_week") < low) & idle, "waste").otherwise("low")
    return d.withColumn("utility", utility).withColumn("remove", (F.col("utility") == "waste") & F.lit(window_days >= least_days))


def f33_read_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reads: a type is a path, props are content, a week is an epoch, and some come from the week before."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    week = F.expr("CAST(floor(datediff(CAST(ts AS DATE), DATE '2024-01-01') / 7) AS BIGINT)") - F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    content = F.floor(F.get_json_object("props", "$.k").cast("long") / 50)
    reads = e.select(F.col("user_id").alias("session"), order.alias("turn"), F.col("event_type").alias("path"), content.alias("digest"), week.alias("epoch"), F.floor("value").cast("long").alias("tokens"))
    return read_gate(reads).select("session", "turn", "decision", "reason", "reclaimed", F.col("first_turn").cast("long").alias("first_turn"))


def j12_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose part a returned line of 1998 anchors."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    anchored = lines.where("l_returnflag = 'R' AND l_shipdate >= DATE '1998-01-01'").select("l_partkey")
    return guarded(lines.select("l_orderkey", "l_linenumber", "l_partkey"), anchored, "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("blocked"))


def a12_tool_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tools with their lines as calls, over the whole span of the orders; brands ending in 1 are protected."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    span = lines.agg(F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).alias("days"), F.max("l_shipdate").alias("last"), F.count_distinct("l_orderkey").alias("orders")).first()
    used = lines.groupBy(F.col("l_partkey").alias("name")).agg(F.count("*").alias("calls"), F.count_distinct("l_orderkey").alias("loaded"), F.datediff(F.lit(span["last"]), F.max("l_shipdate")).alias("idle_days"))
    tools = part.select(F.col("p_partkey").alias("name"), (F.col("p_size") * 10).alias("tokens"), F.col("p_brand").endswith("1").alias("protected")).join(used, "name", "left")
    out = tool_audit(tools, float(span["days"]), span["orders"])
    return out.select("name", F.round("per_week", 6).alias("per_week"), "utility", F.round("wasted_per_week", 4).alias("wasted_per_week"), "remove")


QUERIES = {f.__name__: f for f in (f33_read_gate, j12_guarded, a12_tool_utility)}
#: The gate by looking back from each read for the reads that could have made it resident.
ORACLE_SQL = {
    "f33_read_gate": """WITH e AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_type AS path, CAST(floor(CAST(props::JSON->>'k' AS BIGINT) / 50) AS BIGINT) AS digest, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7e0) AS BIGINT) - CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS epoch, CAST(floor(value) AS BIGINT) AS tokens FROM events),
        m AS (SELECT a.session, a.turn, greatest(0, coalesce(max(b.epoch), 0)) AS now FROM e a LEFT JOIN e b ON a.session = b.session AND b.turn < a.turn GROUP BY a.session, a.turn), r AS (SELECT e.*, now, epoch >= now AS kept FROM e JOIN m USING (session, turn)),
        p AS (SELECT a.session, a.turn, max(b.turn) AS before FROM r a JOIN r b ON a.session = b.session AND a.path = b.path AND a.epoch = b.epoch AND b.kept AND b.turn < a.turn WHERE a.kept GROUP BY a.session, a.turn),
        q AS (SELECT r.*, b.digest AS last, p.before FROM r LEFT JOIN p USING (session, turn) LEFT JOIN r b ON b.session = r.session AND b.turn = p.before),
        s AS (SELECT *, CASE WHEN epoch <> now THEN 'epoch_advanced' WHEN before IS NULL THEN 'not_resident' WHEN digest <> last THEN 'content_changed' ELSE 'already_resident' END AS reason FROM q),
        f AS (SELECT a.session, a.turn, max(b.turn) AS first_turn FROM s a JOIN s b ON a.session = b.session AND a.path = b.path AND a.epoch = b.epoch AND b.kept AND b.turn < a.turn AND (b.before IS NULL OR b.digest <> b.last) WHERE a.reason = 'already_resident' GROUP BY a.session, a.turn)
        SELECT s.session, s.turn, CASE WHEN reason = 'already_resident' THEN 'deny' ELSE 'allow' END AS decision, reason, CASE WHEN reason = 'already_resident' THEN greatest(0, tokens) ELSE 0 END AS reclaimed, first_turn FROM s LEFT JOIN f USING (session, turn)""",
    "j12_guarded": "SELECT l_partkey, count(*) AS n, CASE WHEN l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= DATE '1998-01-01') THEN count(*) ELSE 0 END AS blocked FROM lineitem GROUP BY l_partkey",
    "a12_tool_utility": """WITH w AS (SELECT date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)) / 7e0 AS weeks, CAST(max(l_shipdate) AS DATE) AS last, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS orders FROM lineitem),
        u AS (SELECT l_partkey AS name, count(*) AS calls, count(DISTINCT l_orderkey) AS loaded, CAST(max(l_shipdate) AS DATE) AS used FROM lineitem GROUP BY l_partkey),
        t AS (SELECT p_partkey AS name, p_size * 10 AS tokens, p_brand LIKE '%1' AS protected, coalesce(calls, 0) AS calls, coalesce(loaded, 0) AS loaded, date_diff('day', used, last) AS idle, weeks, orders FROM part LEFT JOIN u ON p_partkey = name, w),
        k AS (SELECT *, calls / weeks AS per_week, orders / weeks * tokens * (1 - CASE WHEN loaded > 0 THEN least(1e0, calls / CAST(loaded AS DOUBLE)) ELSE 0e0 END) AS wasted, CASE WHEN protected THEN 'critical' WHEN calls / weeks >= 1 THEN 'high' WHEN calls / weeks < 0.1e0 AND (idle IS NULL OR idle > 30) THEN 'waste' ELSE 'low' END AS utility FROM t)
        SELECT name, round(per_week, 6) AS per_week, utility, round(wasted, 4) AS wasted_per_week, utility = 'waste' AND weeks >= 2 AS remove FROM k""",
}
