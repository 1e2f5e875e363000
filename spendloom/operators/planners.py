"""Cache planners, resend costs, breakers, relevance, routing and recommendations, as functions of any tables; their SQL is written apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.spread import dealt_joins

READ, WRITE = 0.1, {"5m": 1.25, "1h": 2.0}
#: What a request asks for, in the order in which they are tried.
INTENTS = {
    "debug": ["debug", "fix the bug", "stack trace", "error message", "exception", "fails with", "broken"],
    "test": ["write a test", "add tests", "test case", "unit test", "integration test"],
    "refactor": ["refactor", "rename", "extract", "inline", "split", "consolidate", "move"],
    "generate": ["create", "implement", "add a", "write a", "build a", "scaffold"],
    "explain": ["explain", "what does", "how does", "walk me through", "summarize"],
    "retrieve": ["find", "locate", "where is", "list all", "show me"],
    "format": ["format", "prettify", "reformat", "indent"],
    "classify": ["which", "is this", "does this", "true or false"],
}
#: Verbs of trivial requests and signs of hard ones.
TRIVIAL = ["rename", "format", "prettify", "indent", "spell-check", "lowercase", "uppercase", "sort", "remove duplicates"]
HARD = ["across the codebase", "throughout the project", "every file", "performance bottleneck", "race condition", "concurrency", "deadlock", "memory leak", "data corruption", "schema migration", "refactor the entire", "rewrite", "redesign"]


def recompression(segments: DataFrame, keys: list[str], pos: str, ttl: str = "5m") -> DataFrame:
    """keys, bust_at, saved, rebuild, break_even, recommend: the suffix of a prefix that is best compressed again.

    segments holds saved (tokens a turn less), rebuild (tokens written anew) and
    remaining (turns to come, the same for a key). Of starts with equal net the
    later one is taken. A key in which nothing is saved has nulls and isn't
    recommended. Null amounts count as 0.
    """
    onward = Window.partitionBy(*keys).orderBy(pos).rowsBetween(0, Window.unboundedFollowing)
    amount = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long")
    out = segments.select(*keys, pos, amount("saved").alias("own"), amount("rebuild").alias("r"), amount("remaining").alias("left"))
    out = out.withColumn("saved", F.sum("own").over(onward)).withColumn("rebuild", F.sum("r").over(onward))
    net = F.col("left") * F.col("saved") * F.lit(READ) - F.col("rebuild") * F.lit(WRITE[ttl])
    out = out.withColumn("choice", F.when(F.col("own") > 0, F.struct(net.alias("net"), F.col(pos).alias("bust_at"), "saved", "rebuild", "left")))
    best = out.groupBy(*keys).agg(F.max("choice").alias("b"))
    even = F.col("b.rebuild") * F.lit(WRITE[ttl]) / (F.lit(READ) * F.col("b.saved"))
    return best.select(*keys, "b.bust_at", F.coalesce("b.saved", F.lit(0)).alias("saved"), F.coalesce("b.rebuild", F.lit(0)).alias("rebuild"), F.round(even, 6).alias("break_even"), F.coalesce(F.col("b.left") >= even, F.lit(False)).alias("recommend"))


def delta_resend(previous: DataFrame, following: DataFrame, keys: list[str], pos: str, digest: str, tokens: str, least: int, usd: float, ttl: str = "5m") -> DataFrame:
    """What of a key's former blocks survives in its following ones, and what sending costs.

    The first position where both have a block and digests differ breaks the
    prefix; without one, appended blocks follow it. Later blocks that stayed the
    same are stranded. Blocks are numbered from 0. Null digests are equal to each
    other; null tokens count as 0. Keys without following blocks have no row.
    """
    a = previous.select(*keys, pos, F.col(digest).alias("was"), F.lit(True).alias("had"))
    b = following.select(*keys, pos, F.col(digest).alias("now"), F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long").alias("t"))
    size = previous.groupBy(*keys).agg(F.count(F.lit(1)).alias("before"))
    both = b.join(a, [*keys, pos], "left").withColumn("same", F.when(F.col("had"), F.col("was").eqNullSafe(F.col("now"))))
    of = Window.partitionBy(*keys)
    both = both.withColumn("broken", F.min(F.when(~F.col("same"), F.col(pos))).over(of)).join(size, keys, "left")
    first = F.coalesce("broken", "before", F.lit(0))
    kept, stranded = F.col(pos) < first, F.col("same") & (F.col(pos) > F.col("broken"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("t"))), F.lit(0))
    out = both.groupBy(*keys).agg(F.max("broken").alias("broken"), F.max(F.coalesce("before", F.lit(0))).alias("before"), F.count(F.lit(1)).alias("n"), total(kept).alias("surviving"), total(~kept).alias("rewritten"), total(stranded).alias("stranded"))
    w = WRITE[ttl]
    diverged = F.when(F.col("broken").isNotNull(), F.col("broken")).when(F.col("n") > F.col("before"), F.col("before"))
    full = (F.col("surviving") + F.col("rewritten")) * F.lit(w * usd / 1e6)
    held = F.col("surviving") >= least
    return out.select(*keys, diverged.cast("long").alias("diverged_at"), "surviving", "rewritten", "stranded", held.alias("cacheable"), F.round(full, 8).alias("bust_usd"), F.round(F.when(held, F.col("surviving") * F.lit((w - READ) * usd / 1e6)).otherwise(0.0), 8).alias("saved_usd"))


def breakpoints(blocks: DataFrame, keys: list[str], pos: str, least: int, most: int = 4) -> DataFrame:
    """keys, pos, cumulative: ends of runs of stable blocks that are worth a cache breakpoint, at most `most` a key.

    blocks holds segment, tokens and volatile. A volatile block starts the count
    again; a run ends before one, at a segment's end and at the key's end. The
    longest are kept, of equal ones the later. Null volatility counts as volatile.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    b = blocks.select(*keys, pos, "segment", "tokens", F.coalesce("volatile", F.lit(True)).alias("v"))
    b = b.withColumn("run", F.sum(F.col("v").cast("int")).over(w)).withColumn("next_v", F.lead("v").over(w)).withColumn("next_s", F.lead("segment").over(w))
    b = b.withColumn("cumulative", F.sum(F.when(~F.col("v"), F.col("tokens"))).over(Window.partitionBy(*keys, "run").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))
    ends = b.where(~F.col("v") & (F.col("next_v").isNull() | F.col("next_v") | ~F.col("next_s").eqNullSafe(F.col("segment"))) & (F.col("cumulative") >= least))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cumulative"), F.desc(pos)))
    return ends.withColumn("_rank", rank).where(F.col("_rank") <= most).select(*keys, pos, "cumulative")


def breaker(outcomes: DataFrame, scope: list[str], order: list[str], ts: str, ok: str, window: int = 100, least: int = 10, rate: float = 0.02, cooldown: str = "INTERVAL 24 HOURS") -> DataFrame:
    """outcomes with misses, seen (of the last `window`) and disabled (a miss within the cooldown took the rate over its limit).

    Null outcomes are misses. The last column of order breaks ties.
    """
    w = Window.partitionBy(*scope).orderBy(*order)
    last = w.rowsBetween(1 - window, 0)
    miss = ~F.coalesce(F.col(ok), F.lit(False))
    out = outcomes.withColumn("misses", F.sum(miss.cast("long")).over(last)).withColumn("seen", F.count(F.lit(1)).over(last))
    trip = F.when(miss & (F.col("seen") >= least) & (F.col("misses") / F.col("seen") > rate), F.col(ts))
    return out.withColumn("disabled", F.coalesce(F.max(trip).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.expr(cooldown) > F.col(ts), F.lit(False)))


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " "), r"\s+"), lambda x: F.length(x) > 1)


def relevance(pairs: DataFrame, keys: list[str], prompt: str, block: str) -> DataFrame:
    """keys, score, matched, category: cosine of tf-idf over the two texts alone, and 0.05 for each shared term up to 0.3.

    keys must tell rows apart. A pair with a text that is null or has no terms
    scores 0.5. Terms are words of two or more of a-z, 0-9 and _.
    """
    sides = pairs.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("s"), _terms(F.col(prompt)).alias("t")), F.struct(F.lit(1).alias("s"), _terms(F.col(block)).alias("t")))).alias("x"))
    terms = sides.select(*keys, "x.s", F.explode_outer("x.t").alias("t"))
    count = lambda s: F.sum(F.when((F.col("s") == s) & F.col("t").isNotNull(), 1).otherwise(0))
    c = terms.groupBy(*keys, "t").agg(count(0).alias("a"), count(1).alias("b"))
    idf = F.when((F.col("a") > 0) & (F.col("b") > 0), 1.0).otherwise(F.log(F.lit(1.5)) + 1)
    x, y = F.col("a") * idf, F.col("b") * idf
    g = c.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(((F.col("a") > 0) & (F.col("b") > 0)).cast("long")).alias("matched"))
    score = F.when((F.col("na") == 0) | (F.col("nb") == 0), 0.5).otherwise(F.least(F.lit(1.0), F.col("xy") / (F.sqrt("xx") * F.sqrt("yy")) + F.least(F.lit(0.3), F.col("matched") * 0.05)))
    g = g.withColumn("score", F.round(score, 6))
    return g.select(*keys, "score", "matched", F.when((F.col("na") == 0) | (F.col("nb") == 0), "peripheral").when(F.col("score") >= 0.7, "relevant").when(F.col("score") >= 0.4, "peripheral").otherwise("noise").alias("category"))


def route(requests: DataFrame, prompt: str, tokens: str, files: str, failed: str) -> DataFrame:
    """requests with intent and difficulty. A null prompt has no keyword; null amounts count as 0, a null failure as none."""
    low = F.lower(F.coalesce(F.col(prompt), F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda x: F.contains(low, x))
    intent = F.when(F.coalesce(F.col(failed), F.lit(False)), "debug")
    for name, words in INTENTS.items():
        intent = intent.when(has(words), name)
    size = F.coalesce(F.col(tokens), F.lit(0))
    hard = has(HARD) | (size > 20000) | (F.coalesce(F.col(files), F.lit(0)) >= 6) | (F.col("intent") == "debug")
    return requests.withColumn("intent", intent.otherwise("generate")).withColumn("difficulty", F.when((size <= 600) & has(TRIVIAL), "trivial").when(hard, "hard").otherwise("standard"))


def tab_audit(tabs: DataFrame, keys: list[str], drop: float = 0.35) -> DataFrame:
    """tabs with relevance and keep. Columns: hops, opened, task_match, tokens, active, dirty.

    Adjacency is 0.6 ^ hops; recency is the place of opened between a key's
    oldest and newest; absent signals give their weight to the others (a null
    opened is 0.5 if the key knows any). Active and dirty tabs are kept.
    """
    w = Window.partitionBy(*keys)
    at, lo, hi = F.col("opened").cast("double"), F.min(F.col("opened").cast("double")).over(w), F.max(F.col("opened").cast("double")).over(w)
    recency = F.when(lo.isNotNull(), F.when(at.isNull(), 0.5).when(lo == hi, 1.0).otherwise((at - lo) / (hi - lo)))
    parts = [(0.4, F.pow(F.lit(0.6), F.col("hops"))), (0.2, recency), (0.3, F.when(F.col("task_match").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("task_match"))))), (0.1, F.when(F.col("tokens") >= 0, 2000 / (2000 + F.col("tokens"))))]
    got = sum(F.coalesce(F.lit(k) * x, F.lit(0.0)) for k, x in parts)
    weight = sum(F.when(x.isNotNull(), k).otherwise(0.0) for k, x in parts)
    out = tabs.withColumn("relevance", F.round(F.when(weight > 0, got / weight).otherwise(0.0), 6))
    return out.withColumn("keep", F.coalesce(F.col("active"), F.lit(False)) | F.coalesce(F.col("dirty"), F.lit(False)) | (F.col("relevance") >= drop))


def non_inferior(k1: Column, n1: Column, k0: Column, n0: Column, margin: float, z: float = 1.6448536269514722) -> Column:
    """Whether a share k1 / n1 is less than margin below k0 / n0 (z of the normal test; false without rows)."""
    p1, p0 = k1 / F.nullif(n1, F.lit(0)), k0 / F.nullif(n0, F.lit(0))
    se = F.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    return F.coalesce(F.when(se > 0, (p1 - p0 + margin) / F.nullif(se, F.lit(0.0)) >= z).otherwise(p1 - p0 + margin > 0), F.lit(False))


def recommend(runs: DataFrame, cluster: str, arm: str, baseline: str, least: int = 30, ar: float = 0.05, tpr: float = 0.03, ratio: float = 0.7) -> DataFrame:
    """cluster, arm, cost_ratio, gates and recommended: arms beside the baseline of each cluster. runs holds accepted, tested (null: no test) and cost."""
    ok = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    g = runs.groupBy(cluster, arm).agg(F.count(F.lit(1)).alias("n"), ok("accepted").alias("k"), F.count("tested").alias("tn"), ok("tested").alias("tk"), F.avg("cost").alias("cost"))
    base = g.where(F.col(arm) == baseline).select(cluster, *[F.col(c).alias(f"{c}0") for c in ("n", "k", "tn", "tk", "cost")])
    c = F.col
    tests = F.when((c("tn") == 0) & (c("tn0") == 0), True).when(c("tn") == 0, False).otherwise(non_inferior(c("tk"), c("tn"), c("tk0"), F.greatest(c("tn0"), F.lit(1)), tpr))
    cost = F.when(c("cost0") > 0, c("cost") / c("cost0"))
    out = g.where(c(arm) != baseline).join(base, cluster).select(cluster, arm, "n", F.round(cost, 6).alias("cost_ratio"), ((c("n") >= least) & (c("n0") >= least)).alias("enough"), non_inferior(c("k"), c("n"), c("k0"), c("n0"), ar).alias("accepted_gate"), tests.alias("tested_gate"), F.coalesce(cost <= ratio, F.lit(False)).alias("cost_gate"))
    return out.withColumn("recommended", c("enough") & c("accepted_gate") & c("tested_gate") & c("cost_gate"))


def supersede(facts: DataFrame, keys: list[str], order: list[str], content: list[str]) -> DataFrame:
    """facts, one for each content, with fact_id (its digest) and current (the latest of its keys).

    Storing the same keys and content again changes nothing: the earliest row
    counts. The last column of order breaks ties.
    """
    same = Window.partitionBy(*keys, *content).orderBy(*order)
    once = facts.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").drop("_nth")
    latest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return once.withColumn("fact_id", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in [*keys, *content]]), 256)).withColumn("current", F.row_number().over(latest) == 1)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokens(text: str = "text") -> Column:
    return F.ceil(F.length(F.coalesce(F.col(text), F.lit(""))) / 4).cast("long")


def f35_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "conversations").withColumn("tokens", _tokens())
    saved = F.when(F.col("role") == "user", 0).otherwise(F.floor(F.col("tokens") * 0.4))
    return recompression(t.withColumn("saved", saved).withColumn("rebuild", F.col("tokens") - saved).withColumn("remaining", F.col("conv_id") % 40), ["conv_id"], "turn")


def f36_delta_resend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation after its last turn beside its state before; every third one's turn 1 was edited in between."""
    t = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", _tokens().alias("tokens"))
    before = t.withColumn("last", F.max("turn").over(Window.partitionBy("conv_id"))).where("turn < last").withColumn("digest", F.sha2("text", 256))
    after = t.withColumn("digest", F.sha2(F.when((F.col("turn") == 1) & (F.col("conv_id") % 3 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256))
    return delta_resend(before, after, ["conv_id"], "turn", "digest", "tokens", 100, 3.0)


def f37_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("segment"), _tokens().alias("tokens"), (F.col("turn") % 5 == 3).alias("volatile"))
    return breakpoints(t, ["conv_id"], "turn", 64)


def t25_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    return breaker(e, ["user_id"], ["ts", "event_id"], "ts", "ok").select("event_id", "misses", "seen", "disabled")


def t4_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn beside the one before it."""
    t = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text").withColumn("prompt", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return relevance(t.where("prompt IS NOT NULL"), ["conv_id", "turn"], "prompt", "text")


def f26_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "conversations").where("role = 'user'").withColumn("tokens", _tokens()).withColumn("failed", F.contains(F.lower("text"), F.lit("error")))
    return route(t, "text", "tokens", "turn", "failed").select("conv_id", "turn", "intent", "difficulty")


def f28_tab_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as tabs."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("tab"), F.when(F.col("o_orderstatus") != "P", F.substring("o_orderpriority", 1, 1).cast("int")).alias("hops"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("opened"), F.when(F.col("o_orderstatus") == "F", 0.25).alias("task_match"), F.floor("o_totalprice").alias("tokens"), (F.col("o_totalprice") > 400000).alias("active"), (F.col("o_totalprice") < 1000).alias("dirty"))
    return tab_audit(o, ["session"]).select("session", "tab", "relevance", "keep")


def q8_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models (the arms) of each market segment against the one of finished returns."""
    t = dealt_joins({name: _read(spark, sf_dir, name) for name in ("lineitem", "orders", "customer")})
    j = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    runs = j.select(F.col("c_mktsegment").alias("segment"), F.concat("l_returnflag", "l_linestatus").alias("model"), (F.col("l_discount") > 0.02).alias("accepted"), F.when(F.col("l_tax") > 0.01, F.col("l_tax") > 0.02).alias("tested"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity") * 0.5).otherwise(F.col("l_quantity")).cast("decimal(18,4)").alias("cost"))
    return recommend(runs, "segment", "model", "RF")


def f44_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user did last of each kind, by its value."""
    e = _read(spark, sf_dir, "events").withColumn("cell", F.floor("value").cast("long"))
    return supersede(e, ["user_id", "event_type"], ["ts", "event_id"], ["cell"]).select("event_id", "user_id", "event_type", "cell", "fact_id", "current")


QUERIES = {f.__name__: f for f in (f26_route, f28_tab_audit, f35_recompression, f36_delta_resend, f37_breakpoints, f44_supersede, q8_recommend, t4_relevance, t25_breaker)}


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"p LIKE '%{w}%'" for w in words) + ")"


_T = "SELECT conv_id, turn, role, text, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM conversations"
#: By self-joins over positions, where the functions use windows.
ORACLE_SQL = {
    "f26_route": f"WITH t AS (SELECT *, lower(coalesce(text, '')) AS p FROM ({_T}) WHERE role = 'user'), i AS (SELECT *, CASE WHEN p LIKE '%error%' THEN 'debug' " + " ".join(f"WHEN {_any(w)} THEN '{k}'" for k, w in INTENTS.items()) + f" ELSE 'generate' END AS intent FROM t) SELECT conv_id, turn, intent, CASE WHEN tokens <= 600 AND {_any(TRIVIAL)} THEN 'trivial' WHEN {_any(HARD)} OR tokens > 20000 OR turn >= 6 OR intent = 'debug' THEN 'hard' ELSE 'standard' END AS difficulty FROM i",
    "f28_tab_audit": """WITH s AS (SELECT o_custkey, epoch_us(CAST(min(o_orderdate) AS TIMESTAMP)) AS lo, epoch_us(CAST(max(o_orderdate) AS TIMESTAMP)) AS hi FROM orders GROUP BY o_custkey), t AS (SELECT o.*, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS moment, lo, hi FROM orders o JOIN s USING (o_custkey)),
        r AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN 0.4e0 * power(0.6e0, CAST(substr(o_orderpriority, 1, 1) AS INT)) ELSE 0 END + 0.2e0 * CASE WHEN hi = lo THEN 1 ELSE (moment - lo)::DOUBLE / (hi - lo) END + CASE WHEN o_orderstatus = 'F' THEN 0.075e0 ELSE 0 END + 200e0 / (2000 + floor(o_totalprice)) AS g, CASE o_orderstatus WHEN 'F' THEN 1e0 WHEN 'P' THEN 0.3e0 ELSE 0.7e0 END AS w FROM t)
        SELECT o_custkey AS session, o_orderkey AS tab, round(g / w, 6) AS relevance, round(g / w, 6) >= 0.35e0 OR o_totalprice > 400000 OR o_totalprice < 1000 AS keep FROM r""",
    "f35_recompression": f"""WITH t AS (SELECT *, CASE WHEN role = 'user' THEN 0 ELSE CAST(floor(tokens * 0.4e0) AS BIGINT) END AS s FROM ({_T})), p AS (SELECT a.conv_id, a.turn AS p, a.conv_id % 40 AS left_, sum(b.s) AS saved, sum(b.tokens - b.s) AS rebuild FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn >= a.turn WHERE a.s > 0 GROUP BY a.conv_id, a.turn),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY left_ * saved * 0.1e0 - rebuild * 1.25e0 DESC, p DESC) AS k FROM p) SELECT c.conv_id, n.p AS bust_at, CAST(coalesce(saved, 0) AS BIGINT) AS saved, CAST(coalesce(rebuild, 0) AS BIGINT) AS rebuild, round(rebuild * 1.25e0 / (0.1e0 * saved), 6) AS break_even, coalesce(left_ >= rebuild * 1.25e0 / (0.1e0 * saved), false) AS recommend FROM (SELECT DISTINCT conv_id FROM t) c LEFT JOIN n ON n.conv_id = c.conv_id AND k = 1""",
    "f36_delta_resend": f"""WITH t AS ({_T}), z AS (SELECT conv_id, max(turn) AS last, bool_or(turn = 1 AND text IS NOT NULL) AND conv_id % 3 = 0 AND max(turn) > 1 AS edited FROM t GROUP BY conv_id), s AS (SELECT t.conv_id, max(CASE WHEN edited THEN 1 ELSE last END) AS d, sum(CASE WHEN turn < CASE WHEN edited THEN 1 ELSE last END THEN tokens ELSE 0 END) AS surviving, sum(tokens) AS total, sum(CASE WHEN edited AND turn > 1 AND turn < last THEN tokens ELSE 0 END) AS stranded FROM t JOIN z USING (conv_id) GROUP BY t.conv_id)
        SELECT conv_id, CAST(d AS BIGINT) AS diverged_at, CAST(surviving AS BIGINT) AS surviving, CAST(total - surviving AS BIGINT) AS rewritten, CAST(stranded AS BIGINT) AS stranded, surviving >= 100 AS cacheable, round(total * 3.75e0 / 1e6, 8) AS bust_usd, CASE WHEN surviving >= 100 THEN round(surviving * 3.45e0 / 1e6, 8) ELSE 0e0 END AS saved_usd FROM s""",
    "f37_breakpoints": f"""WITH t AS ({_T}), e AS (SELECT a.conv_id, a.turn, a.role, coalesce((SELECT max(b.turn) FROM t b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.turn % 5 = 3), -1) AS since FROM t a LEFT JOIN t n ON n.conv_id = a.conv_id AND n.turn = a.turn + 1 WHERE a.turn % 5 <> 3 AND (n.turn IS NULL OR n.turn % 5 = 3 OR n.role <> a.role)),
        c AS (SELECT e.conv_id, e.turn, CAST(sum(t.tokens) AS BIGINT) AS cumulative FROM e JOIN t ON t.conv_id = e.conv_id AND t.turn > e.since AND t.turn <= e.turn GROUP BY e.conv_id, e.turn HAVING sum(t.tokens) >= 64) SELECT conv_id, turn, cumulative FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cumulative DESC, turn DESC) <= 4""",
    "f44_supersede": r"""WITH o AS (SELECT event_id, user_id, event_type, ts, CAST(floor(value) AS BIGINT) AS cell FROM events), f AS (SELECT * FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE a.user_id = b.user_id AND a.event_type = b.event_type AND a.cell IS NOT DISTINCT FROM b.cell AND (b.ts < a.ts OR b.ts = a.ts AND b.event_id < a.event_id))),
        l AS (SELECT user_id, event_type, max((ts, event_id)) AS m FROM f GROUP BY ALL) SELECT event_id, f.user_id, f.event_type, cell, sha256(f.user_id || chr(31) || f.event_type || chr(31) || coalesce(CAST(cell AS VARCHAR), chr(0))) AS fact_id, (ts, event_id) = m AS current FROM f JOIN l ON f.user_id = l.user_id AND f.event_type = l.event_type""",
    "q8_recommend": """WITH g AS (SELECT c_mktsegment AS segment, l_returnflag || l_linestatus AS model, count(*)::DOUBLE AS n, count(*) FILTER (l_discount > 0.02e0)::DOUBLE AS k, count(*) FILTER (l_tax > 0.01e0)::DOUBLE AS tn, count(*) FILTER (l_tax > 0.02e0)::DOUBLE AS tk, CAST(sum(CAST(CASE WHEN l_returnflag = 'N' THEN 0.5 ELSE 1 END * l_quantity AS DECIMAL(18, 4))) AS DOUBLE) / count(*) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
        b AS (SELECT c.*, d.n AS n0, d.k / d.n AS p0, c.k / c.n AS p, CASE WHEN c.tn > 0 THEN c.tk / c.tn END AS t, CASE WHEN d.tn > 0 THEN d.tk / d.tn ELSE 0 END AS t0, d.tn AS tn0, c.cost / d.cost AS ratio FROM g c JOIN g d ON c.segment = d.segment AND d.model = 'RF' WHERE c.model <> 'RF'),
        v AS (SELECT segment, model, CAST(n AS BIGINT) AS n, round(ratio, 6) AS cost_ratio, n >= 30 AND n0 >= 30 AS enough, CASE WHEN p * (1 - p) + p0 * (1 - p0) > 0 THEN (p - p0 + 0.05e0) / sqrt(p * (1 - p) / n + p0 * (1 - p0) / n0) >= 1.6448536269514722e0 ELSE p - p0 + 0.05e0 > 0 END AS accepted_gate,
          CASE WHEN tn = 0 THEN tn0 = 0 WHEN t * (1 - t) + t0 * (1 - t0) > 0 THEN (t - t0 + 0.03e0) / sqrt(t * (1 - t) / tn + t0 * (1 - t0) / greatest(tn0, 1)) >= 1.6448536269514722e0 ELSE t - t0 + 0.03e0 > 0 END AS tested_gate, coalesce(ratio <= 0.7e0, false) AS cost_gate FROM b) SELECT *, enough AND accepted_gate AND tested_gate AND cost_gate AS recommended FROM v""",
    "t25_breaker": """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS miss, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), m AS (SELECT a.event_id, a.user_id, a.ts, a.i, a.miss, sum(b.miss) AS misses, count(*) AS seen FROM e a JOIN e b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 99 AND a.i GROUP BY ALL)
        SELECT event_id, CAST(misses AS BIGINT) AS misses, seen, EXISTS (SELECT 1 FROM m b WHERE b.user_id = a.user_id AND b.i <= a.i AND b.miss = 1 AND b.seen >= 10 AND b.misses > 0.02e0 * b.seen AND b.ts + INTERVAL 24 HOURS > a.ts) AS disabled FROM m a""",
    "t4_relevance": r"""WITH p AS (SELECT b.conv_id, b.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.text IS NOT NULL), w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(x), '[a-z0-9_]+'), lambda t: length(t) > 1) AS x, list_filter(regexp_extract_all(lower(coalesce(y, '')), '[a-z0-9_]+'), lambda t: length(t) > 1) AS y FROM p),
        u AS (SELECT conv_id, turn, x, y, unnest(list_distinct(list_concat(x, y))) AS t FROM w), c AS (SELECT conv_id, turn, len(list_filter(x, lambda z: z = t)) AS a, len(list_filter(y, lambda z: z = t)) AS b FROM u), i AS (SELECT *, CASE WHEN a * b > 0 THEN 1e0 ELSE ln(1.5e0) + 1 END AS f FROM c),
        g AS (SELECT conv_id, turn, sum(a * b * f * f) / (sqrt(sum(a * a * f * f)) * sqrt(sum(b * b * f * f))) AS cos, count(*) FILTER (a * b > 0) AS matched FROM i GROUP BY conv_id, turn), s AS (SELECT w.conv_id, w.turn, len(x) * len(y) = 0 AS bare, coalesce(matched, 0) AS matched, round(CASE WHEN len(x) * len(y) = 0 THEN 0.5e0 ELSE least(1e0, cos + least(0.3e0, matched * 0.05e0)) END, 6) AS score FROM w LEFT JOIN g ON g.conv_id = w.conv_id AND g.turn = w.turn)
        SELECT conv_id, turn, score, matched, CASE WHEN bare THEN 'peripheral' WHEN score >= 0.7e0 THEN 'relevant' WHEN score >= 0.4e0 THEN 'peripheral' ELSE 'noise' END AS category FROM s""",
}
