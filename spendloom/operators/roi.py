"""Return on a turn: what it wrote, tested and resolved against what it repeats; the session's running totals and the loop block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Weights of a written file, passed tests, a resolved error; of a near repeat, the same files, the same errors.
WRITTEN, TESTED, RESOLVED, REPEAT, SAME_FILES, SAME_ERRORS = 0.4, 0.3, 0.3, 0.5, 0.3, 0.2
LOW, STREAK = 0.3, 3
# What reports an error, and what a failure.
ERRORS = [r"(?i)error:\s*(.+?)(?:\n|\z)", r"(?i)failed:\s*(.+?)(?:\n|\z)", r"(?i)exception:\s*(.+?)(?:\n|\z)"]
FAILURES = [r"(?i)assertion\s+failed", r"(?i)test\s+failed"]


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda x: F.length(x) > 2))


def lines(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), _trim), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def errors(text: Column) -> Column:
    """The distinct errors that a text reports. Two are the same if equal and one of their words has three letters or more."""
    named = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), _trim) for p in ERRORS]
    bare = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in FAILURES]
    return F.array_distinct(F.filter(F.concat(*named, *bare), lambda x: (x != "") & x.rlike(r"\w{3}")))


def turn_roi(turns: DataFrame) -> DataFrame:
    """session, turn, tokens, similarity, roi, productive, recursive, class of turns (session, turn, tokens, content, written, read, passed).

    A turn is judged against the one before it, and its reads against all before
    (a file read in two turns or more before is read again in vain). Null
    contents are empty, null lists hold nothing. One sort by (session, turn) and
    one by (session, file) serve all. Empty table: no rows.
    """
    by = Window.partitionBy("session").orderBy("turn")
    t = turns.select("session", "turn", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("written", F.array().cast("array<string>")).alias("written"), "read", F.coalesce("passed", F.lit(False)).alias("passed"))
    t = t.withColumns({"w": words(F.col("content")), "l": lines(F.col("content")), "e": errors(F.col("content"))})
    t = t.withColumns({f"{c}0": F.lag(c).over(by) for c in ("w", "l", "e", "written")})
    similarity = F.when(F.col("w0").isNotNull(), 0.3 * jaccard(F.col("w"), F.col("w0")) + 0.7 * jaccard(F.col("l"), F.col("l0"))).otherwise(0.0)
    reads = turns.select("session", "turn", F.explode(F.array_distinct("read")).alias("file"))
    before = F.count("*").over(Window.partitionBy("session", "file").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    vain = reads.withColumn("before", before).where("before >= 2").groupBy("session", "turn").agg(F.ceil((F.sum(F.length("file")) + F.count("*") - 1) / 3).alias("vain"))
    t = t.withColumn("similarity", similarity).join(vain, ["session", "turn"], "left")
    total = F.col("tokens").cast("double")
    some = lambda a, b: F.coalesce(F.size(F.array_intersect(a, b)) > 0, F.lit(False)).cast("int")
    gone = F.coalesce(F.size(F.array_except("e0", "e")) > 0, F.lit(False)).cast("int")
    good = total * WRITTEN * (F.size("written") > 0).cast("int") + total * TESTED * F.col("passed").cast("int") + total * RESOLVED * gone
    again = total * REPEAT * (F.col("similarity") > 0.8).cast("int") + total * SAME_FILES * some("written", "written0") * (F.col("similarity") > 0.5).cast("int") + total * SAME_ERRORS * some("e", "e0") + F.coalesce("vain", F.lit(0))
    t = t.withColumns({"p": F.least(good, total), "r": F.least(again, total)})
    over = F.col("p") + F.col("r") > total
    t = t.withColumns({"productive": F.when(over, F.floor(F.col("p") * (total / (F.col("p") + F.col("r"))))).otherwise(F.col("p")).cast("double"), "recursive": F.when(over, F.floor(F.col("r") * (total / (F.col("p") + F.col("r"))))).otherwise(F.col("r")).cast("double")})
    roi = F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("productive") / total))).otherwise(0.0)
    kind = F.when(F.col("roi") >= 0.5, "productive").when(F.col("recursive") > F.col("productive"), "recursive").otherwise("unknown")
    return t.withColumn("roi", roi).select("session", "turn", "tokens", "similarity", "roi", "productive", "recursive", kind.alias("class"))


def session_roi(judged: DataFrame) -> DataFrame:
    """judged turns with cumulative_roi and streak: turns in a row, to this one, with a roi under LOW."""
    by = Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum("tokens").over(by)
    low = (F.col("roi") < LOW).cast("int")
    d = judged.withColumn("cumulative_roi", F.when(spent > 0, F.sum("productive").over(by) / spent).otherwise(0.0)).withColumn("low", low).withColumn("island", F.sum(1 - F.col("low")).over(by))
    return d.withColumn("streak", F.sum("low").over(Window.partitionBy("session", "island").orderBy("turn"))).drop("low", "island")


def loop_blocks(folded: DataFrame, streak: int = STREAK) -> DataFrame:
    """session, blocked_at, cumulative_roi: the first turn at which a session has so many turns of low return in a row."""
    return folded.where(F.col("streak") >= streak).groupBy("session").agg(F.min("turn").alias("blocked_at"), F.min_by("cumulative_roi", "turn").alias("cumulative_roi"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns: words in -tion stand for files written, words in -ing for files read, an "est" for passed tests."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = lambda p: F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(p), F.lit(0)))
    return c.select(F.col("conv_id").alias("session"), "turn", F.ceil(F.length("text") / 4).alias("tokens"), F.col("text").alias("content"), found("[a-z]+tion").alias("written"), found("[a-z]*ing").alias("read"), F.col("text").contains("est").alias("passed"))


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def w4_turn_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(turn_roi(_turns(spark, sf_dir)), ["similarity", "roi", "productive", "recursive"])


def w5_session_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(session_roi(turn_roi(_turns(spark, sf_dir))), ["cumulative_roi"]).select("session", "turn", "cumulative_roi", "streak")


def w6_loop_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(loop_blocks(session_roi(turn_roi(_turns(spark, sf_dir))), 2), ["cumulative_roi"])


QUERIES = {f.__name__: f for f in (w4_turn_roi, w5_session_roi, w6_loop_blocks)}
_ROI = r"""WITH c AS (SELECT conv_id AS session, turn, text, CAST(ceil(length(text) / 4e0) AS DOUBLE) AS tokens, list_distinct(regexp_extract_all(text, '[a-z]+tion')) AS written, contains(text, 'est') AS passed,
    list_distinct(list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: length(x) > 2)) AS w, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS l,
    list_distinct(list_filter(list_transform(regexp_extract_all(text, '(?i)error:\s*(.+?)(?:\n|\z)', 1) || regexp_extract_all(text, '(?i)failed:\s*(.+?)(?:\n|\z)', 1) || regexp_extract_all(text, '(?i)exception:\s*(.+?)(?:\n|\z)', 1) || regexp_extract_all(text, '(?i)assertion\s+failed') || regexp_extract_all(text, '(?i)test\s+failed'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: regexp_matches(x, '\w{3}'))) AS e
  FROM conversations WHERE text IS NOT NULL),
  p AS (SELECT a.*, b.session IS NOT NULL AS follows, b.w AS w0, b.l AS l0, b.e AS e0, b.written AS written0 FROM (SELECT *, lag(turn) OVER (PARTITION BY session ORDER BY turn) AS before FROM c) a LEFT JOIN c b ON a.session = b.session AND a.before = b.turn),
  f AS (SELECT DISTINCT session, turn, unnest(regexp_extract_all(text, '[a-z]*ing')) AS file FROM c), g AS (SELECT f.session, f.turn, f.file FROM f JOIN f b ON f.session = b.session AND f.file = b.file AND b.turn < f.turn GROUP BY f.session, f.turn, f.file HAVING count(*) >= 2),
  v AS (SELECT session, turn, ceil((sum(length(file)) + count(*) - 1) / 3e0) AS vain FROM g GROUP BY session, turn),
  s AS (SELECT p.*, coalesce(vain, 0) AS vain, CASE WHEN follows THEN 0.3e0 * CASE WHEN len(w) > 0 AND len(w0) > 0 THEN CAST(len(list_intersect(w, w0)) AS DOUBLE) / len(list_distinct(w || w0)) ELSE 0e0 END + 0.7e0 * CASE WHEN len(l) > 0 AND len(l0) > 0 THEN CAST(len(list_intersect(l, l0)) AS DOUBLE) / len(list_distinct(l || l0)) ELSE 0e0 END ELSE 0e0 END AS similarity FROM p LEFT JOIN v ON p.session = v.session AND p.turn = v.turn),
  q AS (SELECT session, turn, tokens, similarity, least(tokens, tokens * 0.4e0 * CAST(len(written) > 0 AS INT) + tokens * 0.3e0 * CAST(passed AS INT) + tokens * 0.3e0 * CAST(coalesce(len(list_filter(e0, lambda x: NOT list_contains(e, x))) > 0, false) AS INT)) AS good,
    least(tokens, tokens * 0.5e0 * CAST(similarity > 0.8e0 AS INT) + tokens * 0.3e0 * CAST(coalesce(len(list_intersect(written, written0)) > 0, false) AS INT) * CAST(similarity > 0.5e0 AS INT) + tokens * 0.2e0 * CAST(coalesce(len(list_intersect(e, e0)) > 0, false) AS INT) + vain) AS again FROM s),
  j AS (SELECT session, turn, tokens, similarity, CASE WHEN good + again > tokens THEN floor(good * (tokens / (good + again))) ELSE good END AS productive, CASE WHEN good + again > tokens THEN floor(again * (tokens / (good + again))) ELSE again END AS recursive FROM q),
  roi AS (SELECT *, CASE WHEN tokens > 0 THEN greatest(0e0, least(1e0, productive / tokens)) ELSE 0e0 END AS roi FROM j),
  folded AS (SELECT session, turn, CASE WHEN sum(tokens) OVER u > 0 THEN sum(productive) OVER u / sum(tokens) OVER u ELSE 0e0 END AS cumulative_roi, turn - coalesce(max(CASE WHEN roi >= 0.3e0 THEN turn END) OVER u, (min(turn) OVER (PARTITION BY session)) - 1) AS streak FROM roi WINDOW u AS (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  """
#: The streak counts turns since the last good one: turns are numbered without gaps in the tables.
ORACLE_SQL = {
    "w4_turn_roi": _ROI + "SELECT session, turn, CAST(tokens AS BIGINT) AS tokens, round(similarity, 6) AS similarity, round(roi, 6) AS roi, round(productive, 6) AS productive, round(recursive, 6) AS recursive, CASE WHEN roi >= 0.5e0 THEN 'productive' WHEN recursive > productive THEN 'recursive' ELSE 'unknown' END AS class FROM roi",
    "w5_session_roi": _ROI + "SELECT session, turn, round(cumulative_roi, 6) AS cumulative_roi, CAST(streak AS BIGINT) AS streak FROM folded",
    "w6_loop_blocks": _ROI + "SELECT session, min(turn) AS blocked_at, round(min_by(cumulative_roi, turn), 6) AS cumulative_roi FROM folded WHERE streak >= 2 GROUP BY session",
}
