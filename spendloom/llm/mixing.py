"""Mixing sources to target weights: hash-random order, bucketed prefix sums, an exact cut for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Tables, attach, table

#: Documents of one hash bucket, on average: a window never sorts many more.
BUCKET_ROWS = 5_000
#: Most repeats of a document.
EPOCHS = 3
_KEYS = 1 << 60
#: Sources whose sums are broadcast (some 10 MB); the sums of more are joined.
SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the sum of
    all sizes. A source stops at epochs times its size. In ascending order of
    cap / weight the stopped sources come first: the share of the others after
    the first k is rest / their weights, and the first k whose next cap reaches
    that share is right. Only the table of sources is sorted here, one row each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * epochs)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped, lighter = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("cap", "weight"))
    w = w.withColumn("level", (F.sum("source_size").over(every) - capped) / (F.sum("weight").over(every) - lighter))
    fits = F.col("cap") / F.col("weight") >= F.col("level")
    level = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(every)
    share = F.when(F.coalesce(F.max(F.when(fits, F.lit(1))).over(by_cap.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 1, F.col("weight") * level)
    return w.select("source", "source_size", F.coalesce(share, F.col("cap").cast("double")).alias("target"))


def random_key() -> Column:
    """60 bits of the md5 of doc_id and the text's md5."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest).cast("binary"))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, epochs: int = EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes), with source and key.

    Each document gets a hash-random key; keys are cut in ranges of equal width,
    so every range of a source holds about bucket_rows rows however large the
    source is. Sums of the ranges give each its base; within a range documents
    are summed in key order. A source gives whole epochs, then the documents
    before the cut, and of the document at the cut as many words as are left.

    Nulls: a null text has size 0; a null source is a source of its own, the
    last; a null doc_id counts as ''. Rows that repeat are further documents;
    equal keys keep together and are cut in order of size. A source whose size
    is 0 has target 0. Empty table: no rows. Other columns are ignored.
    """
    d = Tables(docs.sparkSession).keep(docs.select("doc_id", "source", word_count().alias("size"), random_key().alias("key")), "sizes")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket_rows)).cast("long")
    plan = targets(sizes.select("source", "source_size"), epochs).join(sizes.select(F.col("source").alias("s"), ranges.alias("ranges")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    d = _of_source(d, plan, ["key"])
    d = d.withColumn("range", F.least(F.floor(F.col("key") / (F.lit(float(_KEYS)) / F.col("ranges"))), F.col("ranges") - 1).cast("long"))
    bases = d.groupBy("source", "range").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select(F.col("source").alias("of"), F.col("range").alias("in"), F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("base"))
    d = d.join(bases, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in"))).drop("of", "in")
    within = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.floor(F.col("target")) - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - first))
    return d.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "key")


def _of_source(rows: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of their source in values, which is broadcast if it has at most SOURCES rows; more sources are joined, each dealt over parts."""
    values = Tables(rows.sparkSession).keep(values, "by-source")
    if values.count() <= SOURCES:
        return rows.join(F.broadcast(values.withColumnRenamed("source", "_of")), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    pair = lambda df: df.withColumns({"_of": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull()})
    return attach(pair(rows), ["_of", "_none"], pair(values).drop("source"), by).drop("_of", "_none")


def mixture(docs: DataFrame, epochs: int = EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of docs, as often as the mix takes them whole: the document at the cut goes if half of its words are within.

    The mix takes the first documents of a source in key order once more than
    the rest, so the last such key of each source decides for every row, and the
    texts aren't moved. Nulls, ties, repeated rows and empty tables: as in mix.
    Other columns stay as they are, whatever their names.
    """
    m = mix(docs, epochs, bucket_rows)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    more = (F.col("size") > 0) & (2 * (F.col("taken") - whole * F.col("size")) >= F.col("size"))
    cuts = m.groupBy("source").agg(F.first(whole).alias("whole"), F.coalesce(F.max(F.when(more, F.col("key"))), F.lit(-1)).alias("cut"))
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held")
    rows = _of_source(docs.select(held, "source", random_key().alias("key")), cuts, ["key"])
    copies = (F.col("whole") + (F.col("key") <= F.col("cut")).cast("long")).cast("int")
    return rows.select("held", F.explode(F.array_repeat(F.lit(1), copies))).select("held.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The cut by one running sum for each source; the same keys.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents
), k AS (
  SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 15) AS BIGINT) AS key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s
), c AS (
  SELECT *, source_size * 3 AS cap, row_number() OVER (ORDER BY source_size * 3.0 / weight, source NULLS LAST) AS r FROM w
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM c) - coalesce((SELECT sum(cap) FROM c b WHERE b.r < c.r), 0)) / CAST((SELECT sum(weight) FROM c) - coalesce((SELECT sum(weight) FROM c b WHERE b.r < c.r), 0) AS DOUBLE) AS level FROM c
), f AS (
  SELECT min(r) AS r FROM l WHERE CAST(cap AS DOUBLE) / weight >= level
), t AS (
  SELECT source, source_size, CASE WHEN l.r >= f.r THEN weight * (SELECT level FROM l b WHERE b.r = f.r) ELSE CAST(cap AS DOUBLE) END AS target FROM l, f
), p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, floor(target) - whole * source_size - first)) AS BIGINT) AS taken
FROM p
"""
