"""What texts hold: canonical values and their repeats, vectors and their nearest, findings as a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import LongType, StringType, StructType

from ..functions.texts import canonical_json, embedded, json_digest
from ..plans.spread import spread
from .scanners import INJECTIONS, SECRETS


def repeated_values(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """keys, digest, n, first (order columns of the first) of JSON values that come more than once for a key, whatever the order of their own keys. What has no canonical form isn't counted."""
    d = df.select(*keys, *order, json_digest(F.col(text)).alias("digest")).where(F.col("digest").isNotNull())
    return d.groupBy(*keys, "digest").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first")).where("n > 1")


def t17_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items written as JSON with their keys in an order of their own each second row: repeats of one value."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("double").alias("q"))
    one, other = F.to_json(F.struct("l_returnflag", F.struct(F.col("l_linestatus").alias("z"), F.col("q").alias("a")).alias("in"))), F.to_json(F.struct(F.struct(F.col("q").alias("a"), F.col("l_linestatus").alias("z")).alias("in"), "l_returnflag"))
    d = lines.select((F.col("l_orderkey") % 100).alias("part"), "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, one).otherwise(other).alias("value"))
    return repeated_values(d, ["part"], ["l_orderkey", "l_linenumber"], "value").select("part", "digest", "n", F.col("first.l_orderkey").alias("first_order"))


def t6_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    e = embedded(spread(turns, "conv_id", "turn"), "text")
    return e.select("conv_id", "turn", F.posexplode("embedding").alias("component", "value")).where("value <> 0").select("conv_id", "turn", "component", F.round(F.col("value").cast("double"), 5).alias("value"))


class Findings:
    """findings(TABLE(...), 'id', 'text'): id, family, kind, started, ended of each match of the scanners' patterns, in characters, the end exclusive.

    The table may be partitioned by any columns; rows are searched one by one.
    Null texts have none.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, id_: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        for x in (id_, text):
            if x.value not in rows.dataType.names:
                raise ValueError(f"no column {x.value}")
        kind = rows.dataType[id_.value].dataType
        return AnalyzeResult(StructType().add("id", kind).add("family", StringType()).add("kind", StringType()).add("started", LongType()).add("ended", LongType()))

    def __init__(self) -> None:
        self.patterns = [("injection", k, re.compile(p, re.ASCII)) for k, ps in INJECTIONS.items() for p in ps] + [("secret", k, re.compile(p, re.ASCII)) for k, p in SECRETS.items()]

    def eval(self, row, id_: str, text: str) -> Iterator[tuple]:
        value = row[text]
        if value:
            for family, kind, p in self.patterns:
                for m in p.finditer(value):
                    yield row[id_], family, kind, m.start(), m.end()


def register(spark: SparkSession) -> None:
    """Makes findings() and canonical_json() known to SQL."""
    spark.udtf.register("findings", F.udtf(Findings))
    spark.udf.register("canonical_json", canonical_json)


def u7_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id")
    return spark.sql("SELECT id AS page_id, kind, started, ended FROM findings(TABLE(SELECT page_id, html FROM {pages}) PARTITION BY (page_id), 'page_id', 'html') WHERE family = 'injection'", pages=pages)


QUERIES = {f.__name__: f for f in (t17_canonical_json, t6_embedding, u7_findings)}


def _spots(kind: str, pattern: str) -> str:
    """Places of matches in DuckDB: the texts between them, one after another."""
    q = "'" + pattern.replace("'", "''") + "'"
    return f"SELECT page_id, '{kind}' AS kind, regexp_extract_all(html, {q}) AS found, html FROM pages WHERE html IS NOT NULL"


#: Values are compared as text put together in order of keys; grams are hashed one by one; matches are found again by looking for each after the one before.
ORACLE_SQL = {
    "t17_canonical_json": """WITH v AS (SELECT l_orderkey % 100 AS part, l_orderkey, l_linenumber, sha256('{"in":{"a":' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',"z":"' || l_linestatus || '"},"l_returnflag":"' || l_returnflag || '"}') AS digest FROM lineitem)
        SELECT part, digest, count(*) AS n, min(l_orderkey) AS first_order FROM v GROUP BY part, digest HAVING count(*) > 1""",
    "t6_embedding": """WITH t AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS s FROM conversations WHERE text IS NOT NULL), u AS (SELECT conv_id, turn, CASE WHEN length(s) < 3 THEN [s] ELSE list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3)) END AS grams FROM t WHERE s <> ''),
        g AS (SELECT conv_id, turn, unnest(grams) AS gram FROM u), n AS (SELECT conv_id, turn, gram, 1 + ln(count(*)) AS w FROM g GROUP BY conv_id, turn, gram),
        h AS (SELECT *, list_reduce(list_transform(string_split(gram, ''), lambda c: CAST(unicode(c) & 255 AS BIGINT)), lambda acc, x: (xor(acc, x) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS h FROM n),
        b AS (SELECT conv_id, turn, h % 256 AS component, sum(CASE WHEN (h >> 16) & 1 = 0 THEN w ELSE -w END) AS x FROM h GROUP BY conv_id, turn, h % 256), l AS (SELECT conv_id, turn, sqrt(sum(x * x)) AS length FROM b GROUP BY conv_id, turn)
        SELECT conv_id, turn, CAST(component AS INTEGER) AS component, round(CAST(CAST(x / length AS FLOAT) AS DOUBLE), 5) AS value FROM b JOIN l USING (conv_id, turn) WHERE length > 0 AND CAST(x / length AS FLOAT) <> 0""",
    "u7_findings": "WITH RECURSIVE f AS (" + " UNION ALL ".join(_spots(k, p) for k, ps in INJECTIONS.items() for p in ps) + """),
        r AS (SELECT page_id, kind, found, html, 1 AS i, 0 AS started, 0 AS ended FROM f WHERE len(found) > 0
          UNION ALL SELECT page_id, kind, found, html, i + 1, ended + instr(substring(html, ended + 1), found[i]) - 1, ended + instr(substring(html, ended + 1), found[i]) - 1 + length(found[i]) FROM r WHERE i <= len(found))
        SELECT page_id, kind, CAST(started AS BIGINT) AS started, CAST(ended AS BIGINT) AS ended FROM r WHERE i > 1""",
}
