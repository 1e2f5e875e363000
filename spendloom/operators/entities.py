"""Entities that a conversation mentions, and those that a compaction loses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.spread import spread

# Categories, in order, with their patterns; what the first group holds counts, or the whole match where there is none.
PATTERNS = {
    "file_name": [
        r"""(?i)(?:file|path|in|from|to)\s+[`"]?([a-zA-Z0-9_\-./]+\.[a-zA-Z]{1,6})[`"]?""",
        r"([a-zA-Z0-9_\-]+\.(?:ts|tsx|js|jsx|py|go|rs|java|rb|css|scss|html|json|yaml|yml|toml|md))",
        r"(src\/[a-zA-Z0-9_\-./]+)",
        r"(packages\/[a-zA-Z0-9_\-./]+)",
    ],
    "function_name": [
        r"function\s+([a-zA-Z_][a-zA-Z0-9_]*)",
        r"(?:const|let|var)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*(?:async\s*)?\(",
        r"(?:async\s+)?([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*(?:=>|\{)",
        r"def\s+([a-zA-Z_][a-zA-Z0-9_]*)",
        r"fn\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    ],
    "api_endpoint": [
        r"(?i)(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+([/a-zA-Z0-9_\-:{}]+)",
        r"""["'`](\/api\/[a-zA-Z0-9_\-/{}:]+)["'`]""",
        r"""["'`](\/v[0-9]+\/[a-zA-Z0-9_\-/{}:]+)["'`]""",
        r"""(?i)endpoint[:\s]+["'`]?([/a-zA-Z0-9_\-:{}]+)["'`]?""",
    ],
    "configuration": [
        r"""(?i)(?:set|config|setting|option|parameter|value)[:\s]+["'`]?([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:=|:)\s*["'`]?(?:[^"'`\n]+)["'`]?""",
        r"(?i)timeout[:\s]*([0-9]+\s*(?:ms|s|min|minute|hour)?)",
        r"(?i)expir(?:y|es?|ation)[:\s]*([0-9]+\s*(?:ms|s|min|minute|hour)?)",
        r"(?i)port[:\s]*([0-9]+)",
        r"(?i)limit[:\s]*([0-9]+)",
    ],
    "architectural_decision": [
        r"(?i)(?:must|should|need to|have to|required to)\s+([^.!?\n]{10,100})",
        r"(?i)(?:pattern|approach|strategy|architecture)[:\s]+([^.!?\n]{10,100})",
        r"(?i)(?:before|after|chain|order)[:\s]+([^.!?\n]{10,100})",
        r"(?i)implement(?:s|ed|ation)?[:\s]+([^.!?\n]{10,100})",
    ],
    "variable_name": [r"(?:const|let|var|val)\s+([a-zA-Z_][a-zA-Z0-9_]*)", r"(?:type|interface|class|struct|enum)\s+([A-Z][a-zA-Z0-9_]*)"],
    "type_definition": [r"(?:type|interface)\s+([A-Z][a-zA-Z0-9_]*)", r"class\s+([A-Z][a-zA-Z0-9_]*)", r"struct\s+([A-Z][a-zA-Z0-9_]*)"],
    "test_requirement": [
        r"""(?i)test[:\s]+["'`]?([^"'`\n]{10,100})["'`]?""",
        r"(?i)(?:should|must)\s+(?:test|verify|check|ensure)\s+([^.!?\n]{10,100})",
        r"(?i)assertion[:\s]+([^.!?\n]{10,100})",
    ],
}
# Words that are no entity.
COMMON = ["function", "const", "let", "var", "return", "if", "else", "for", "while", "class", "interface", "type", "export", "import", "from", "async", "await", "true", "false", "null", "undefined", "this", "new", "try", "catch", "throw", "public", "private", "protected", "static", "readonly"]
LEAST, SHOWN = 3, 10


def entities(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, category, key (the value in lower case), value (as it comes first, by pattern, then by place) of each entity of a text. Null texts have none.

    All is regular expressions inside the plan; one shuffle brings the equal
    values of a text together.
    """
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    found = lambda ps: F.transform(F.concat(*[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)) for p in ps]), trim)
    each = F.array(*[F.struct(F.lit(c).alias("category"), found(ps).alias("values")) for c, ps in PATTERNS.items()])
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.explode(each).alias("e")).select(*keys, "e.category", F.posexplode("e.values").alias("at", "value"))
    fit = rows.withColumn("key", F.lower("value")).where((F.length("value") >= LEAST) & ~F.col("key").isin(*COMMON))
    return fit.groupBy(*keys, "category", "key").agg(F.min_by("value", "at").alias("value"))


def lost(before: DataFrame, after: DataFrame, session: str, turn: str, text: str, shown: int = SHOWN) -> DataFrame:
    """session, category, value, turn, nth: what the turns before a compaction mention and the text after it doesn't, the latest first mentions first, shown for each session.

    before: session, turn, text; after: session, text (none: all is lost). An
    entity counts with its first turn; ties go by category and value.
    """
    held = entities(before, [session, turn], text).groupBy(session, "category", "key").agg(F.min(turn).alias(turn), F.min_by("value", turn).alias("value"))
    kept = entities(after, [session], text).select(session, "category", "key")
    gone = held.join(kept, [session, "category", "key"], "left_anti")
    nth = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(turn), "category", "key"))
    return gone.withColumn("nth", nth).where(F.col("nth") <= shown).select(session, "category", "value", turn, "nth")


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as turns about code: a session is a brand, a turn a part; what a turn says follows from its columns."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.regexp_replace(F.col("p_brand"), "[^A-Za-z0-9]", "_")
    text = F.concat(
        F.lit("open file src/"), name, F.lit("/p"), F.col("p_partkey") % 50, F.lit(".ts and const item"), F.col("p_partkey") % 40, F.lit(" = (x) => call"), F.col("p_size"), F.lit("(x) {\nPOST /api/"), name, F.lit("/"), F.col("p_size"), F.lit("\ntimeout: "), F.col("p_size"), F.lit("s. class Part"), F.col("p_partkey") % 30,
        F.lit(" must keep every "), F.lower("p_brand"), F.lit(" in stock. test: count of "), F.lower("p_brand"), F.lit(" is right\n"),
    )
    return p.select(F.col("p_brand").alias("session"), F.col("p_partkey").alias("turn"), text.alias("text"))


def t14_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spread(_talk(spark, sf_dir), "turn"), ["session", "turn"], "text").select("session", "turn", "category", "value")


def j4_lost_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the turns of a session, those whose number divides by three come through the compaction."""
    talk = spread(_talk(spark, sf_dir), "turn")
    return lost(talk, talk.where("turn % 3 = 0").select("session", "text"), "session", "turn", "text")


QUERIES = {f.__name__: f for f in (t14_entities, j4_lost_references)}


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TALK = """WITH talk AS (SELECT p_brand AS session, p_partkey AS turn, 'open file src/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') || '/p' || (p_partkey % 50) || '.ts and const item' || (p_partkey % 40) || ' = (x) => call' || p_size || '(x) {' || chr(10) || 'POST /api/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') || '/' || p_size || chr(10) || 'timeout: ' || p_size || 's. class Part' || (p_partkey % 30)
      || ' must keep every ' || lower(p_brand) || ' in stock. test: count of ' || lower(p_brand) || ' is right' || chr(10) AS text FROM part), """
_FOUND = "found AS (" + " UNION ALL ".join(f"SELECT session, turn, '{c}' AS category, {100 * i} AS place, unnest(regexp_extract_all(text, {_sql(p)}, 1)) AS value FROM talk" for c, ps in PATTERNS.items() for i, p in enumerate(ps)) + "), "
_FIT = "fit AS (SELECT session, turn, category, place, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS value FROM found), ok AS (SELECT *, lower(value) AS key FROM fit WHERE length(value) >= 3 AND lower(value) NOT IN (" + ", ".join(f"'{w}'" for w in COMMON) + ")), "
ORACLE_SQL = {
    "t14_entities": _TALK + _FOUND + _FIT + "one AS (SELECT session, turn, category, key, min_by(value, place) AS value FROM ok GROUP BY session, turn, category, key) SELECT session, turn, category, value FROM one",
    "j4_lost_references": _TALK + _FOUND + _FIT + """first AS (SELECT session, category, key, min(turn) AS turn, min_by(value, turn * 1000 + place) AS value FROM ok GROUP BY session, category, key),
        gone AS (SELECT * FROM first f WHERE NOT EXISTS (SELECT 1 FROM ok o WHERE o.session = f.session AND o.category = f.category AND o.key = f.key AND o.turn % 3 = 0)),
        n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC, category, key) AS nth FROM gone) SELECT session, category, value, turn, CAST(nth AS INTEGER) AS nth FROM n WHERE nth <= 10""",
}
