"""Declarative queries: one text, bound to Spark tables or rendered for DuckDB.

Tables are written {name}. Shared relations (VIEWS) are written {name} too and
are put in as WITH parts. Where the dialects differ a query says @name(a; b).
Spark's planner sees one statement over Parquet relations, so filters and
columns reach the scans and joins are chosen from their sizes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .spread import dealt_joins, dealt_texts, spread

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FORMS = {
    "us": ("timestampdiff(MICROSECOND, {0}, {1})", "date_diff('microsecond', {0}, {1})"),
    "props": ("CAST(get_json_object({0}, '$.k') AS BIGINT)", "CAST({0}::JSON->>'k' AS BIGINT)"),
    "wordset": ("explode(array_distinct(filter(split(lower({0}), '[^a-z0-9]+'), x -> x <> '')))", "unnest(list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')))"),
    "matches": ("regexp_count({0}, {1})", "len(regexp_extract_all({0}, {1}))"),
    "rx": ("({0} RLIKE {1})", "regexp_matches({0}, {1})"),
    "sha": ("sha2({0}, 256)", "sha256({0})"),
    "days": ("date_add({0}, {1})", "CAST({0} + CAST({1} AS INTEGER) AS DATE)"),
    "dow": ("weekday({0})", "(isodow({0}) - 1)"),
    "minus_days": ("({0} - make_dt_interval({1}))", "({0} - to_days({1}))"),
    "pair": ("struct({0}, {1})", "{{'a': {0}, 'b': {1}}}"),
    "lev": ("levenshtein({0}, {1})", "levenshtein({0}, {1})"),
}

#: Shared relations over the tables.
VIEWS = {
    "charges": """SELECT l_orderkey * 10 + l_linenumber AS charge_id, l_shipdate AS ts, o_custkey AS agent_id, l_orderkey AS task_id, concat(l_returnflag, l_linestatus) AS model,
        c_mktsegment AS provider, n_name AS nation, r_name AS region, CAST(l_quantity AS BIGINT) * 100 AS tokens_in, CAST(floor(l_tax * 1000) AS BIGINT) * 10 AS tokens_out,
        CAST(floor(l_discount * 1000) AS BIGINT) * 10 AS tokens_cached, l_extendedprice * (1 - l_discount) AS cost_usd, o_orderstatus AS status
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "prices": "SELECT * FROM (VALUES ('AF', 3e0, 15e0, 0.3e0, 200000), ('NF', 0.8e0, 4e0, 0.08e0, 200000), ('NO', 2.5e0, 10e0, CAST(NULL AS DOUBLE), 128000)) AS p(model, in_usd, out_usd, cached_usd, context)",
    "spend": """SELECT o_custkey AS task_id, concat(l_returnflag, l_linestatus) AS model, CAST(l_quantity AS BIGINT) * 100 AS tokens_in, CAST(floor(l_tax * 1000) AS BIGINT) * 10 AS tokens_out,
        CAST(floor(l_discount * 1000) AS BIGINT) * 10 AS tokens_read, CASE WHEN l_returnflag = 'R' THEN 'rejected' WHEN o_orderstatus = 'F' THEN 'accepted' WHEN o_orderstatus = 'P' THEN 'retry' ELSE 'pending' END AS outcome
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "turns": """SELECT conv_id, turn, role, text, CAST(ceil(length(coalesce(text, '')) / 4e0) AS BIGINT) AS tokens FROM {conversations}""",
    "edges": """SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000000000 AS dst FROM {lineitem}""",
}


def _forms(text: str, spark: bool) -> str:
    while m := re.search(r"@(\w+)\(([^()@]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()@]*)*)\)", text):
        args = [a.strip() for a in m[2].split(";")]
        text = text[: m.start()] + FORMS[m[1]][0 if spark else 1].format(*args) + text[m.end() :]
    return text


def _render(sql: str, spark: bool) -> str:
    used, todo = [], [sql]
    while todo:
        for name in re.findall(r"\{(\w+)\}", todo.pop()):
            if name in VIEWS and name not in used:
                used.append(name)
                todo.append(VIEWS[name])
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    sql = re.sub(r"\{(" + "|".join(VIEWS) + r")\}", r"\1", sql)
    if parts:
        m = re.match(r"\s*WITH (RECURSIVE )?", sql)
        sql = f"WITH {m[1] or ''}{parts}, {sql[m.end():]}" if m else f"WITH {parts} {sql}"
        sql = re.sub(r"\{(" + "|".join(VIEWS) + r")\}", r"\1", sql)
    return _forms(sql, spark)


@dataclass(frozen=True)
class Query:
    """A declared query. sql runs in both dialects, or own holds DuckDB's text. dear: tables whose rows take long, which are spread by their first column. texts: tables whose texts are dealt by their first column into parts that don't grow."""

    sql: str
    own: str | None = None
    dear: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        text = _render(self.sql, True)
        names = [t for t in TABLES if f"{{{t}}}" in text]
        tables = dealt_joins({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})
        return spark.sql(text, **{t: spread(df, df.columns[0]) if t in self.dear else dealt_texts(df, df.columns[0]) if t in self.texts else df for t, df in tables.items()})

    def duckdb(self) -> str:
        text = _render(self.own or self.sql, False)
        return re.sub(r"\{(\w+)\}", r"\1", text)


def bind(queries: dict[str, Query]) -> tuple[dict[str, Callable], dict[str, str]]:
    return dict(queries), {k: q.duckdb() for k, q in queries.items()}
