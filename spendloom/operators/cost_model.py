"""Cost prediction in stages: two slopes, then the mean of what is left for each task, model, hour and repository; saved and loaded with checks."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import cut
from ..sources.keyed import Folder

#: The stages: a kind, its column, and how many rows a key needs.
STAGES = [("task", "task", 1), ("model", "model", 1), ("hour", "hour", 10), ("repo", "repo", 20)]
#: Rows that training needs, and rows from which predictions are taken.
LEAST_TRAINING, LEAST_PREDICTION = 100, 1000
# Coefficients that hold before there is enough to learn from, and factors of the plain estimate.
TASKS = {"refactor": 0.15, "debug": 0.10, "test": 0.08, "feature": 0.12, "unknown": 0.05}
FACTORS = {"refactor": 1.5, "debug": 1.3, "test": 1.2, "feature": 1.4, "unknown": 1.0}
START = {"intercept": 0.05, "context": 0.02, "depth": 0.01, "mae": 0.15, "r2": 0.0}
VERSION = 1
COEFS = "kind string, key string, value double"


@dataclass(frozen=True)
class Numbers:
    """context is for a thousand tokens, depth for a turn."""

    intercept: float
    context: float
    depth: float
    mae: float
    r2: float
    events: int


@dataclass(frozen=True)
class CostModel:
    """numbers, and a table of coefficients (COEFS), which may be as long as there are repositories."""

    numbers: Numbers
    coefs: DataFrame


def _with(rows: DataFrame, coefs: DataFrame, stages: list[tuple[str, str, int]]) -> tuple[DataFrame, Column]:
    """rows joined to their coefficients, and the sum of these (0 where there is none)."""
    total: Column = F.lit(0.0)
    for kind, column, _ in stages:
        own = coefs.where(F.col("kind") == kind).select(F.col("key").alias(f"_{kind}"), F.col("value").alias(f"_{kind}_value"))
        rows = rows.join(own, F.col(column).cast("string") == F.col(f"_{kind}"), "left").drop(f"_{kind}")
        total = total + F.coalesce(f"_{kind}_value", F.lit(0.0))
    return rows, total


def train(rows: DataFrame) -> CostModel:
    """rows: task, model, hour, repo, tokens_in, depth, cost. Rows with a null or non-finite number are left out; null keys have no coefficient.

    A pass for the slopes and one for each stage, each a sum by key before the
    shuffle. With fewer rows than LEAST_TRAINING the start's values hold.
    """
    spark = rows.sparkSession
    number = lambda c: F.col(c).cast("double").alias(c)
    d = rows.select("task", "model", "hour", "repo", number("tokens_in"), number("depth"), number("cost"))
    d = d.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in ("tokens_in", "depth", "cost")))
    s = d.agg(F.count("*").alias("n"), F.covar_pop("tokens_in", "cost").alias("xc"), F.var_pop("tokens_in").alias("xx"), F.covar_pop("depth", "cost").alias("dc"), F.var_pop("depth").alias("dd"), F.var_pop("cost").alias("cc")).first()
    if s.n < LEAST_TRAINING:
        return CostModel(Numbers(**START, events=s.n), spark.createDataFrame([("task", k, v) for k, v in TASKS.items()], COEFS))
    context, depth = s.xc / s.xx if s.xx > 0 else START["context"] / 1000, s.dc / s.dd if s.dd > 0 else START["depth"]
    left = F.col("cost") - context * F.col("tokens_in") - depth * F.col("depth")
    coefs = None
    for i, (kind, column, least) in enumerate(STAGES):
        known, total = (d, F.lit(0.0)) if coefs is None else _with(d, coefs, STAGES[:i])
        means = known.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("key")).agg(F.avg(left - total).alias("value"), F.count("*").alias("n")).where(F.col("n") >= least)
        new = means.select(F.lit(kind).alias("kind"), "key", "value")
        if kind == "task":
            rest = spark.createDataFrame([("task", k, v) for k, v in TASKS.items()], COEFS)
            new = new.unionByName(rest.join(new.select("key"), "key", "left_anti").select("kind", "key", "value"))
        new = cut(new, f"cost-{kind}")
        coefs = new if coefs is None else coefs.unionByName(new)
    known, total = _with(d, coefs, STAGES)
    residual = left - total
    intercept = known.agg(F.avg(residual)).first()[0]
    q = known.agg(F.avg(F.abs(residual - intercept)).alias("mae"), F.avg(F.pow(residual - intercept, F.lit(2))).alias("rest")).first()
    return CostModel(Numbers(intercept, context * 1000, depth, q.mae, 1 - q.rest / s.cc if s.cc > 0 else 0.0, s.n), coefs)


def predict(rows: DataFrame, model: CostModel, prices: DataFrame | None = None, fallback: tuple[float, float] = (2.5, 10.0)) -> DataFrame:
    """rows with predicted, low, high, confidence. An unknown task counts as the task unknown, other unknown keys as 0; all amounts are whole cents, one at least.

    Below LEAST_PREDICTION events: the price of the tokens and a fifth as many
    out, times the task's factor, unrounded, between 0.3 and 3 of it.
    """
    n = model.numbers
    base = rows.columns
    if n.events < LEAST_PREDICTION:
        cost = lambda side, i: F.coalesce(side, F.lit(fallback[i])) if prices is not None else F.lit(fallback[i])
        d = rows.join(F.broadcast(prices.select("model", "in_usd", "out_usd")), "model", "left") if prices is not None else rows  # a price list
        factor = F.coalesce(F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv])[F.coalesce("task", F.lit("unknown"))], F.lit(1.0))
        plain = (F.col("tokens_in") * cost("in_usd", 0) + F.ceil(F.col("tokens_in") * 0.2) * cost("out_usd", 1)) / 1e6 * factor
        return d.withColumn("predicted", plain).select(*base, "predicted", (F.col("predicted") * 0.3).alias("low"), (F.col("predicted") * 3.0).alias("high"), F.lit(0.1).alias("confidence"))
    tasks = model.coefs.where("kind = 'task'").select(F.col("key").alias("_known"))
    own = rows.select(F.struct(*rows.columns).alias("_row"), "task", "model", "hour", "repo", "tokens_in", "depth")  # whatever else the rows hold is out of the way
    d = own.join(tasks, F.col("task") == F.col("_known"), "left").withColumn("_task_or", F.coalesce("_known", F.lit("unknown"))).drop("_known")
    d, total = _with(d, model.coefs, [(k, "_task_or" if k == "task" else c, m) for k, c, m in STAGES])
    value = F.greatest(F.lit(0.01), F.lit(n.intercept) + F.col("tokens_in") / 1000 * n.context + F.col("depth") * n.depth + total)
    cents = lambda x: F.floor(x * 100 + 0.5) / 100
    d = d.withColumn("_value", value)
    confidence = min(0.95, max(0.3, n.r2 * 0.7 + min(n.events / 10_000, 0.3)))
    v, width = F.col("_value"), 1.96 * n.mae
    return d.select("_row.*", cents(v).alias("predicted"), F.greatest(F.lit(0.01), cents(v - width)).alias("low"), cents(v + width).alias("high"), F.lit(confidence).alias("confidence"))


def save(model: CostModel, folder: str) -> None:
    """Coefficients first, then a small file that names them: a model is there whole or not at all."""
    spark = model.coefs.sparkSession
    files = Folder(spark, folder)
    place = f"coefs-{len(files.names(''))}"
    model.coefs.write.mode("overwrite").parquet(f"{folder}/{place}")
    files.put("model.json", json.dumps({"version": VERSION, "coefs": place, "schema": COEFS, "numbers": asdict(model.numbers)}), replace=True)


def load(spark: SparkSession, folder: str) -> CostModel:
    """What save wrote. Another version, schema or set of numbers, or one that isn't finite, is an error."""
    held = json.loads(Folder(spark, folder).text("model.json"))
    if held.get("version") != VERSION or held.get("schema") != COEFS:
        raise ValueError(f"not a model of version {VERSION}")
    try:
        numbers = Numbers(**held["numbers"])
    except TypeError as e:
        raise ValueError("the model's numbers are not those of this version") from e
    if not all(isinstance(x, (int, float)) and math.isfinite(x) for x in asdict(numbers).values()):
        raise ValueError("the model has a number that isn't finite")
    coefs = spark.read.parquet(f"{folder}/{held['coefs']}")
    if [(f.name, f.dataType.simpleString()) for f in coefs.schema.fields] != [tuple(x.split()) for x in COEFS.split(", ")]:
        raise ValueError(f"the coefficients have the schema {coefs.schema.simpleString()}")
    if not coefs.where("kind IS NULL OR key IS NULL OR value IS NULL OR isnan(value) OR abs(value) = double('inf')").isEmpty():
        raise ValueError("a coefficient is missing or not finite")
    return CostModel(numbers, coefs)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as requests."""
    task = F.when(F.col("l_returnflag") == "R", "refactor").when(F.col("l_returnflag") == "A", "debug").otherwise("feature")
    cost = F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double")) / 10_000
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", task.alias("task"), F.col("l_linestatus").alias("model"), F.col("l_linenumber").alias("hour"), F.col("l_suppkey").alias("repo"), (F.col("l_quantity").cast("double") * 1000).alias("tokens_in"), F.col("l_linenumber").alias("depth"), cost.alias("cost"))


def f23_cost_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four orders in five are learnt from; the errors of the fifth's lines by task, beside those of the mean."""
    rows = _rows(spark, sf_dir)
    model = train(rows.where("l_orderkey % 5 <> 0"))
    held = predict(rows.where("l_orderkey % 5 = 0"), model)
    return held.groupBy("task").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("cost") - F.col("predicted"))), 4).alias("error"), F.round(F.avg("predicted"), 3).alias("predicted"), F.round(F.avg((F.col("cost").between(F.col("low"), F.col("high"))).cast("double")), 3).alias("within"))


QUERIES = {"f23_cost_prediction": f23_cost_prediction}
#: The stages one after another as means of what the last one left.
ORACLE_SQL = {
    "f23_cost_prediction": """WITH x AS (SELECT l_orderkey % 5 = 0 AS held, CASE l_returnflag WHEN 'R' THEN 'refactor' WHEN 'A' THEN 'debug' ELSE 'feature' END AS task, l_linestatus AS model, l_linenumber AS hour, l_suppkey AS repo, CAST(l_quantity AS DOUBLE) * 1000 AS t, CAST(l_linenumber AS DOUBLE) AS depth, CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE)) / 10000 AS cost FROM lineitem),
        s AS (SELECT covar_pop(t, cost) / var_pop(t) AS a, covar_pop(depth, cost) / var_pop(depth) AS b FROM x WHERE NOT held), r0 AS (SELECT x.*, cost - a * t - b * depth AS r FROM x, s),
        c1 AS (SELECT task, avg(r) AS m FROM r0 WHERE NOT held GROUP BY task), r1 AS (SELECT r0.* REPLACE (r - coalesce(m, 0.05e0) AS r) FROM r0 LEFT JOIN c1 USING (task)),
        c2 AS (SELECT model, avg(r) AS m FROM r1 WHERE NOT held GROUP BY model), r2 AS (SELECT r1.* REPLACE (r - coalesce(m, 0) AS r) FROM r1 LEFT JOIN c2 USING (model)),
        c3 AS (SELECT hour, avg(r) AS m FROM r2 WHERE NOT held GROUP BY hour HAVING count(*) >= 10), r3 AS (SELECT r2.* REPLACE (r - coalesce(m, 0) AS r) FROM r2 LEFT JOIN c3 USING (hour)),
        c4 AS (SELECT repo, avg(r) AS m FROM r3 WHERE NOT held GROUP BY repo HAVING count(*) >= 20), r4 AS (SELECT r3.* REPLACE (r - coalesce(m, 0) AS r) FROM r3 LEFT JOIN c4 USING (repo)),
        i AS (SELECT avg(r) AS i FROM r4 WHERE NOT held), e AS (SELECT avg(abs(r - i)) * 1.96e0 AS w FROM r4, i WHERE NOT held),
        v AS (SELECT task, cost, greatest(0.01e0, cost - r + i) AS v, w FROM r4, i, e WHERE held), p AS (SELECT task, cost, floor(v * 100 + 0.5e0) / 100 AS predicted, greatest(0.01e0, floor((v - w) * 100 + 0.5e0) / 100) AS low, floor((v + w) * 100 + 0.5e0) / 100 AS high FROM v)
        SELECT task, count(*) AS n, round(avg(abs(cost - predicted)), 4) AS error, round(avg(predicted), 3) AS predicted, round(avg(CAST(cost BETWEEN low AND high AS DOUBLE)), 3) AS within FROM p GROUP BY task""",
}
