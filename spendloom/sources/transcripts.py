"""Transcript lines, keyed tables and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "struct<role:string,model:string,stop_reason:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>>"
LINE = f"type string, timestamp string, sessionId string, uuid string, parentUuid string, role string, content string, message {MESSAGE}"


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of a table with a column value of JSON lines. Blank lines are skipped; a line that isn't an object is an error."""
    some = lines.where(F.trim("value") != "")
    read = F.from_json("value", LINE, {"mode": "PERMISSIVE"})
    object_ = F.coalesce(F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{"), F.lit(False))
    records = some.where(object_).select("value", read.alias("r")).select("r.*", F.get_json_object("value", "$.message.content").alias("inner"))
    return flatten(records), some.where(~object_).select(F.col("value").alias("raw"))


def flatten(records: DataFrame) -> DataFrame:
    """Fields of the inner message win over the outer ones; records without role or content are dropped."""
    out = records.select("type", F.to_timestamp("timestamp").alias("ts"), "sessionId", "uuid", "parentUuid", F.coalesce("message.role", "role").alias("role"), F.coalesce("inner", "content").alias("content"), "message.model", "message.usage")
    return out.where(F.col("role").isNotNull() & F.col("content").isNotNull())


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_lines(spark.read.text(path))


def last_written(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key: the greatest by order (insert or replace). Summed before the shuffle."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(whole, order).alias("row")).select("row.*")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that an append-only table holds more than once."""
    return df.groupBy(*keys).count().where("count > 1")


def write_csv(df: DataFrame, path: str) -> None:
    """Header, lines that end in CR and LF, doubled quotes, nested values as JSON."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("struct", "array", "map")}
    flat = df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])
    flat.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n").csv(path)
