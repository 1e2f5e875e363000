"""Spreads small tables for work that is dear for each row, and deals large ones into parts that don't grow with them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: A table with at least so many bytes for each core has row groups enough to keep all cores busy.
BYTES = 128 << 20

#: Narrow rows of a part, and bytes of files and rows of a part of texts: what a task sorts or groups at once.
ROWS, TEXT_BYTES, TEXT_ROWS = 1 << 20, 8 << 20, 1 << 13

#: So many parts are written without sorting a reader's rows in memory (spark.shuffle.sort.bypassMergeThreshold).
UNSORTED = 200


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of that many narrow rows, dealt by keys into parts of about ROWS: grouping and joining by these keys needs no other shuffle, and a larger table has more tasks, not larger ones. What fits one part stays as it is."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS)), *keys) if rows > ROWS else df


def _sent(df: DataFrame) -> bool:
    """Whether Spark sends df to all tasks of a join."""
    return _bytes(df) <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def dealt_joins(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables by name: where line items meet orders and are over ROWS for each core, they are dealt by order into parts of about ROWS, 2 ROWS at most (counted from the files' footers), and customers by key into as many. Spark deals the other side of a join alike, so a task sorts and joins one part whatever the tables' size. Tables that are sent need no dealing."""
    if not {"lineitem", "orders"} <= set(tables) or _sent(tables["orders"]):
        return tables
    spark = tables["lineitem"].sparkSession
    least = ROWS * spark.sparkContext.defaultParallelism
    if _bytes(tables["lineitem"]) <= least or (rows := tables["lineitem"].count()) <= least:  # a row takes a byte at least
        return tables
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(UNSORTED, math.ceil(rows / ROWS)), math.ceil(rows / ROWS / 2))  # fewer than Spark's own would be dealt again
    keys = {"lineitem": "l_orderkey"} | ({"customer": "c_custkey"} if "customer" in tables and not _sent(tables["customer"]) else {})
    return tables | {t: tables[t].repartition(parts, key) for t, key in keys.items()}


def dealt_texts(table: DataFrame, *keys: str) -> DataFrame:
    """A table of texts dealt by keys into parts of about TEXT_BYTES of its files and TEXT_ROWS rows (counted from the files' footers), one for each core at least."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(cores, math.ceil(_bytes(table) / TEXT_BYTES), math.ceil(table.count() / TEXT_ROWS)), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over all cores if it is small, as a file of one row group is read by one task whatever is done to its rows. Large tables stay as they are: no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if _bytes(df) < cores * BYTES else df
