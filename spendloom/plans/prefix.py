"""Running totals over a whole table, without one task that sees all of it.

Rows are dealt into ranges of their order and written; the total of each range
is small, and running totals of those give each range what came before it.
Within a range, a window does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut


def ranges(df: DataFrame, order: list[Column], name: str = "_range") -> DataFrame:
    """df with the number of its range: rows of a later range come later in order; rows that tie are in one range."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: list[Column], totals: dict[str, tuple]) -> DataFrame:
    """df with, for each {name: (F.sum or F.max, column)}, the aggregate over all rows before it in order (null for the first).

    order should have no ties, as it breaks them at will; aggregate equal rows
    first, also because a range holds all rows that tie.
    """
    dealt = ranges(df, order)
    each = dealt.groupBy("_range").agg(*[f(c).alias(n) for n, (f, c) in totals.items()])
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shuffle partition
    before = each.select("_range", *[f(n).over(ahead).alias(f"_{n}") for n, (f, _) in totals.items()])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = {F.sum: lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), F.max: F.greatest}
    out = dealt.join(F.broadcast(before), "_range")
    return out.select(*df.columns, *[both[f](F.col(f"_{n}"), f(c).over(within)).alias(n) for n, (f, c) in totals.items()])
