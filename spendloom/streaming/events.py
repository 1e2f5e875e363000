"""Event streams: tumbling and session aggregates with watermarks, and a keyed sink that takes repeated batches once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import Folder


def tail(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files as they appear; the checkpoint holds the offsets. ts becomes a TIMESTAMP, which watermarks need."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user end after a gap. State is held until the watermark passes the end."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("events"), F.sum("value").alias("spend")).select("user_id", F.col("w.start").alias("started"), "events", "spend")


def keyed_sink(folder: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each key once: a batch that is run again overwrites its own folder, and keys of other batches are left out. Rows with a null key are always written.

    The keys written so far are read for each batch; sources.keyed.KeyedTable
    reads only the buckets that a batch touches, and replaces rows as well.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        if others := [n for n in Folder(spark, folder).names("") if n.startswith("batch=") and n != f"batch={number}"]:
            known = spark.read.schema(batch.select(*keys).schema).parquet(*[f"{folder}/{n}" for n in others])
            rows = rows.join(known, keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write
