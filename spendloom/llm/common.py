"""Helpers that every training-data operator uses: tables, the shared folder, batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word of the contracts: a run without space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local runs get a temporary one and others an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = held.get() if held.isDefined() else f"file://{tempfile.mkdtemp(prefix='spendloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/") if "://" in found or found.startswith("file:") else f"file://{found.rstrip('/')}"


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Tables written on the way to a result; those that nothing reads any more are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, {}, 0

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        path = new_folder(self.spark, tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        self.kept += 1
        if self.kept % 4 == 0:
            self.rest()
        return out

    def drop(self, *tables: DataFrame) -> None:
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for x in tables:
            _, path = self.paths.pop(id(x))
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(hadoop).delete(at, True)

    def rest(self) -> None:
        """Lets the driver's JVM give back what plans and results of finished steps held; its heap grows with many plans otherwise."""
        self.spark.sparkContext._jvm.java.lang.System.gc()

    def drop_but(self, *tables: DataFrame) -> None:
        held = set(map(id, tables))
        self.drop(*[x for k, (x, _) in list(self.paths.items()) if k not in held])


#: Parts that the rows of one key are dealt over.
SALTS = 64


def dealt(df: DataFrame, by: list[str], salts: int = SALTS) -> DataFrame:
    """df with part: a number from a hash of some columns."""
    return df.withColumn("part", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))


def with_groups(df: DataFrame, keys: list[str], values: dict[str, tuple], by: list[str], salts: int = SALTS) -> DataFrame:
    """df with the least or largest value of each row's group: {name: (F.min or F.max, column)}. Null keys have no group, and their rows go.

    A group is dealt over parts, each is summed before the shuffle, and the sums
    of its parts (salts at most) go back to just the parts that exist: no task
    gets more than one part of a group's rows.
    """
    d = dealt(df, by, salts)
    parts = d.groupBy(*keys, "part").agg(*[f(c).alias(n) for n, (f, c) in values.items()])
    whole = parts.groupBy(*keys).agg(*[f(n).alias(n) for n, (f, _) in values.items()], F.collect_list("part").alias("part"))
    return d.join(whole.withColumn("part", F.explode("part")), [*keys, "part"]).drop("part")


def attach(df: DataFrame, keys: list[str], values: DataFrame, by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """df joined to values, which holds a key once: the rows of one key are dealt over parts, and its value is sent to just the parts that exist."""
    d = dealt(df, by, salts)
    sent = d.select(*keys, "part").distinct().join(values, keys)
    return d.join(sent, [*keys, "part"], how).drop("part")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = "_" + name
    return name


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, as one row may hold a very long text, and lets Python workers find this package."""
    root, held = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in held.get("PYTHONPATH", "").split(os.pathsep):
        held["PYTHONPATH"] = os.pathsep.join(x for x in (root, held.get("PYTHONPATH")) if x)
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))):
        spark.conf.set(key, value)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20, most_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds at most so many bytes in a column, or one row."""
    sizes = batch.column(column)
    lengths = pa.compute.binary_length(sizes).fill_null(0).to_pylist() if len(sizes) else []
    at = held = 0
    for i, n in enumerate(lengths):
        if i > at and (held + n > most_bytes or i - at >= most_rows):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if len(lengths) > at:
        yield batch.slice(at)
