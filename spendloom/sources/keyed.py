"""A keyed table as a sink: insert or replace by key, batch by batch, each at most once, with versions that appear whole.

Rows lie in buckets of their keys' hashes. A batch writes the buckets it
touches to a folder of its own, through Spark's commit of tasks; then the driver
writes a manifest that names the folder of every bucket. A reader sees the
latest manifest, so a batch is there whole or not at all. Manifests are numbered
and never overwritten: of two writers one fails. A manifest also holds the
number of its batch: one that is run again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .transcripts import last_written

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer has made the version, or a key that may not come twice has come twice."""


class Folder:
    """Small files and folders through Hadoop, so that any path works that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def is_folder(self) -> bool:
        return self.fs.getFileStatus(self._path("")).isDirectory()

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str, replace: bool = False) -> None:
        """Writes beside the place, then renames: a reader never sees half a file. Without replace a file that is there is a conflict."""
        beside, at = self._path(f"{name}.{uuid.uuid4().hex}.tmp"), self._path(name)
        stream = self.fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if replace:
            self.fs.delete(at, False)
        if (not replace and self.fs.exists(at)) or not self.fs.rename(beside, at):
            self.fs.delete(beside, False)
            raise Conflict(f"{name} is there already")

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass
class Manifest:
    version: int
    batch: int
    schema: str
    buckets: dict[str, str]


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, Folder(spark, folder), keys, buckets

    def manifest(self) -> Manifest | None:
        found = [n for n in self.folder.names("manifest") if n.endswith(".json")]
        return Manifest(**json.loads(self.folder.text(f"manifest/{found[-1]}"))) if found else None

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The latest version, or some of its buckets; None before the first batch."""
        m = self.manifest()
        if m is None:
            return None
        schema = T.StructType.fromJson(json.loads(m.schema))
        wanted = [p for b, p in m.buckets.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*[f"{self.folder.root}/{p}" for p in wanted]) if wanted else self.spark.createDataFrame([], schema)

    def apply(self, batch: DataFrame, number: int, merge: Merge) -> bool:
        """Merges a batch into the buckets that its keys fall in. False: the number isn't above the last one's, and nothing is done."""
        held = self.manifest()
        if held and number <= held.batch:
            return False
        touched = sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())  # buckets at most
        if not touched and held is None:
            return False
        version = held.version + 1 if held else 0
        place = f"data/{version:08d}-{uuid.uuid4().hex[:8]}"
        before = self.read(touched)
        merged = merge(before if before is not None else batch.where("false"), batch)
        merged.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder.root}/{place}")
        there = {n.partition("=")[2] for n in self.folder.names(place) if n.startswith("_bucket=")}
        kept = {b: p for b, p in (held.buckets if held else {}).items() if int(b) not in touched}
        new = Manifest(version, number, merged.schema.json(), kept | {str(b): f"{place}/_bucket={b}" for b in touched if str(b) in there})
        try:
            self.folder.put(f"manifest/{version:08d}.json", json.dumps(vars(new)))
        except Conflict:
            self.folder.drop(place)
            raise
        return True

    def vacuum(self, versions: int = 2) -> None:
        """Drops what the last so many versions don't name: old data, and that of batches that never finished."""
        found = [n for n in self.folder.names("manifest") if n.endswith(".json")]
        used = {p.split("/")[1] for n in found[-versions:] for p in json.loads(self.folder.text(f"manifest/{n}"))["buckets"].values()}
        for n in found[:-versions]:
            self.folder.drop(f"manifest/{n}")
        for n in self.folder.names("data"):
            if n not in used:
                self.folder.drop(f"data/{n}")

    def replace(self, order: Column) -> Merge:
        """Insert or replace: of a key's rows, old or new, the greatest by order stays."""
        return lambda old, new: last_written(old.unionByName(new), self.keys, order)

    def unique(self) -> Merge:
        """Insert alone: a key that is there already, or comes twice, is a conflict and the batch leaves no trace."""

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.unionByName(new)
            if again := both.groupBy(*self.keys).count().where("count > 1").limit(3).collect():
                raise Conflict(f"keys that are there already: {[tuple(r)[:-1] for r in again]}")
            return both

        return merge

    def sink(self, merge: Merge) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function: a stream's batches, each taken once, also by a query that starts again."""

        def write(batch: DataFrame, number: int) -> None:
            batch.persist()  # read for its buckets and for the merge
            try:
                self.apply(batch, number, merge)
            finally:
                batch.unpersist()

        return write


@dataclass(frozen=True)
class Sent:
    attempted: int
    sent: int
    stopped: bool
    cursor: tuple | None


def forward(rows: DataFrame, at: str, tie: str, deliver: Callable[[dict], bool], folder: Folder, name: str, page: int = 100, most: int = 500) -> Sent:
    """Delivers rows in order of (at, tie), from the saved cursor on, most at a time.

    Stops at the first row that isn't taken (False or an error) and never moves
    the cursor past it. The cursor is saved after each row that was taken. Null
    times and ties are never delivered. A page is at most page rows, so the
    driver holds few.
    """
    saved = tuple(json.loads(folder.text(name))) if name in folder.names("") else None
    attempted = sent = 0
    while attempted < most:
        size = min(page, most - attempted)
        left = rows.where(F.col(at).isNotNull() & F.col(tie).isNotNull())
        key = F.unix_micros(F.col(at).cast("timestamp"))
        if saved:
            left = left.where((key > saved[0]) | (key == saved[0]) & (F.col(tie) > saved[1]))
        some = left.withColumn("_key", key).orderBy("_key", tie).limit(size).collect()
        for r in some:
            row = r.asDict(True)
            attempted += 1
            at_key = row.pop("_key")
            try:
                taken = deliver(row)
            except Exception:
                taken = False
            if not taken:
                return Sent(attempted, sent, True, saved)
            sent, saved = sent + 1, (at_key, row[tie])
            folder.put(name, json.dumps(saved), replace=True)
        if len(some) < size:
            break
    return Sent(attempted, sent, False, saved)
