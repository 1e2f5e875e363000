"""A streaming source over growing line files: offsets are byte positions per file.

spark.dataSource.register(AppendedLines); then read or readStream with
format("appended_lines") and load(path). path is a folder or one file, on any
file system that pyarrow reaches (paths must be shared by driver and executors).

- Half lines are held back: a file's offset ends after its last line break.
- A file that is shorter than its offset, or whose first line changed, was
  truncated or replaced: it is read from its start, and its rows carry another
  version (a digest of the first line), so that state derived from the former
  one can be reset.
- The checkpoint holds the offsets; a batch that is run again reads the same
  bytes. Rows of a file that was replaced meanwhile no longer exist and are left
  out.
- Long stretches are read in ranges by several tasks; a line belongs to the
  range in which it starts. Blank lines are skipped, bytes that aren't UTF-8
  become U+FFFD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..plans.storage import new_folder

SCHEMA = "file string, version string, at long, value string"
#: Bytes of a range, and of the blocks in which a file's end is searched for a line break.
RANGE, BLOCK = 8 << 20, 1 << 16
#: Bytes of a first line that its version is made of.
HEAD = 1 << 12
#: Bytes of text in a batch of rows.
BATCH = 4 << 20


@dataclass
class Stretch(InputPartition):
    """Lines that start in [lo, hi) of a file; end is where the last of the batch's lines ends."""

    path: str
    file: str
    version: str
    lo: int
    hi: int
    end: int
    first: bool


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def last_break(f: Any, size: int) -> int:
    """Where the last whole line of the first size bytes ends (0: there is none)."""
    end = size
    while end > 0:
        start = max(0, end - BLOCK)
        f.seek(start)
        if (at := f.read(end - start).rfind(b"\n")) >= 0:
            return start + at + 1
        end = start
    return 0


def version_of(f: Any) -> str:
    f.seek(0)
    return hashlib.sha256(f.read(HEAD).split(b"\n", 1)[0]).hexdigest()[:16]


def ends(path: str) -> dict[str, list]:
    """{file: [version, bytes of whole lines]} now. Files without a whole line are left out, as are hidden ones."""
    fs, root = located(path)
    found = fs.get_file_info(root)
    files = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    out = {}
    for x in files:
        if x.type == pafs.FileType.File and not x.base_name.startswith((".", "_")):
            with fs.open_input_file(x.path) as f:
                if end := last_break(f, x.size):
                    out[x.path] = [version_of(f), end]
    return out


def stretches(path: str, start: dict[str, list], end: dict[str, list]) -> list[Stretch]:
    """What lies between two offsets. A file that has another version, or fewer bytes than before, starts anew."""
    out = []
    for file, (version, to) in sorted(end.items()):
        held = start.get(file)
        since = held[1] if held and held[0] == version and held[1] <= to else 0
        out += [Stretch(path, file, version, lo, min(lo + RANGE, to), to, lo == since) for lo in range(since, to, RANGE)]
    return out


def lines(s: Stretch) -> Iterator[pa.RecordBatch]:
    fs, _ = located(s.path)
    try:
        f = fs.open_input_file(s.file)
    except FileNotFoundError:
        return
    rows: list[tuple[int, str]] = []
    held = 0

    def batch() -> pa.RecordBatch:
        n = len(rows)
        return pa.record_batch([pa.array([s.file] * n), pa.array([s.version] * n), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["file", "version", "at", "value"])

    with f:
        if f.size() < s.end or version_of(f) != s.version:
            return
        at = s.lo if s.first else s.lo - 1  # a line starts at lo only if a break stands before it
        f.seek(at)
        rest, skip = b"", not s.first
        while at < s.end:
            block = f.read(min(1 << 20, s.end - at - len(rest)))
            parts = (rest + block).split(b"\n")
            if not block:
                break
            for part in parts[:-1]:
                if skip:
                    skip = False
                elif at >= s.hi:
                    break
                elif part.strip():
                    rows.append((at, part.decode("utf-8", "replace").rstrip("\r")))
                    held += len(part)
                    if held >= BATCH:
                        yield batch()
                        rows, held = [], 0
                at += len(part) + 1
            if at >= s.hi and not skip:
                break
            rest = parts[-1]
    if rows:
        yield batch()


class _Reader:
    def __init__(self, path: str):
        self.path = path

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return lines(partition)


class BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        return stretches(self.path, {}, ends(self.path))


class StreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return ends(self.path)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return stretches(self.path, start, end)

    def commit(self, end: dict) -> None:
        pass


class AppendedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return BatchReader(self.options["path"])

    def streamReader(self, schema: Any) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(self.options["path"])


def s2_appended_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations written as growing line files and read as they grow: half of them before the first read, the rest before the second, which goes on from its checkpoint."""
    spark.dataSource.register(AppendedLines)
    folder = new_folder(spark, "appended")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("value"))
    for half in (0, 1):
        turns.where(F.pmod("conv_id", F.lit(2)) == half).select("value").write.mode("append").text(f"{folder}/in")
        query = spark.readStream.format("appended_lines").load(f"{folder}/in").writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
        query.awaitTermination()
    read = F.from_json("value", "conv_id long, turn long, role string, text string").alias("r")
    return spark.read.schema(SCHEMA).parquet(f"{folder}/out").select(read).select("r.conv_id", "r.turn", "r.role", F.sha2(F.coalesce("r.text", F.lit("")), 256).alias("digest"))


QUERIES = {"s2_appended_lines": s2_appended_lines}
ORACLE_SQL = {"s2_appended_lines": "SELECT conv_id, turn, role, sha256(coalesce(text, '')) AS digest FROM conversations"}
