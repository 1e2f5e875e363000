"""Token-ID output: Arrow stream files of fixed-size-list batches with sequences and masks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, slices, small_batches
from .encoder import encoder

SEQUENCE = 1024
#: Sequences in each record batch; every batch but a file's last has as many.
BATCH = 256
INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


@dataclass(frozen=True)
class Shard:
    shard: int
    path: str
    n_docs: int
    n_tokens: int


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _publish(fs: pafs.FileSystem, written: str, final: str) -> None:
    """A retried task replaces what an earlier attempt left."""
    if fs.type_name != "local" and fs.get_file_info(final).type != pafs.FileType.NotFound:
        fs.delete_file(final)
    fs.move(written, final)


class SequenceWriter:
    """Appends ids and writes them as equal-length sequences; the last one is padded and masked."""

    def __init__(self, sink, dtype: np.dtype, sequence: int, batch: int):
        self.item = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(self.item, sequence)), ("mask", pa.list_(pa.bool_(), sequence))], {"sequence": str(sequence), "batch": str(batch)})
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.dtype, self.sequence, self.batch = dtype, sequence, batch
        self.held: list[bytes] = []
        self.bytes = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.bytes += len(ids)
        full = self.sequence * self.batch * self.dtype.itemsize
        if self.bytes >= full:
            data = b"".join(self.held)
            at = 0
            while len(data) - at >= full:
                self._write(np.frombuffer(data, self.dtype, self.sequence * self.batch, at), self.sequence * self.batch)
                at += full
            self.held, self.bytes = [data[at:]], len(data) - at

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(ids, self.item), self.sequence), pa.FixedSizeListArray.from_arrays(mask, self.sequence)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        if len(ids):
            padded = np.zeros(-(-len(ids) // self.sequence) * self.sequence, self.dtype)
            padded[: len(ids)] = ids
            self._write(padded, len(ids))
        self.out.close()


class SequenceReader:
    """Random access to the sequences of one file. On a local file arrays are views of the mapped pages."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        source = pa.memory_map(path) if fs.type_name == "local" else pa.py_buffer(fs.open_input_file(path).read())
        stream = pa.ipc.open_stream(source)
        self.sequence, self.batch = (int(stream.schema.metadata[k]) for k in (b"sequence", b"batch"))
        self.batches = list(stream)

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _row(self, i: int, column: int):
        b, k = divmod(i, self.batch)
        return self.batches[b].column(column).values.slice(k * self.sequence, self.sequence)

    def ids(self, i: int) -> np.ndarray:
        return self._row(i, 0).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.BooleanArray:
        """A view of the file's bits; to_numpy(zero_copy_only=False) widens them to bytes."""
        return self._row(i, 1)

    def span(self, at: int, n: int) -> np.ndarray:
        """Ids at..at+n of the file's running text."""
        size, parts = self.sequence * self.batch, []
        while n > 0:
            b, k = divmod(at, size)
            part = self.batches[b].column(0).values.to_numpy(zero_copy_only=True)[k : k + n]
            parts.append(part)
            at, n = at + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0, np.uint16)])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, sequence: int = SEQUENCE, batch: int = BATCH) -> list[Shard]:
    """Encodes whole texts in ascending doc_id order and writes one stream file and one document index for each range of ids.

    Nulls: a null text is empty and gives the end id alone; null doc_ids come
    first. Rows that share a doc_id keep together in the order of their text's
    hash. Empty table: no files. Columns besides doc_id and text are ignored.
    The returned manifest has one row for each file, none for each document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tie = F.xxhash64("text")
    rows = docs.select("doc_id", "text", tie.alias("_tie")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select(F.col("doc_id").cast("long"), "text")
    fs, root = _open(path)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), None
        task = TaskContext.get()
        k, attempt = task.partitionId(), task.taskAttemptId()
        fs, root = _open(path)
        name, index, writer, total, n_docs = f"{root}/part-{k:05d}", None, None, 0, 0
        temp = f"{root}/_{k:05d}-{attempt}"
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            for part in slices(b, 1):
                if writer is None:
                    data = fs.open_output_stream(f"{temp}.ids")
                    docs_out = fs.open_output_stream(f"{temp}.docs")
                    writer, index = SequenceWriter(data, enc.dtype, sequence, batch), pa.ipc.new_stream(docs_out, INDEX)
                counts = []
                for ids in enc.encode(part.column(1).to_pylist()):
                    writer.add(ids + end)
                    counts.append(len(ids) // enc.dtype.itemsize + 1)
                counts = np.array(counts, np.int64)
                offsets = total + np.cumsum(counts) - counts
                index.write_batch(pa.record_batch([part.column(0), pa.array(offsets), pa.array(counts)], schema=INDEX))
                total, n_docs = total + int(counts.sum()), n_docs + len(counts)
        if writer is not None:
            writer.close()
            index.close()
            data.close()
            docs_out.close()
            _publish(fs, f"{temp}.ids", f"{name}.arrows")
            _publish(fs, f"{temp}.docs", f"{name}.docs.arrows")
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([f"{path}/part-{k:05d}"]), pa.array([n_docs]), pa.array([total])], names=["shard", "path", "n_docs", "n_tokens"])

    made = rows.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long")
    return [Shard(*r) for r in sorted(made.collect())]


def read_tokens(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. start counts the ids of all files before."""
    start, rows = 0, []
    for s in shards:
        rows.append((s.shard, s.path, start))
        start += s.n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = SequenceReader(f"{uri}.arrows")
                fs, path = _open(f"{uri}.docs.arrows")
                with fs.open_input_file(path) as f:
                    for part in pa.ipc.open_stream(f):
                        offsets, counts = (part.column(i).to_numpy() for i in (1, 2))
                        crc = [zlib.crc32(data.span(o, n).astype("<u4").tobytes()) for o, n in zip(offsets.tolist(), counts.tolist())]
                        yield pa.record_batch([part.column(0), pa.array(offsets + base), part.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    manifest = spark.createDataFrame(rows, "shard int, path string, base long").repartition(max(1, len(rows)), "shard")
    return manifest.select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_tokens(docs, new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, shards)
