"""Product quantisation of integer vectors: codebooks learnt by treeAggregate over columnar blocks.

Rows are packed into blocks, one integer column after another. A task adds up
the squared distances of a block to a codebook dimension by dimension, adds the
parts to int64 tensors of sums and counts at their nearest entry (np.add.at),
and the tensors are merged through a tree of reductions. Only the tensors, whose
size is fixed by the number of components, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, attach, small_batches, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a block at most.
BLOCK = 8_192
#: Scaled components stay below this, so that sums of squares and of parts fit 64 bits.
LIMIT = 1 << 24
#: Levels of the reduction tree.
DEPTH = 3

Books = np.ndarray
Tensors = tuple[np.ndarray, np.ndarray] | None


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q): floor(scale * x). Vectors that are null, or hold null or non-finite components, are left out; an id or label may be null."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def rows_of_lists(column: pa.ListArray, width: int) -> np.ndarray:
    """(row, component) of lists; shorter ones are filled up with zeros."""
    lengths, flat = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy()
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    if len(flat) and max(int(flat.max()), -int(flat.min())) >= LIMIT:
        raise ValueError(f"scaled components must be below {LIMIT} in size")
    return out


def blocks(rows: DataFrame, width: int, total: int, size: int = BLOCK) -> DataFrame:
    """(ids, labels, n, q): rows as the scan gives them, q holding one component of all rows after another. Nothing is shuffled."""

    def packed(ids: list, labels: list, values: list[np.ndarray]) -> pa.RecordBatch:
        q = np.concatenate(values).T.astype(np.int32)
        return pa.record_batch([pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.int64())), pa.array([len(ids)], pa.int32()), pa.array([q.tobytes()], pa.binary())], names=["ids", "labels", "n", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        labels: list = []
        values: list[np.ndarray] = []
        for b in batches:
            for at in range(0, b.num_rows, size):
                some = b.slice(at, size)
                if ids and len(ids) + some.num_rows > size:
                    yield packed(ids, labels, values)
                    ids, labels, values = [], [], []
                ids += some.column(0).to_pylist()
                labels += some.column(1).to_pylist()
                values.append(rows_of_lists(some.column(2), width))
        if ids:
            yield packed(ids, labels, values)

    return rows.coalesce(max(1, -(-total // size))).mapInArrow(run, "ids array<long>, labels array<long>, n int, q binary")


def nearest(q: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance), each (part, row), of a (component, row) block: ties go to the lower entry."""
    parts, entries, dims = books.shape
    codes, least = np.empty((parts, q.shape[1]), np.int64), np.empty((parts, q.shape[1]), np.int64)
    for p in range(parts):
        far = np.zeros((entries, q.shape[1]), np.int64)
        for d in range(dims):
            gap = q[p * dims + d].astype(np.int64)[None, :] - books[p, :, d][:, None]
            gap *= gap
            far += gap
        codes[p] = far.argmin(0)
        least[p] = np.take_along_axis(far, codes[p][None, :], 0)[0]
    return codes, least


def added(held: Tensors, block: tuple[int, bytes], books: Books) -> Tensors:
    """Adds a block's parts to the sums and counts of their nearest entries."""
    parts, entries, dims = books.shape
    q = np.frombuffer(block[1], np.int32).reshape(parts * dims, block[0])
    codes, _ = nearest(q, books)
    sums, counts = held if held is not None else (np.zeros((parts, entries, dims), np.int64), np.zeros((parts, entries), np.int64))
    for p in range(parts):
        np.add.at(sums[p], codes[p], q[p * dims : (p + 1) * dims].T)
        np.add.at(counts[p], codes[p], 1)
    return sums, counts


def merged(one: Tensors, other: Tensors) -> Tensors:
    if one is None or other is None:
        return one if other is None else other
    return one[0] + other[0], one[1] + other[1]


def moved(books: Books, found: Tensors) -> Books:
    """Each entry becomes the floor of its parts' mean; unused ones stay."""
    if found is None:
        return books
    sums, counts = found
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def learn(packed: DataFrame, books: Books, rounds: int = ROUNDS) -> Books:
    """Rounds of assignment and update over the blocks, which tasks read again from the shared folder if an executor is lost."""
    for _ in range(rounds):
        held = books
        found = packed.select("n", "q").rdd.map(lambda r: (r[0], bytes(r[1]))).treeAggregate(None, lambda acc, block, held=held: added(acc, block, held), merged, DEPTH)
        books = moved(books, found)
    return books


def first_books(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> Books:
    """The parts of the rows with the smallest ids (null ids last, repeated ids by vector), as many as a codebook has entries."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q", F.col("label").asc_nulls_last()).limit(entries).select("q").toArrow()
    return rows_of_lists(first.column(0).combine_chunks(), width).reshape(-1, parts, width // parts).transpose(1, 0, 2)


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """(rows, codebooks): vec_id, label, code and error of each kept row, and the final (part, entry, component) entries.

    Kept are rows whose vector is not null and has no null or non-finite
    component; ids and labels may be null. Vectors shorter than the longest, or
    whose length isn't a multiple of parts, count as filled up with zeros.
    Repeated rows count each. With fewer rows than entries the codebooks have as
    many entries as rows; an empty table gives no rows and empty codebooks.
    Other columns are ignored. entries is 256 at most.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    small_batches(spark)
    tables = Tables(spark)
    rows = integers(vectors, scale)
    total, longest = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    width = max(1, -(-(longest or 0) // parts)) * parts
    packed = tables.keep(blocks(rows, width, total), "part-blocks")
    books = learn(packed, first_books(rows, width, parts, entries), rounds) if total else np.zeros((parts, 0, width // parts), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n = b.column(2)[i].as_py()
                codes, least = nearest(np.frombuffer(b.column(3)[i].as_buffer(), np.int32).reshape(width, n), books)
                code = [c.tobytes().hex() for c in np.ascontiguousarray(codes.T.astype(np.uint8))]
                yield pa.record_batch([b.column(0)[i].values, b.column(1)[i].values, pa.array(code, pa.string()), pa.array(least.sum(0))], names=["vec_id", "label", "code", "error"])

    coded = tables.keep(packed.select("ids", "labels", "n", "q").mapInArrow(run, "vec_id long, label long, code string, error long"), "part-codes")
    tables.drop(packed)
    return coded, books


def op11_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    of = coded.withColumns({"unlabelled": F.col("label").isNull(), "of": F.coalesce("label", F.lit(0).cast("long"))})
    sums = of.groupBy("unlabelled", "of").agg(F.sum("error").alias("label_error"))
    out = attach(of, ["unlabelled", "of"], sums, ["vec_id"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _gap(c: str) -> str:
    return " + ".join(f"(x[{i}] - {c}[{i}]) * (x[{i}] - {c}[{i}])" for i in range(1, 5))


def _round(k: int) -> str:
    """Assignment and update of one round, over vectors of 64 components."""
    means = ", ".join(f"CAST(floor(sum(x[{i}]) / count(*)) AS BIGINT)" for i in range(1, 5))
    return f"""a{k} AS MATERIALIZED (SELECT i, p, x, min({{'d': {_gap('c')}, 'e': e}}) AS best FROM p JOIN b{k} USING (p) GROUP BY i, p, x),
    m{k} AS (SELECT p, best.e AS e, [{means}] AS c FROM a{k} GROUP BY p, best.e),
    b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))"""


#: Written apart from the operator, for vectors of 64 components, as the given tables have.
OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS MATERIALIZED (SELECT i, p, q[p * 4 + 1 : p * 4 + 4] AS x FROM v, range(16) AS t(p)),
b0 AS MATERIALIZED (SELECT p, i - 1 AS e, x AS c FROM p WHERE i <= 64),
{_round(0)},
{_round(1)},
a2 AS MATERIALIZED (SELECT i, p, min({{'d': {_gap('c')}, 'e': e}}) AS best FROM p JOIN b2 USING (p) GROUP BY i, p),
r AS (SELECT i, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY i),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (i), h
"""
