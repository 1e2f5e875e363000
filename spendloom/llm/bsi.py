"""Exact top-k inner products by bit-sliced indexes.

A block of rows is held as bitmaps: for each component and each bit of its
quantised value, one bit for each row. A query adds the slices, weighted by its
own components, in carry-save adders; the sum is again a stack of bitmaps. The
top rows are picked from the most significant slice downward, and rows that tie
at the boundary are taken in order of vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table

K = 20
SCALE = 64
EVERY = 20
#: Rows of a candidate block, and of a query block at least; query blocks grow so that there are PARTS at most.
BLOCK, QUERIES, PARTS = 65_536, 256, 1_000


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): floor(scale * x). Vectors that are null, empty, or hold null or non-finite components are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return rows.where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def slices_of(values: np.ndarray) -> list[np.ndarray]:
    """Bitmaps (component, word) of a (row, component) table, least bit first; the last is the sign's."""
    width = max(1, int(max(values.max(initial=0), -1 - values.min(initial=0))).bit_length() + 1)
    rows = np.zeros((values.shape[1], -(-len(values) // 64) * 64), np.int64)
    rows[:, : len(values)] = values.T
    return [np.packbits((rows >> b & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in range(width)]


def digits(v: int) -> list[tuple[int, int]]:
    """Non-adjacent form: v as a sum of sign * 2**shift, no two shifts next to each other."""
    out, shift = [], 0
    while v:
        if v & 1:
            d = 2 - (v & 3)
            out.append((d, shift))
            v -= d
        v >>= 1
        shift += 1
    return out


def add_up(index: list[np.ndarray], query: np.ndarray) -> list[np.ndarray]:
    """Slices of the inner product with every row, least first, as two's complement.

    Each digit of a query component adds the component's slices, shifted, or
    their complement for a negative digit. Columns of bitmaps are reduced three
    to two by full adders until one bitmap is left in each.
    """
    width, top = len(index), int(np.abs(query).sum()) or 1
    bits = (top << (width - 1)).bit_length() + 1
    columns: list[list[np.ndarray]] = [[] for _ in range(bits)]
    constant = 0
    for c, v in enumerate(query.tolist()):
        for sign, shift in digits(v):
            for b in range(width):
                at = shift + b
                if at >= bits:
                    break
                plane = index[b][c]
                # The sign slice weighs -2**b, so it enters as its complement and a constant, as does a subtraction.
                if (sign < 0) != (b == width - 1):
                    columns[at].append(~plane)
                    constant -= 1 << at
                else:
                    columns[at].append(plane)
    for b in range(bits):
        if constant >> b & 1:
            columns[b].append(None)
    ones = ~np.zeros_like(index[0][0])
    for b in range(bits):
        held = [ones if x is None else x for x in columns[b]]
        while len(held) >= 3:
            x, y, z = held.pop(0), held.pop(0), held.pop(0)
            t = x ^ y
            held.append(t ^ z)
            if b + 1 < bits:
                x = x & y
                t &= z
                x |= t
                columns[b + 1].append(x)
        if len(held) == 2:
            x, y = held
            held = [x ^ y]
            if b + 1 < bits:
                columns[b + 1].append(x & y)
        columns[b] = held
    return [c[0] if c else np.zeros_like(ones) for c in columns]


def count(words: np.ndarray) -> int:
    return int(np.bitwise_count(words).sum())


def rows_of(words: np.ndarray, most: int | None = None) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))[:most]


def top_rows(total: list[np.ndarray], among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k highest sums among the marked rows, best first, ties to the earlier row."""
    sure, open_ = np.zeros_like(among), among
    if count(among) > k:
        need = k
        for level in range(len(total) - 1, -1, -1):
            plane = ~total[level] if level == len(total) - 1 else total[level]
            high = open_ & plane
            n = count(high)
            if n > need:
                open_ = high
            else:
                sure, open_, need = sure | high, open_ & ~plane, need - n
                if not need:
                    break
        rows = np.sort(np.concatenate([rows_of(sure), rows_of(open_, need)]))
    else:
        rows = rows_of(among)
    score = np.zeros(len(rows), np.int64)
    word, bit = rows >> 6, (rows & 63).astype(np.uint64)
    for level, plane in enumerate(total):
        one = (plane[word] >> bit & np.uint64(1)).astype(np.int64) << level
        score += -one if level == len(total) - 1 else one
    best = np.lexsort((rows, -score))
    return rows[best], score[best]


def _narrow(q: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them."""
    top = max(int(q.max(initial=0)), -1 - int(q.min(initial=0)))
    return q.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def _wide(q: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(q, f"<i{len(q) // (rows * dims)}").reshape(rows, dims).astype(np.int64)


def _blocks(rows: DataFrame, size: int, total: int) -> DataFrame:
    """(block, dims, ids, q): rows as the scan gives them, packed. Block numbers are unique, not dense. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, ids, values = TaskContext.get().partitionId() << 32, 0, [], {}

        def flush(dims: int):
            nonlocal nth
            held = values.pop(dims)
            i, q = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            nth += 1
            return pa.record_batch([pa.array([part + nth]), pa.array([dims], pa.int32()), pa.array([i.tobytes()], pa.binary()), pa.array([_narrow(q).tobytes()], pa.binary())], names=["block", "dims", "ids", "q"])

        for b in batches:
            q = b.column(1)
            lengths, flat, i = pa.compute.list_value_length(q).to_numpy(zero_copy_only=False), q.flatten().to_numpy(), b.column(0).to_numpy()
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dims)
                for lo in range(0, len(mine), size):
                    some = mine[lo : lo + size]
                    values.setdefault(dims, []).append((i[some], flat[(starts[some, None] + np.arange(dims)).ravel()].reshape(-1, dims)))
                    if sum(len(h[0]) for h in values[dims]) + 1000 > size:
                        yield flush(dims)
        for dims in list(values):
            yield flush(dims)

    return rows.coalesce(max(1, -(-total // size))).mapInArrow(run, "block long, dims int, ids binary, q binary")


def _first_of_each(rows: DataFrame) -> DataFrame:
    """One vector for each id: the least by its components, so that reruns agree."""
    key, value = rows.columns
    return rows.groupBy(key).agg(F.min(value).alias(value))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows but its own, ties to the smaller vec_id.

    Query blocks meet candidate blocks by a join on their number of components
    (dims), the packed blocks as rows: every row is scored against the stated
    queries, each block pair by one task that returns k rows for a query. Vectors
    meet only those with as many components. Rows that share a vec_id are
    candidates each for itself but not for a query of that id, which counts once,
    with the least vector by its components.
    Rows left out: see quantised. Components must stay below 2**31 when scaled.
    Empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    n_queries = queries.count()
    query_block = max(query_block, -(-n_queries // PARTS))
    rows = _blocks(quantised(vectors, scale), block, vectors.count())
    wanted = _blocks(_first_of_each(quantised(queries, scale)), query_block, n_queries)
    rows, wanted = stored(rows, "bsi"), stored(wanted, "bsi-queries").withColumnsRenamed({"block": "query_block", "ids": "query_ids", "q": "query_q"})
    # One partition for a block pair or few: dims is one value or few, so the pairs are dealt out by both block numbers.
    parts = [r[0] for r in wanted.select("query_block").collect()]  # PARTS numbers at most, and what partly filled blocks add
    numbers = F.array(*[F.lit(p) for p in parts]) if parts else F.array().cast("array<long>")
    pairs = rows.withColumn("query_block", F.explode(numbers))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = pairs.join(wanted.withColumnRenamed("dims", "query_dims"), "query_block").where("dims = query_dims").repartition(n, "block", "query_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dims, ids, q, query_ids, query_q in zip(*(b.column(i).to_pylist() for i in range(5))):
                ids, query_ids = np.frombuffer(ids, np.int64), np.frombuffer(query_ids, np.int64)
                order = np.argsort(ids, kind="stable")
                ids, q = ids[order], _wide(q, len(ids), dims)[order]
                index = slices_of(q)
                every = np.packbits(np.arange(index[0].shape[1] * 64) < len(ids), bitorder="little").view(np.uint64)
                out: list[list] = [[], [], []]
                for i, v in zip(query_ids.tolist(), _wide(query_q, len(query_ids), dims)):
                    among = every
                    lo, hi = np.searchsorted(ids, [i, i + 1])
                    if hi > lo:
                        among = every.copy()
                        for r in range(lo, hi):
                            among[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
                    found, score = top_rows(add_up(index, v), among, k)
                    for c, x in zip(out, (np.full(len(found), i), ids[found], score)):
                        c.append(x)
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    found = pairs.select("dims", "ids", "q", "query_ids", "query_q").mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
