"""Packing: minimum bin slack over a length histogram, by bitset subset sums with backtracked counts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, stored, table
from .encoder import encoder

WINDOW = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def fill(counts: Counter, room: int) -> list[tuple[int, int]]:
    """The multiset of lengths whose sum comes closest to room from below, as (length, count).

    reach is a bitset of the sums that the lengths so far can make; each length
    enters with its count split in powers of two, and the way back through the
    kept bitsets gives the counts.
    """
    goal, reach, steps = 1 << room, 1, []
    within = (goal << 1) - 1
    for size in sorted((s for s, n in counts.items() if n and s <= room), reverse=True):
        left, take = min(counts[size], room // size), 1
        while left > 0:
            take = min(take, left)
            steps.append((size, take, reach))
            reach |= (reach << size * take) & within
            left, take = left - take, take * 2
            if reach & goal:
                break
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, Counter()
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            at -= size * take
            used[size] += take
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns, each a multiset of lengths with the number of sequences that take it.

    Every pattern holds the largest length left and the fill with least slack.
    It is repeated as long as the counts last, so at least one length falls
    below its need each time and the number of patterns does not depend on the
    number of documents.
    """
    left, out = Counter({s: n for s, n in histogram.items() if n > 0}), []
    while left:
        top = max(left)
        left[top] -= 1
        use = Counter({top: 1})
        for size, n in fill(left, window - top):
            use[size] += n
        left[top] += 1
        times = min(left[s] // n for s, n in use.items())
        for s, n in use.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        out.append((sorted(use.items(), reverse=True), times))
    return out


def encode_pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Whole texts as pieces: full windows, then the rest. nth counts a part's pieces of the same length."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(vocabulary), Counter()
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for rows in slices(b, 1):
                out: list[list] = [[] for _ in range(7)]
                for doc, ids in zip(rows.column(0).to_pylist(), enc.encode(rows.column(1).to_pylist())):
                    ids = np.frombuffer(ids, enc.dtype).astype("<u4").tobytes() + end
                    n = len(ids) // 4
                    for at in range(0, n, window):
                        size = min(window, n - at)
                        for c, v in zip(out, (doc, at, size, zlib.crc32(ids[at * 4 : (at + size) * 4]), n, part, seen[size])):
                            c.append(v)
                        seen[size] += 1
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to stored pieces.

    Only the histogram of lengths (at most window rows) comes to the driver, and
    only the plan (at most window rows) is broadcast. A piece's rank among those
    of its length is its nth in its part plus the counts of the parts before.
    """
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").count()
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.withColumn("ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used, sequence = Counter(), 0
    for use, times in plan(histogram, window):
        at = 0
        for size, n in use:
            slots.setdefault(size, []).append((used[size], n, at, sequence))
            used[size] += n * times
            at += size * n
        sequence += times
    planned = spark.createDataFrame([(s, v) for s, v in slots.items()], "length long, slots array<struct<lo:long,n:long,at:long,sequence:long>>")
    ranked = pieces.join(by_part, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("ahead"))
    slot = F.element_at(F.filter("slots", lambda s: s["lo"] <= F.col("rank")), -1)
    out = ranked.join(F.broadcast(planned), "length").withColumn("slot", slot).withColumn("k", F.col("rank") - F.col("slot.lo"))
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("slot.sequence") + F.expr("k div slot.n")).alias("sequence_id"),
        (F.col("slot.at") + F.col("k") % F.col("slot.n") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Packs all documents into sequences of at most window tokens.

    Nulls: a null text is the end id alone; a null doc_id stays null. Repeated
    rows are packed each for itself. Very long texts give many full windows.
    Empty table: no rows. Ties among equal lengths follow the scan's order,
    which the stored pieces fix. Columns besides doc_id and text are ignored.
    """
    return place(stored(encode_pieces(docs, vocabulary, end_id, window), "pieces"), window)


def op4_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
