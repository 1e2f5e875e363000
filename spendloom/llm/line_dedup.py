"""Substring dedup by line hashing: the earliest ranked occurrence of a passage stays, the later ones go.

A unit is a part of a line up to a punctuation mark. Whatever its length, a unit
is hashed with its neighbours, in runs of MIN_WORDS words or more: those that
have fewer without their first unit, and without their last; and from each line's
start and to each line's end the shortest. A run whose digest has an earlier
occurrence goes. So a passage goes where it stands elsewhere in one piece,
however its lines are set (within lines, less than a unit at its edges may stay),
and a short phrase that recurs by chance stays.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, table

#: Words of a run: shorter passages stay wherever they are.
MIN_WORDS = 40
#: Digests that a task remembers before it passes them on.
MEMO = 100_000
UNIT = re.compile(r"[^.,;:!?\n]+[.,;:!?\n]*|[.,;:!?\n]+")
_BOUND = re.compile(r"[.,;:!?\n]")
_FLAT = {ord(c): None for c in string.punctuation} | dict.fromkeys(map(ord, ".,;:!?\n"), "\n") | dict.fromkeys((9, 11, 12, 13), " ")


def normalised(text: str) -> list[tuple[str, int, int]]:
    """(words, start, end) of each unit with words: ASCII punctuation dropped, lower case, single spaces for those and \\x09-\\x0D."""
    bounds = [m.start() for m in _BOUND.finditer(text)]
    out, n = [], len(bounds)
    for k, part in enumerate(text.translate(_FLAT).lower().split("\n")):
        words = part.strip(" ")
        if words:
            if "  " in words:
                words = " ".join(w for w in words.split(" ") if w)
            last = k
            while last + 1 < n and bounds[last + 1] == bounds[last] + 1:
                last += 1
            out.append((words, bounds[k - 1] + 1 if k else 0, bounds[last] + 1 if k < n else len(text)))
    return out


def runs(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[bytes, int, int]]:
    """(digest, start, end) of each run, in code points. Units without words are in no run of their own."""
    units = normalised(text)
    n, upto, place = len(units), [0], [0]
    for words, _, _ in units:
        upto.append(upto[-1] + words.count(" ") + 1)
        place.append(place[-1] + len(words) + 1)
    if upto[-1] < min_words:
        return
    opens = [i == 0 or text.find("\n", units[i - 1][1], units[i][1]) >= 0 for i in range(n)]
    spans = {(i, j - 1) for i in range(n) if opens[i] and (j := bisect_left(upto, upto[i] + min_words)) <= n}
    i = 0
    for j in range(n):
        if upto[j + 1] - upto[i] >= min_words:
            while upto[j + 1] - upto[i + 1] >= min_words:
                i += 1
            if upto[j] - upto[i] < min_words or j + 1 == n or opens[j + 1]:
                spans.add((i, j))
    whole = " ".join(u[0] for u in units)
    for i, j in sorted(spans):
        words = whole[place[i] : place[j + 1] - 1].encode("utf-8", "surrogatepass")
        yield hashlib.blake2b(words, digest_size=16).digest(), units[i][1], units[j][2]


_OUT = ["hi", "lo", "none", "doc_id", "row", "start", "end"]


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, start, end) of the runs that an earlier one repeats: by (doc_id, row, start), null ids last. row: the text's hash.

    A task keeps the earliest run of each digest that it has met; the later of
    two is a repeat and leaves at once (without a digest). What it keeps is then
    ranked by digest, so a digest brings one row for each task and MEMO digests,
    however many documents hold it, and runs are shuffled once.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple] = {}

        def batch(found: list[tuple], digests: list[bytes] | None) -> pa.RecordBatch:
            cols = list(zip(*found)) if found else [()] * 5
            halves = [pa.nulls(len(found), pa.int64())] * 2
            if digests is not None:
                halves = [pa.array(c) for c in np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2).T]
            kinds = [pa.bool_(), *[pa.int64()] * 4]
            return pa.record_batch([*halves, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=_OUT)

        def flushed() -> Iterator[pa.RecordBatch]:
            found, digests = list(memo.values()), list(memo)
            memo.clear()
            for at in range(0, len(found), 20_000):
                yield batch([(r[0], None if r[0] else r[1], *r[2:]) for r in found[at : at + 20_000]], digests[at : at + 20_000])

        for b in batches:
            for rows in slices(b, 2):
                late = []
                for doc, row, text in zip(*(rows.column(i).to_pylist() for i in range(3))):
                    for digest, start, end in runs(text or "", min_words):
                        mine = (doc is None, doc or 0, row, start, end)
                        held = memo.get(digest)
                        if held is None:
                            memo[digest] = mine
                        elif held != mine:
                            memo[digest] = min(held, mine)
                            late.append(max(held, mine))
                if late:
                    yield batch([(r[0], None if r[0] else r[1], *r[2:]) for r in late], None)
                if len(memo) >= MEMO:
                    yield from flushed()
        yield from flushed()

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")
    found = rows.mapInArrow(run, ", ".join(f"{n} {'boolean' if n == 'none' else 'long'}" for n in _OUT))
    # Repeats have no digest: they are dealt by their place and rank behind a zero.
    by = Window.partitionBy("hi", "lo", F.when(F.col("hi").isNull(), F.xxhash64("doc_id", "row", "start"))).orderBy("none", "doc_id", "row", "start")
    return found.withColumn("nth", F.rank().over(by)).where("nth > 1 or hi is null").select("doc_id", "row", "start", "end")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch as one."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without the repeated passages, n_removed, removed (code points in the original, start:end, comma-joined).

    Nulls: a null text stays null and has no units; a null doc_id ranks last.
    Rows that repeat with the same doc_id and text are one document, so what one
    keeps the other keeps. Ties: earlier doc_id, then the text's hash, then the
    earlier place; a passage that recurs within a document goes there too. Empty
    table: no rows. Other columns are ignored.
    """
    gone = repeated_runs(docs, min_words).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("gone"))
    gone = gone.withColumnsRenamed({"doc_id": "d", "row": "r"})
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left").select("doc_id", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, told = [], [], []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                spans = merged([(g["start"], g["end"]) for g in gone or ()])
                if spans:
                    edges = [0, *(x for s in spans for x in s), len(text)]
                    text = "".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                texts.append(text)
                counts.append(len(spans))
                told.append(",".join(f"{s}:{e}" for s, e in spans))
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(told, pa.string())], names=["doc_id", "text", "n_removed", "removed"])

    return rows.mapInArrow(run, "doc_id long, text string, n_removed long, removed string")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", "removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


#: Assumes that doc_ids don't repeat, as in the tables.
OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, regexp_extract_all(text, '[^.,;:!?\n]+[.,;:!?\n]*|[.,;:!?\n]+') AS units FROM documents
), p AS (
  SELECT doc_id, unnest(units) AS unit, generate_subscripts(units, 1) AS pos FROM l
), o AS (
  SELECT *, coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    trim(regexp_replace(lower(regexp_replace(unit, '[!-/:-@\[-`{-~]', '', 'g')), '[\x09-\x0D\x20]+', ' ', 'g'), ' ') AS norm FROM p
), n AS (
  SELECT doc_id, start, start + length(unit) AS stop, norm, len(string_split(norm, ' ')) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM o WHERE norm <> ''
), b AS (
  SELECT n.*, coalesce(contains(substr(d.text, CAST(lag(start) OVER (PARTITION BY n.doc_id ORDER BY i) AS BIGINT) + 1, CAST(start - lag(start) OVER (PARTITION BY n.doc_id ORDER BY i) AS BIGINT)), chr(10)), true) AS opens
  FROM n JOIN documents d ON n.doc_id = d.doc_id
), c AS (
  SELECT *, CAST(sum(k) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto, CAST(sum(k) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - k AS before,
    coalesce(lead(opens) OVER (PARTITION BY doc_id ORDER BY i), true) AS closes FROM b
), w AS (
  SELECT a.doc_id, a.i, b.i AS j FROM (SELECT * FROM c WHERE opens) a ASOF JOIN c b ON a.doc_id = b.doc_id AND a.before + 40 <= b.upto
  UNION SELECT a.doc_id, b.i, a.i FROM c a ASOF JOIN c b ON a.doc_id = b.doc_id AND a.upto - 40 >= b.before WHERE a.closes OR a.before - b.before < 40
), t AS (
  SELECT w.doc_id, w.i, w.j, string_agg(c.norm, ' ' ORDER BY c.i) AS run, min(start) AS start, max(stop) AS stop
  FROM w JOIN c ON w.doc_id = c.doc_id AND c.i BETWEEN w.i AND w.j GROUP BY w.doc_id, w.i, w.j
), r AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS nth FROM t
), e AS (
  SELECT DISTINCT doc_id, start, stop FROM r WHERE nth > 1
), f AS (
  SELECT *, coalesce(start > max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM e
), h AS (
  SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, stop) AS island FROM f
), m AS (
  SELECT doc_id, island, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop FROM h GROUP BY doc_id, island
), q AS (
  SELECT m.*, d.text, coalesce(lag(stop) OVER (PARTITION BY m.doc_id ORDER BY start), 0) AS since FROM m JOIN documents d ON m.doc_id = d.doc_id
), k AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY start) AS removed,
    string_agg(substr(text, since + 1, start - since), '' ORDER BY start) || substr(any_value(text), max(stop) + 1) AS kept FROM q GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed,
  CAST(length(coalesce(k.kept, d.text, '')) AS BIGINT) AS kept_chars, md5(coalesce(k.kept, d.text, '')) AS kept_md5
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
