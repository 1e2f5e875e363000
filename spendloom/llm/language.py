"""Language ID by prediction by partial matching: per-language byte context trees with escapes, frozen after training.

A context tree is held as its grams: the strings of 1 to ORDER + 1 bytes that a
language's sample has. The cost of each gram, with the escapes on the way down
to it, is worked out beforehand for the languages of a group; a byte whose gram
no language of the group has costs an escape and is looked up one order lower.
All 256 bytes are symbols, whatever the languages. Costs are whole units of
1/1024 bit, so sums are exact and don't depend on their order or on the groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import encoder
from .common import Tables, slices, small_batches, table

ORDER = 4
#: Training documents of each language: about this many, by the hash of doc_id (the documented bound of the fit).
SAMPLE_DOCS = 1_500
#: Longest grams that the sample may have in all: some 80 bytes each are sent to every worker. More is an error, not cut.
MOST_GRAMS = 20_000_000
#: Languages whose costs are looked up together.
GROUP = 8
UNIT = 1024
UND = "und"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id's text mod 5 (null: of '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


class Index:
    """Row numbers of keys in an open-addressed table: -1 for a key that isn't held."""

    def __init__(self, held: np.ndarray):
        bits = max(4, int(len(held) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, left = self._home(held), np.arange(len(held))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.rows[at[won]] = held[won], won
            left = left[self.keys[at[left]] != held[left]]
            at[left] = at[left] + 1 & self.mask

    def _home(self, wanted: np.ndarray) -> np.ndarray:
        return (wanted.astype(np.uint64) * _SPREAD >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        at = self._home(wanted)
        held = self.keys[at]
        out = np.where(held == wanted, self.rows[at], -1)
        left = np.flatnonzero((held != wanted) & (held >= 0))
        while len(left):
            at[left] = at[left] + 1 & self.mask
            held = self.keys[at[left]]
            hit = held == wanted[left]
            out[left[hit]] = self.rows[at[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


@dataclass(frozen=True)
class Group:
    """For each length of gram, 1 to order + 1: index of the grams, their costs (gram, language), and as contexts of a longer gram their escapes."""

    languages: list[str]
    levels: list[tuple[Index, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Model:
    groups: list[Group]
    order: int

    @property
    def languages(self) -> list[str]:
        return [x for g in self.groups for x in g.languages]


def joined(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each after order spaces, and where the texts' own bytes start and end."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer((b" " * order).join([b"", *raw]), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(sizes + order)
    return data, ends - sizes, ends


def grams_of(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte after the first order ones, it and those before it as one number."""
    n = max(0, len(data) - order)
    key = np.zeros(n, np.int64)
    for i in range(order + 1):
        key = key << 8 | data[i : i + n]
    return key


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): counts of order+1 bytes, the grams as one long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.release()
        for b in batches:
            for rows in slices(b, 1):
                langs, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    data, starts, ends = joined([t for t, x in zip(texts, langs) if x == lang], order)
                    own = np.zeros(len(data), bool)
                    for s, e in zip(starts.tolist(), ends.tolist()):
                        own[s:e] = True
                    grams, n = np.unique(grams_of(data, order)[own[order:]], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held, at = np.unique(keys, return_inverse=True)
    return held, np.bincount(at, weights=n, minlength=len(held)).astype(np.int64)


def _units(bits: np.ndarray) -> np.ndarray:
    return np.rint(bits * UNIT).astype(np.int32)


def _at(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each wanted key in sorted ones (0 where absent), and whether it is there."""
    row = np.minimum(np.searchsorted(held, wanted), max(0, len(held) - 1))
    there = held[row] == wanted if len(held) else np.zeros(len(wanted), bool)
    return np.where(there, row, 0), there


def freeze(grams: list[tuple[str, np.ndarray, np.ndarray]], order: int = ORDER) -> Group:
    """PPM (method C): a byte seen n of N times in a context with d bytes costs -log2 n/(N+d), an escape -log2 d/(N+d), a byte seen nowhere 8 bits more."""
    unions, above = [], np.zeros(0, np.int64)
    for k in range(order + 1, 0, -1):
        # The grams of a length, the contexts of longer ones (spaces before a text are in no gram) and what longer ones end in.
        above = np.unique(np.concatenate([np.concatenate([g & (1 << 8 * k) - 1, g >> 8 & (1 << 8 * k) - 1]) if k <= order else g for _, g, _ in grams] + [above & (1 << 8 * k) - 1]))
        unions.append(above)
    levels, below, costs_below = [], np.zeros(1, np.int64), np.full((1, len(grams)), 8 * UNIT, np.int32)
    for k, union in enumerate(reversed(unions), 1):
        last = (1 << 8 * k) - 1
        own = [_summed(g & last, n) for _, g, n in grams]
        row_below, _ = _at(below, union & (last >> 8))
        costs, escapes = costs_below[row_below].copy(), np.zeros((len(below), len(grams)), np.int32)
        for column, (g, n) in enumerate(own):
            contexts, total = _summed(g >> 8, n)
            kinds = _summed(g >> 8, np.ones(len(g)))[1]
            escape = _units(np.log2(total + kinds) - np.log2(kinds))
            at, there = _at(contexts, union >> 8)
            costs[:, column] += np.where(there, escape[at] if len(escape) else 0, 0)
            row, seen = _at(g, union)
            if len(g):
                costs[:, column] = np.where(seen, _units(np.log2(total + kinds)[at] - np.log2(n)[row]), costs[:, column])
                at, there = _at(contexts, below)
                escapes[:, column] = np.where(there, escape[at], 0)
        if k > 1:
            levels[-1] = (*levels[-1][:2], escapes)
        else:
            root = escapes
        levels.append((Index(union), costs, np.zeros((0, len(grams)), np.int32)))
        below, costs_below = union, costs
    return Group([g[0] for g in grams], [(None, np.full((1, len(grams)), 8 * UNIT, np.int32), root), *levels])


def train(docs: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fits on rows with text and lang: about sample_docs whole texts for each language, chosen by a hash of doc_id, and all their grams."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = {r[0]: sample_docs / r[1] for r in docs.groupBy("lang").count().collect()}
    if not shares:
        return Model([], order)
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(x) for p in shares.items() for x in p]), F.col("lang"))
    tables = Tables(docs.sparkSession)
    seen = tables.keep(counts(docs.where(draw < share), order), "grams")
    if (n := seen.count()) > MOST_GRAMS:
        raise ValueError(f"the sample has {n} grams, over {MOST_GRAMS}: lower sample_docs")
    grams = seen.toArrow()
    tables.drop(seen)
    lang = np.array(grams["lang"].to_pylist(), object)
    gram, n = grams["gram"].to_numpy(), grams["n"].to_numpy()
    each = [(x, gram[lang == x], n[lang == x]) for x in sorted(shares)]
    return Model([freeze(each[i : i + GROUP], order) for i in range(0, len(each), GROUP)], order)


def _costs(key: np.ndarray, group: Group) -> np.ndarray:
    """Cost (byte, language) of each byte from its longest gram down."""
    out = np.zeros((len(key), len(group.languages)), np.int32)
    left = np.arange(len(key))
    for k in range(len(group.levels) - 1, 0, -1):
        index, costs, _ = group.levels[k]
        mine = key[left] & (1 << 8 * k) - 1
        row = index.find(mine)
        hit = row >= 0
        out[left[hit]] += costs[row[hit]]
        left, mine = left[~hit], mine[~hit]
        if not len(left):
            return out
        shorter, _, escapes = group.levels[k - 1]
        row = shorter.find(mine >> 8) if shorter else np.zeros(len(mine), np.int64)
        out[left] += np.where((row >= 0)[:, None], escapes[row], 0)
    out[left] += 8 * UNIT
    return out


def code_lengths(texts: list[str], model: Model) -> np.ndarray:
    """Bits of each text under each language, in units of 1/1024."""
    n = len(model.languages)
    out = np.zeros((len(texts), n), np.int64)
    if not texts or not n:
        return out
    order = model.order
    data, starts, ends = joined(texts, order)
    starts, ends = starts - order, ends - order
    size = max(1 << 12, (1 << 19) // n)
    for at in range(0, len(data) - order, size):
        key = grams_of(data[at : at + size + order], order)
        cost = np.concatenate([_costs(key, g) for g in model.groups], axis=1)
        cost = np.vstack([np.zeros((1, n), np.int64), np.cumsum(cost, axis=0, dtype=np.int64)])
        one, other = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(key), "left")
        lo, hi = (np.clip(x[one:other] - at, 0, len(key)) for x in (starts, ends))
        out[one:other] += cost[hi] - cost[lo]
    return out


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score: the language with the shortest code and its posterior share.

    Only text is read. A null text, or one without a letter, is `und` with score
    0, as is every text if nothing could be learned. Ties go to the first
    language in code-point order. Empty texts are `und`; very long ones are
    scored whole, in blocks. Repeated rows are handled alike. Other columns stay;
    ones named like the results (names) are replaced. Empty table: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # MOST_GRAMS bounds it
    base = docs.drop(*names)
    schema = T.StructType([*base.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    at = base.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.release()
        model = held.value
        for b in batches:
            for rows in slices(b, at):
                texts = rows.column(at).to_pylist()
                fit = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
                bits = code_lengths([texts[i] for i in fit], model)
                found, scores = [UND] * len(texts), [0.0] * len(texts)
                if fit:
                    best = bits.argmin(1)
                    gap = (bits - bits[np.arange(len(fit)), best][:, None]) / UNIT
                    share = 1 / np.exp2(-np.minimum(gap, 1000.0)).sum(1)
                    for i, k, s in zip(fit, best.tolist(), share.tolist()):
                        found[i], scores[i] = model.languages[k], s
                yield pa.record_batch([*rows.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*rows.schema.names, *names])

    return base.mapInArrow(run, schema)


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(remainder() != 0))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (remainder() == 0).alias("held_out"), "lang_pred", "score")
