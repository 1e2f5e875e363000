"""Toxicity by noisy-channel deobfuscation: character lattices, Viterbi decoding under a character model, then scoring.

Writers hide words behind look-alike signs (1d10t), spacing (i d i o t) and
repetition (idiooot). A unit of text with such marks becomes a lattice: a row of
places with alternatives, each with the channel's cost. The cheapest path under
the costs and a character model of order 3, counted over all documents, is the
restored unit. A unit without marks has one path and is left as it is. The
restored text is scored by its words: weights of words and of their beginnings,
learnt from labelled documents, and a logistic model of a text's strongest ones.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, slices, small_batches, table

#: Labelled documents of each class that the fit takes, about, by a hash of doc_id (the documented bound of the fit).
FIT_DOCS = 6_000
THRESHOLD = 0.7
#: Costs of the channel in nats: a look-alike read as its letter, a wildcard read as a letter, a repeated letter dropped, a gap between spaced letters dropped.
LOOK, WILD, DROP, GAP = 1.0, 2.0, 0.5, 0.5
#: Signs and the letters that they stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s"}
#: These stand for a letter only with letters on both sides; * is any vowel.
INSIDE = set("!|+*")
VOWELS = "aeiou"
GAPS = " .-_*"
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
#: Symbols of the character model: 0 all that isn't a letter or digit, 1-26 letters without accents, 27 other letters, 28 digits.
SYMBOLS, ORDER = 32, 3
OTHER, DIGIT = 27, 28
#: Weight of the shorter context in the model.
SHORTER = 4.0
#: Lengths of word beginnings that have weights of their own, and standard errors taken off a weight.
BEGINNINGS, ERRORS = (4, 5, 6), 1.0
#: Strong words of a text that the logistic model sees one by one.
TOP = 3
#: Words and units that a worker remembers at most; the memo is emptied then and results stay the same.
MEMO = 200_000
WORDS = re.compile(r"[^\W\d_]+")


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id's text mod 3 (null: of '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its symbol, and its kind: 1 letter, 2 look-alike, 3 look-alike inside words only, 4 white space, 0 the rest."""
    symbol, kind = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            kind[i] = 1
            base = unicodedata.normalize("NFKD", c.lower())[0] if i < 0x3000 else c
            symbol[i] = ord(base) - 96 if "a" <= base <= "z" else OTHER
        elif c.isdigit():
            symbol[i] = DIGIT
        elif c.isspace():
            kind[i] = 4
    for c in LOOKALIKES:
        kind[ord(c)] = 3 if c in INSIDE else 2
    kind[ord("*")] = 3
    return symbol, kind


def plain(text: str) -> str:
    """Lower case, without invisible signs."""
    return text.translate(INVISIBLE).lower() if not text.isascii() else text.lower()


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def contexts(symbols: np.ndarray) -> np.ndarray:
    """For each symbol, it and the three before it as one number; a context ends at the last sign that isn't a letter or digit."""
    s = symbols.astype(np.int32)
    one = np.concatenate([[0], s[:-1]])
    two = np.where(one == 0, 0, np.concatenate([[0, 0], s[:-2]])[: len(s)])
    three = np.where(two == 0, 0, np.concatenate([[0, 0, 0], s[:-3]])[: len(s)])
    return ((three * SYMBOLS + two) * SYMBOLS + one) * SYMBOLS + s


def character_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over the whole texts of all documents: at most SYMBOLS ** (ORDER + 1) rows, summed in each task before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SYMBOLS ** (ORDER + 1), np.int64)
        symbol, _ = _tables()
        for b in batches:
            for rows in slices(b, 0):
                text = plain("\n".join(t for t in rows.column(0).to_pylist() if t))
                if text:
                    held += np.bincount(contexts(symbol[points(text)]), minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def costs(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """-log of each symbol's share after its context: counts blended with those of the next shorter context, down to equal shares."""
    count = np.zeros(SYMBOLS ** (ORDER + 1))
    count[gram] = n
    share = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(ORDER + 1):
        own = count.reshape(-1, SYMBOLS ** (order + 1)).sum(0).reshape(-1, SYMBOLS)
        share = (own + SHORTER * np.tile(share.reshape(-1, SYMBOLS), (len(own) // len(share.reshape(-1, SYMBOLS)), 1))) / (own.sum(1, keepdims=True) + SHORTER)
    return -np.log(share).ravel().astype(np.float32)


#: A unit of spaced letters: single letters or look-alikes with one and the same gap between them.
SPACED = re.compile(rf"(?:[^\W_]|[{re.escape(''.join(LOOKALIKES))}])(?:([{re.escape(GAPS)}])(?=\S)[^\s{re.escape(GAPS)}])(?:\1[^\s{re.escape(GAPS)}])+(?![^\W_])")


def units(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, spaced) of the parts of a plain text that a writer may have disguised, in order, not overlapping.

    Words (between white space) with a look-alike beside a letter, or a letter
    three times running; runs of three or more single letters with one kind of
    gap.
    """
    _, kinds = _tables()
    p = points(text)
    if len(p) < 3:
        return []
    kind = kinds[p]
    letter, look, inside = kind == 1, kind == 2, kind == 3
    letter |= look & (p > 0x3FF)  # look-alikes from other alphabets are letters, too
    before, after = np.concatenate([[False], letter[:-1]]), np.concatenate([letter[1:], [False]])
    mark = look & (before | after) | inside & before & after
    same = letter & np.concatenate([[False], p[1:] == p[:-1]])
    mark[2:] |= same[2:] & same[1:-1]
    single = (letter | look) & ~before & ~after
    spaced = np.zeros(len(p), bool)
    if len(p) >= 5:
        gap = np.isin(p[1:-3], [ord(c) for c in GAPS])
        spaced[:-4] = single[:-4] & gap & single[2:-2] & (p[3:-1] == p[1:-3]) & single[4:]
    if not mark.any() and not spaced.any():
        return []
    white = np.concatenate([[-1], np.flatnonzero(kind == 4), [len(p)]])
    at = np.unique(np.searchsorted(white, np.flatnonzero(mark)))
    found = [(int(white[i - 1]) + 1, int(white[i]), False) for i in at]
    over = -1
    for i in np.flatnonzero(spaced).tolist():
        # Figures alone are no word: some of the signs must be letters.
        if i >= over and (m := SPACED.match(text, i)) and 5 * int(letter[i : m.end()].sum()) > m.end() - i:
            found.append((i, m.end(), True))
            over = m.end()
    out: list[tuple[int, int, bool]] = []
    for lo, hi, how in sorted(found, key=lambda u: (u[0], -u[1])):
        if not out or lo >= out[-1][1]:
            out.append((lo, hi, how))
        elif hi > out[-1][1]:
            out[-1] = (out[-1][0], hi, out[-1][2] or how)
    return out


def lattice(unit: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """Places of a unit with their alternatives (what was meant, the channel's cost)."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(unit):
        c, j = unit[i], i + 1
        while j < len(unit) and unit[j] == c:
            j += 1
        n, run = j - i, unit[i:j]
        within = 0 < i and j < len(unit)
        letters = [c] if c.isalpha() and c not in LOOKALIKES else []
        looks = list(LOOKALIKES.get(c, "")) if c not in INSIDE or within else []
        if spaced and n == 1 and c in GAPS and within:
            out.append([(c, 0.0), ("", GAP)])
        elif c == "*" and n == 1 and within:
            out.append([(c, 0.0)] + [(v, WILD) for v in VOWELS])
        elif letters and n < 3:
            out += [[(c, 0.0)]] * n
        elif letters or looks:
            meant = [(run, 0.0)] + [(x * n, LOOK * n) for x in looks]
            meant += [(x * k, (LOOK if looks else 0.0) + DROP) for x in letters + looks for k in (1, 2) if k < n]
            out.append(meant)
        else:
            out.append([(run, 0.0)])
        i = j
    return out


def decode(unit: str, spaced: bool, cost: np.ndarray) -> str:
    """The cheapest reading of a unit. Ties go to the alternative named first."""
    symbol, _ = _tables()
    mask = SYMBOLS**ORDER - 1
    states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for place in [*lattice(unit, spaced), [(" ", 0.0)]]:
        after: dict[int, tuple[float, tuple]] = {}
        for context, (paid, path) in states.items():
            for meant, channel in place:
                at, total = context, paid + channel
                for c in meant:
                    s = int(symbol[ord(c)])
                    total += float(cost[at * SYMBOLS + s])
                    at = (at * SYMBOLS + s) & mask if s else 0
                if at not in after or total < after[at][0]:
                    after[at] = (total, (path, meant))
        states = after
    _, path = min(states.values(), key=lambda s: s[0])
    parts: list[str] = []
    path = path[0]  # without the sign that ends the unit
    while path:
        path, meant = path
        parts.append(meant)
    return "".join(reversed(parts))


class Reader:
    """Restores texts; remembers what units were read as."""

    def __init__(self, cost: np.ndarray):
        self.cost, self.memo = cost, {}

    def restore(self, text: str | None) -> str:
        text = plain(text or "")
        at, parts = 0, []
        for lo, hi, spaced in units(text):
            key = (text[lo:hi], spaced)
            if (read := self.memo.get(key)) is None:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                read = self.memo[key] = decode(*key, self.cost)
            parts += [text[at:lo], read]
            at = hi
        return "".join([*parts, text[at:]])


def features(word: str) -> list[str]:
    """A word of three letters or more, and its beginnings (with *), if longer."""
    return [word, *[word[:k] + "*" for k in BEGINNINGS if len(word) >= k]] if len(word) >= 3 else []


@dataclass(frozen=True)
class Model:
    """Character costs, weights of features, and the logistic model of what a text has of them. Without both classes: no weights, share alone."""

    cost: np.ndarray
    weights: dict[str, float]
    centre: np.ndarray
    spread: np.ndarray
    slopes: np.ndarray
    share: float


def weight(toxic: Column, clean: Column, all_toxic: float, all_clean: float) -> Column:
    """Log of how much more often toxic texts have a feature, less its standard error; below zero: zero."""
    odds = F.log((toxic + 0.5) / (all_toxic + 1)) - F.log((clean + 0.5) / (all_clean + 1))
    return F.greatest(F.lit(0.0), odds - ERRORS * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)))


class Scales:
    """What a text has: its TOP strongest words' weights, the sum of weights over all its words and that for each word, as logs."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.memo = weights, {}

    def of(self, restored: str) -> list[float]:
        memo, get = self.memo, self.weights.get
        held, total, words = [0.0] * TOP, 0.0, 0
        for w, n in Counter(WORDS.findall(restored)).items():
            words += n
            if (x := memo.get(w)) is None:
                if len(memo) >= MEMO:
                    memo.clear()
                x = memo[w] = max((get(f, 0.0) for f in features(w)), default=0.0)
            if x:
                held.append(x)
                total += x * n
        return [*sorted(held, reverse=True)[:TOP], math.log1p(total), math.log1p(1000 * total / (words + 20))]


N = TOP + 2


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, spread and slopes (the last is the constant) by Newton's steps."""
    centre, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / spread, np.ones(len(x))])
    slopes, held = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ slopes, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + held, z.T @ (y - p) - held @ slopes)
        slopes += step
        if np.abs(step).max() < 1e-9:
            break
    return centre, spread, slopes


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Character counts over all documents; weights and slopes from labelled rows, about fit_docs of each class, whole texts.

    labels: doc_id, toxic; rows with a null are left out and a document with
    several is toxic if one says so. Weights come from all rows of the sample,
    slopes from texts scaled by the weights of the other half.
    """
    spark = docs.sparkSession
    small_batches(spark)
    grams = character_counts(docs).toArrow()  # SYMBOLS ** 4 rows at most
    cost = costs(grams["gram"].to_numpy(), grams["n"].to_numpy())
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy(F.col("toxic") > 0).count().collect()}
    none = Model(cost, {}, np.zeros(N), np.ones(N), np.zeros(N + 1), sizes.get(True, 0) / max(1, sum(sizes.values())))
    if len(sizes) < 2:
        return none
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < F.when(F.col("toxic") > 0, fit_docs / sizes[True]).otherwise(fit_docs / sizes[False]))
    chosen = chosen.select("doc_id", (F.col("toxic") > 0).alias("toxic"), F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half"))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "half", "text")  # about 2 * fit_docs ids are sent
    held = spark.sparkContext.broadcast(cost)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value)
        for b in batches:
            for rows in slices(b, 3):
                yield pa.record_batch([*rows.columns[:3], pa.array([reader.restore(t) for t in rows.column(3).to_pylist()], pa.string())], names=rows.schema.names)

    tables = Tables(spark)
    sample = tables.keep(sample.mapInArrow(restored, sample.schema), "toxicity-fit")
    n = {(r[0], r[1]): r[2] for r in sample.groupBy("half", "toxic").count().collect()}
    if len(n) < 4:  # a half without a class
        tables.drop(sample)
        return none

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in slices(b, 3):
                own: dict[tuple[int, bool], Counter] = {}
                for half, toxic, text in zip(*(rows.column(c).to_pylist() for c in (2, 1, 3))):
                    own.setdefault((half, toxic), Counter()).update({f for w in set(WORDS.findall(text)) for f in features(w)})
                for (half, toxic), found in own.items():
                    yield pa.record_batch([pa.array([2 * half + toxic] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["which", "feature", "n"])

    count = lambda *which: F.sum(F.when(F.col("which").isin(*which), F.col("n")).otherwise(0))
    seen = sample.mapInArrow(counted, "which int, feature string, n long").groupBy("feature").agg(*[count(i).alias(f"n{i}") for i in range(4)])
    number = lambda i: float(n[i // 2, bool(i % 2)])
    seen = seen.select(
        "feature",
        weight(F.col("n1"), F.col("n0"), number(1), number(0)).alias("w0"),
        weight(F.col("n3"), F.col("n2"), number(3), number(2)).alias("w1"),
        weight(F.col("n1") + F.col("n3"), F.col("n0") + F.col("n2"), number(1) + number(3), number(0) + number(2)).alias("w"),
    ).where("w0 > 0 OR w1 > 0 OR w > 0").toArrow()  # fmt: skip  # features of the bounded sample that lean towards toxic texts
    names = seen["feature"].to_pylist()
    lexicon = [{f: x for f, x in zip(names, seen[c].to_pylist()) if x > 0} for c in ("w0", "w1", "w")]
    given = spark.sparkContext.broadcast(lexicon)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scales = [Scales(given.value[1]), Scales(given.value[0])]  # each half by the weights of the other
        for b in batches:
            for rows in slices(b, 3):
                x = [scales[h].of(t) for h, t in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist())]
                yield pa.record_batch([rows.column(0), rows.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    found = sample.mapInArrow(scaled, "doc_id long, toxic boolean, x array<double>").orderBy("doc_id", "toxic", "x").select("toxic", "x").toArrow()  # N numbers for each row of the sample
    tables.drop(sample)
    given.unpersist()
    return Model(cost, lexicon[2], *logistic(np.array(found["x"].to_pylist()), np.array(found["toxic"].to_pylist(), float)), none.share)


def predict(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; only text is read.

    A null text counts as empty, and an empty one has a score as well: that of a
    text with no toxic word. Very long texts are read whole. Repeated rows are
    handled alike. Other columns stay; one with the score's name is replaced. If
    nothing could be learnt (a class is missing), every score is the labelled
    share of toxic documents, 0 without labels. Empty table: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.drop(name)
    held, at = spark.sparkContext.broadcast(model), base.columns.index("text")  # 4 MB of costs and the weights of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        reader, scales = Reader(m.cost), Scales(m.weights)
        for b in batches:
            for rows in slices(b, at):
                if m.weights:
                    x = np.array([scales.of(reader.restore(t)) for t in rows.column(at).to_pylist()])
                    z = np.column_stack([(x - m.centre) / m.spread, np.ones(len(x))]) @ m.slopes
                    score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                else:
                    score = np.full(rows.num_rows, m.share)
                yield pa.record_batch([*rows.columns, pa.array(score)], names=[*rows.schema.names, name])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(name, T.DoubleType())]))


def op12_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = predict(docs, fit(docs, labels.where(remainder() != 1)))
    return scored.select("doc_id", (remainder() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
