"""MinHash near-dedup: banded candidates, odd sketches to rule most of them out, full sets to confirm.

Documents with equal shingle sets form a class and one of them stands for it.
Bands of MinHash samples put representatives in buckets. Links are looked for
bucket by bucket from a pivot, the member that shares most buckets: all others
that aren't yet in the pivot's component are compared with it. A bucket whose
members are all in one component needs no more comparisons, so a group of n
copies costs about n comparisons and no link between components is lost. What a
few rounds leave open is compared bucket by bucket, in blocks. Rows of one class,
bucket, pivot or component are dealt over parts, so no task gets a group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoder
from .common import Tables, attach, free_name, slices, small_batches, table, with_groups

WORDS = 5
#: A link: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
#: Samples of a band, and the most that bands may miss of the pairs at the threshold.
ROWS, MISS = 4, 2.1e-8
#: Samples that sketches fold; the first ROWS of each band make the bands.
SAMPLES = 192
SKETCH_BITS = 2048
#: Pivot rounds before the rest is compared in blocks; the members of a block and the bytes of their sets.
ROUNDS, MEMBERS, SET_BYTES = 4, 512, 8 << 20

_U = np.uint64
_rng = np.random.default_rng(20240601)
_random = lambda n: _rng.integers(0, 1 << 64, n, dtype=_U)
_BYTE, _PLACE, _A, _B = _random(256), _random(WORDS) | _U(1), _random(SAMPLES) | _U(1), _random(SAMPLES)
_R = _U(0x9E3779B97F4A7C15)
_R_INVERSE = _U(pow(int(_R), -1, 1 << 64))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_SEGMENT = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << max(0, n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _R), np.full(size, _R_INVERSE)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in lower-cased bytes. A hash is a sum over the bytes, by place in the word."""
    raw = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], _SEPARATOR[raw], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    up, down = _power(len(raw) + 1)
    total = np.concatenate([[_U(0)], np.cumsum(_BYTE[raw] * up[: len(raw)])])
    return starts, _mix((total[ends] - total[starts]) * down[starts])


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """As _words, in segments cut at separators, so memory follows a segment or the one longest word."""
    if len(data) <= 2 * _SEGMENT:
        return _words(data)
    at, starts, hashes = 0, [], []
    raw = np.frombuffer(data, np.uint8)
    while at < len(data):
        end = at + _SEGMENT
        while end < len(data) and not _SEPARATOR[raw[end]]:
            end += 1
        s, h = _words(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's 5-word shingles; fewer words are one shingle, none give the empty set."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower knows A-Z alone
    starts, words = words_of(b"\n".join(raw))
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    cut = np.searchsorted(starts, bounds)
    whole = np.zeros(max(0, len(words) - WORDS + 1), _U)
    for j in range(WORDS):
        whole += words[j : j + len(whole)] * _PLACE[j]
    whole = _mix(whole)
    out = []
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if hi - lo >= WORDS:
            out.append(np.unique(whole[lo : hi - WORDS + 1]))
        else:
            n = hi - lo
            out.append(_mix((words[lo:hi] * _PLACE[:n]).sum(keepdims=True, dtype=_U) + _U(n)) if n else np.zeros(0, _U))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, ~_U(0))
    for at in range(0, len(shingles), 1 << 10):  # 1.5 MB at a time
        least = np.minimum(least, ((shingles[at : at + (1 << 10), None] ^ _B) * _A).min(0))
    return least


def band_count(threshold: int) -> int:
    """The fewest bands that miss a pair at the threshold with probability MISS at most: 24 at 85, 34 at 80."""
    least = math.ceil(math.log(MISS) / math.log1p(-min(threshold / 100, 0.999) ** ROWS))
    if least * ROWS > SAMPLES:
        raise ValueError(f"a threshold of {threshold} needs {least} bands of {ROWS} samples, more than {SAMPLES} samples")
    return least


def bands(samples: np.ndarray, count: int) -> np.ndarray:
    by_band = _mix(samples[: count * ROWS].reshape(count, ROWS) + np.arange(ROWS, dtype=_U) * _R)
    return _mix(by_band.sum(1, dtype=_U) + np.arange(count, dtype=_U) * _R).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: each (number, sample) flips the bit it hashes to."""
    at = (_mix(samples + np.arange(1, SAMPLES + 1, dtype=_U) * _R) % _U(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH_BITS) & 1 > 0, bitorder="little").view(np.int64)


def estimate(differing: float) -> float:
    """Similarity from the number of differing sketch bits."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * math.log(max(1e-9, 1 - 2 * differing / SKETCH_BITS))


def floor(threshold: int) -> float:
    """Estimates below this are six standard deviations under the threshold (in thousandths: 0.695 at 85, 0.626 at 80)."""
    t = threshold / 100
    return math.floor(1000 * (t - 6 * math.sqrt(t * (1 - t) / SAMPLES))) / 1000


def most_differing(threshold: int) -> int:
    """Most differing bits of a candidate: the inverse of estimate at the floor."""
    return int(SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - floor(threshold)) / SKETCH_BITS)))


def signatures(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, row, n, hi, lo, bands, sketch). row: the text's hash. hi and lo: the 128-bit digest of the set; null for the empty set."""
    small_batches(docs.sparkSession)
    count = band_count(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.release()
        for b in batches:
            for rows in slices(b, 1):
                sets = shingle_sets(rows.column(1).to_pylist())
                hi, lo, keys, sketches = [], [], [], []
                for s in sets:
                    if not len(s):
                        for c in (hi, lo, keys, sketches):
                            c.append(None)
                        continue
                    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    m = minhash(s)
                    hi.append(int.from_bytes(d[:8], "little", signed=True))
                    lo.append(int.from_bytes(d[8:], "little", signed=True))
                    keys.append(bands(m, count))
                    sketches.append(odd_sketch(m))
                longs = pa.list_(pa.int64())
                yield pa.record_batch([rows.column(0), rows.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, longs), pa.array(sketches, longs)], names=["doc_id", "row", "n", "hi", "lo", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("row")).mapInArrow(run, "doc_id long, row long, n long, hi long, lo long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(doc, shingles): sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.release()
        for b in batches:
            for rows in slices(b, 1):
                yield pa.record_batch([rows.column(0), pa.array([s.tobytes() for s in shingle_sets(rows.column(1).to_pylist())], pa.binary())], names=["doc", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc long, shingles binary")


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= threshold * (len(a) + len(b) - common)


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (doc, pivot) whose full sets are similar enough."""
    both = attach(pairs, ["pivot"], sets.withColumnsRenamed({"doc": "pivot", "shingles": "sb"}), ["doc"])
    both = both.join(sets.withColumnRenamed("shingles", "sa"), "doc").select("doc", "pivot", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U), threshold) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["doc", "pivot"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "doc long, pivot long")


def sketch_filter(pairs: DataFrame, sketches: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (doc, pivot) whose sketches differ in few enough bits."""
    both = attach(pairs, ["pivot"], sketches.withColumnsRenamed({"doc": "pivot", "sketch": "xb"}), ["doc"])
    both = both.join(sketches.withColumnRenamed("sketch", "xa"), "doc")
    differing = F.aggregate(F.zip_with("xa", "xb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return both.where(differing <= most_differing(threshold)).select("doc", "pivot")


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) of each node that isn't its component's smallest: alternating large and small stars on written tables."""
    e = tables.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = with_groups(e.union(e.select("v", "u")), ["u"], {"m": (F.min, "v")}, ["v"]).withColumn("m", F.least("m", "u"))
        large = tables.keep(both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        small = with_groups(large, ["u"], {"m": (F.min, "v")}, ["v"])
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        old, e = e, tables.keep(small, "stars")
        tables.drop(old, large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def relabel(labels: DataFrame, links: DataFrame, tables: Tables) -> DataFrame:
    """labels (doc, comp) after joining the components that links (doc, pivot) of documents join."""
    at = attach(links, ["pivot"], labels.withColumnsRenamed({"doc": "pivot", "comp": "b"}), ["doc"])
    at = at.join(labels.withColumnRenamed("comp", "a"), "doc")
    roots = components(at.select("a", "b"), tables)
    out = attach(labels, ["comp"], roots.withColumnRenamed("node", "comp"), ["doc"], "left")
    return tables.keep(out.select("doc", F.coalesce("root", "comp").alias("comp")), "labels")


def _forest(table: pa.Table, threshold: int) -> pa.Table:
    """Links between the components in a block, or between two blocks, that join what wasn't joined: a spanning forest.

    Pairs are taken from the likest sketches down; a pair whose components are
    joined already needs no check of its sets.
    """
    doc, comp = table["doc"].to_numpy(), table["comp"].to_numpy()
    bits = np.array(table["sketch"].to_pylist(), np.int64).view(_U)
    sets = [np.frombuffer(x.as_py(), _U) for x in table["shingles"]]
    second = table["second"].to_numpy(zero_copy_only=False)
    left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if second.any() else (np.arange(len(doc)),) * 2
    found, most = [], most_differing(threshold)
    for i in left.tolist():
        differing = np.bitwise_count(bits[right] ^ bits[i]).sum(1, dtype=np.int64)
        near = np.flatnonzero((differing <= most) & (comp[right] != comp[i]))
        found.append(np.stack([differing[near], np.full(len(near), i), right[near]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    pairs = pairs[:, np.lexsort(pairs[::-1])]
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out: list[list] = [[], []]
    for _, i, j in pairs.T.tolist():
        p, q = find(int(comp[i])), find(int(comp[j]))
        if p != q and linked(sets[i], sets[j], threshold):
            root[p] = q
            out[0].append(max(doc[i], doc[j]))
            out[1].append(min(doc[i], doc[j]))
    return pa.table({"doc": pa.array(out[0], pa.int64()), "pivot": pa.array(out[1], pa.int64())})


def _in_blocks(members: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (doc, pivot) between components of the members (key, doc, comp): each bucket, block against block.

    A large bucket is cut by a hash in blocks of bounded rows and bytes, and two
    blocks at a time meet in one task, so no task holds a bucket; and chains of
    buckets that share members don't add up.
    """
    sized = members.join(sets.select("doc", F.length("shingles").alias("bytes")), "doc")
    sizes = sized.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("bytes") / SET_BYTES)).cast("long").alias("blocks"))
    m = attach(members, ["key"], sizes, ["doc"]).withColumn("i", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    m = m.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    m = m.select("key", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") > F.col("j")).alias("second"), "doc", "comp")
    m = m.join(sketches, "doc").join(sets, "doc")

    def run(t: pa.Table) -> pa.Table:
        return _forest(t, threshold)

    return m.groupBy("key", "x", "y").applyInArrow(run, "doc long, pivot long").distinct()


def link_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and row (the text's hash): one row for each row of docs.

    A null or wordless text has the empty set and is linked with nothing. Rows
    with equal sets are linked. Rows that share a doc_id but not a text count
    each for itself. A null doc_id represents nothing: its row takes its class's
    component and is kept only where the class has no id. Ties don't arise: the
    smallest id stands for a component. Very long texts are read in segments.
    Empty table: no rows. Other columns are ignored.
    """
    tables = Tables(docs.sparkSession)
    sig = tables.keep(signatures(docs, threshold), "signatures")
    classes = tables.keep(sig.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "classes")
    first = classes.withColumnsRenamed({"hi": "h", "lo": "l"})
    reps = sig.join(first, (F.col("doc_id") == F.col("rep")) & (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")))
    reps = tables.keep(reps.select(F.col("doc_id").alias("doc"), "bands", "sketch").dropDuplicates(["doc", "bands"]), "representatives")
    entries = reps.select("doc", F.explode("bands").alias("key")).distinct()
    members = with_groups(entries, ["key"], {"x": (F.min, "doc"), "y": (F.max, "doc")}, ["doc"]).where("x < y").select("key", "doc")
    members = tables.keep(members, "members")
    inside = tables.keep(members.groupBy("doc").agg(F.count("*").alias("degree")), "inside")
    labels = inside.select("doc", F.col("doc").alias("comp"))
    if not inside.isEmpty():
        sketches = tables.keep(reps.join(inside.select("doc"), "doc", "left_semi").select("doc", "sketch"), "sketches")
        wanted = docs.select(F.col("doc_id").cast("long"), "text").join(inside.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
        sets = tables.keep(full_sets(wanted), "sets")
        members = members.join(inside, "doc")
        best = F.struct("degree", (-F.col("doc")).alias("least"), "comp")
        rest = None
        for turn in range(ROUNDS + 1):
            at = members.join(labels, "doc").withColumn("mine", best)
            at = with_groups(at, ["key"], {"x": (F.min, "comp"), "y": (F.max, "comp"), "best": (F.max, "mine")}, ["doc"]).where("x < y")
            old, rest = rest, tables.keep(at.select("key", "doc", "degree", "comp", (-F.col("best.least")).alias("pivot"), F.col("best.comp").alias("pivot_comp")), "open")
            if old is not None:
                tables.drop(old)
            if rest.isEmpty():
                break
            if turn < ROUNDS:
                pairs = rest.where("doc <> pivot and comp <> pivot_comp").select("doc", "pivot").distinct()
                pairs = tables.keep(pairs, "pairs")
                likely = tables.keep(sketch_filter(pairs, sketches, threshold), "likely")
                tables.drop(pairs)
                links = confirm(likely, sets, threshold)
                members = rest.where("doc <> pivot").select("key", "doc", "degree")
            else:
                links = _in_blocks(rest.select("key", "doc", "comp"), sketches, sets, threshold)
            links = tables.keep(links, "links")
            if turn < ROUNDS:
                tables.drop(likely)
            if not links.isEmpty():
                labels = relabel(labels, links, tables)
            tables.drop(links)
    named = classes.join(labels.withColumnRenamed("doc", "rep"), "rep", "left").select("hi", "lo", F.coalesce("comp", "rep").alias("comp"))
    named = tables.keep(named, "components")
    out = attach(sig.select("doc_id", "row", "n", "hi", "lo"), ["hi", "lo"], named, ["doc_id", "row"], "left")
    tables.drop_but(sig, named)
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "row")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with their columns; rows that repeat with the same doc_id and text fall to one."""
    hash_, d, r = free_name(docs, "row"), free_name(docs, "_d"), free_name(docs, "_r")
    kept = link_components(docs, threshold).where("kept").select(F.col("doc_id").alias(d), F.col("row").alias(r)).distinct()
    rows = docs.withColumn(hash_, F.xxhash64("text"))
    rows = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(hash_) == F.col(r)), "left_semi")
    return rows.dropDuplicates(["doc_id", hash_]).select(*docs.columns)


def op8_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents")).drop("row")
