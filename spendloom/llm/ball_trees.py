"""Hard negatives by branch and bound over ball trees.

Each block of rows has a tree of balls, built once and stored. For a block of
queries the inner product with every row of a ball lies between dot(q, centre)
-/+ |q| * radius; a ball is left out for a query if those bounds miss the
query's window of scores, lie beneath its k-th best score so far, or tie with it
while all ids of the ball are larger, or if the ball has no row with a fitting
label. Leaves are scored exactly, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, small_batches, table
from .part_codes import integers

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 5, 80, 100, 256
EVERY, SHIFTED, LABELS = 100, 7, 10
#: Rows of a leaf at most; of a tree at least and at most; of the trees that a task holds at once; queries of a block, and query blocks of a cell.
LEAF, LEAST, MOST, HELD, QUERIES, SLOT = 128, 2_048, 65_536, 262_144, 256, 64
#: Inner products stay below this, where float64 holds whole numbers exactly.
EXACT = 1 << 52
NONE, LAST = -(1 << 62), (1 << 63) - 1


@dataclass(frozen=True)
class Tree:
    """Rows in leaf order, and for each node (children of i: 2i+1, 2i+2) its rows, ball, smallest id and range of labels."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    least_id: np.ndarray
    label_lo: np.ndarray
    label_hi: np.ndarray

    @property
    def first_leaf(self) -> int:
        return len(self.lo) // 2


def grown(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, leaf: int = LEAF) -> Tree:
    """Halves rows at the median along the line through two far ones, down to leaves of at most leaf rows, which are in order of id."""
    n, depth = len(ids), 0
    while n > leaf << depth:
        depth += 1
    nodes = (2 << depth) - 1
    lo, hi = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    centre, radius = np.zeros((nodes, q.shape[1])), np.zeros(nodes)
    least_id, label_lo, label_hi = (np.zeros(nodes, np.int64) for _ in range(3))
    order, hi[0] = np.arange(n), n
    x = q.astype(np.float64)
    for i in range(nodes):
        mine = order[lo[i] : hi[i]]
        if len(mine):
            own = x[mine]
            centre[i] = own.mean(0)
            far = ((own - centre[i]) ** 2).sum(1)
            radius[i] = np.sqrt(far.max())
            least_id[i], label_lo[i], label_hi[i] = ids[mine].min(), labels[mine].min(), labels[mine].max()
        if i >= nodes // 2:
            order[lo[i] : hi[i]] = mine[np.lexsort((labels[mine], ids[mine]))]
            continue
        middle = (lo[i] + hi[i]) // 2
        if len(mine) > 1:
            one = own[far.argmax()]
            other = own[((own - one) ** 2).sum(1).argmax()]
            order[lo[i] : hi[i]] = mine[np.argpartition(own @ (other - one), middle - lo[i])]
        lo[2 * i + 1], hi[2 * i + 1], lo[2 * i + 2], hi[2 * i + 2] = lo[i], middle, middle, hi[i]
    return Tree(ids[order], labels[order], q[order], lo, hi, centre, radius, least_id, label_lo, label_hi)


@dataclass(frozen=True)
class Wanted:
    """Queries: each takes the k best rows of its label (same) or of others whose scores are within [low, high], but none with the id own."""

    q: np.ndarray
    label: np.ndarray
    own: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int


class Search:
    """Branch and bound of a block of queries over trees, one after another; best holds each query's k best (score, id)."""

    def __init__(self, wanted: Wanted):
        self.w = wanted
        self.x = wanted.q.astype(np.float64)
        self.norm = np.sqrt((self.x**2).sum(1))
        self.score = np.full((len(self.x), wanted.k), NONE, np.int64)
        self.id = np.full((len(self.x), wanted.k), LAST, np.int64)
        self.leaves = 0

    def over(self, tree: Tree) -> None:
        if not len(tree.ids) or not len(self.x):
            return
        dot, reach = tree.centre @ self.x.T, tree.radius[:, None] * self.norm[None, :]
        slack = 1e-6 + 1e-9 * (np.abs(dot) + reach)
        self.up, self.down = np.floor(dot + reach + slack).astype(np.int64), np.ceil(dot - reach - slack).astype(np.int64)
        todo = [(0, np.arange(len(self.x)))]
        while todo:
            node, some = todo.pop()
            some = some[self.open(tree, node, some)]
            if not len(some):
                continue
            if node >= tree.first_leaf:
                self.leaf(tree, node, some)
            else:  # the more promising child is looked at first
                one, other = 2 * node + 1, 2 * node + 2
                if self.up[one, some].sum() > self.up[other, some].sum():
                    one, other = other, one
                todo += [(one, some), (other, some)]

    def open(self, tree: Tree, node: int, some: np.ndarray) -> np.ndarray:
        """Which queries may still find a row in a ball."""
        w, up = self.w, self.up[node, some]
        if tree.lo[node] == tree.hi[node]:
            return np.zeros(len(some), bool)
        kth, last = self.score[some, -1], self.id[some, -1]
        found = (up >= w.low[some]) & (self.down[node, some] <= w.high[some]) & ((up > kth) | (up == kth) & (tree.least_id[node] < last))
        lo, hi = tree.label_lo[node], tree.label_hi[node]
        return found & ((lo <= w.label[some]) & (w.label[some] <= hi) if w.same else (lo != w.label[some]) | (hi != w.label[some]))

    def leaf(self, tree: Tree, node: int, some: np.ndarray) -> None:
        w, (lo, hi) = self.w, (tree.lo[node], tree.hi[node])
        ids, labels = tree.ids[lo:hi], tree.labels[lo:hi]
        score = (self.x[some] @ tree.q[lo:hi].astype(np.float64).T).astype(np.int64)
        self.leaves += len(some)
        fits = (score >= w.low[some, None]) & (score <= w.high[some, None]) & ((labels == w.label[some, None]) == w.same)
        if w.same:
            fits &= ids != w.own[some, None]
        score[~fits] = NONE
        kth, last = self.score[some, -1], self.id[some, -1]
        top = score.max(1)
        better = (top > kth) | (top == kth) & (top > NONE) & (ids[0] < last)
        some, score = some[better], score[better]
        if not len(some):
            return
        # The rows of a leaf are in order of id: the k best are the greatest of score * n and place from the end.
        n, k = len(ids), min(self.w.k, len(ids))
        place = np.argsort(-score, axis=1, kind="stable")[:, :k]
        mine = np.take_along_axis(score, place, 1)
        theirs = np.where(mine > NONE, ids[place], LAST)
        score, id_ = np.concatenate([self.score[some], mine], 1), np.concatenate([self.id[some], theirs], 1)
        best = np.lexsort((id_, -score), axis=1)[:, : self.w.k]
        self.score[some], self.id[some] = np.take_along_axis(score, best, 1), np.take_along_axis(id_, best, 1)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def _packed(column: pa.Array, dims: int, some: np.ndarray) -> np.ndarray:
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    starts, flat = np.cumsum(lengths) - lengths, column.flatten().to_numpy()
    q = flat[(starts[some, None] + np.arange(dims)).ravel()].reshape(len(some), dims)
    if q.size and dims * max(int(q.max()), -int(q.min())) ** 2 >= EXACT:
        raise ValueError(f"inner products must be below {EXACT} in size")
    return q.astype(np.int32)


TREE = "kind int, part int, nth int, dims int, ids binary, labels binary, q binary, spans binary, balls binary"


def _by_dims(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[int, list[tuple[pa.RecordBatch, np.ndarray]]]]:
    """Rows with one number of components, size at most."""
    held: dict[int, list[tuple[pa.RecordBatch, np.ndarray]]] = {}
    for b in batches:
        lengths = pa.compute.list_value_length(b.column(column)).to_numpy(zero_copy_only=False)
        for dims in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == dims)
            while len(mine):
                room = size - sum(len(s) for _, s in held.setdefault(dims, []))
                held[dims].append((b, mine[:room]))
                mine = mine[room:]
                if sum(len(s) for _, s in held[dims]) == size:
                    yield dims, held.pop(dims)
    yield from held.items()


def trees(rows: DataFrame, size: int, total: int, leaf: int = LEAF) -> DataFrame:
    """TREE: a tree for each block of (vec_id, label, q) rows, as the scan gives them. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for nth, (dims, held) in enumerate(_by_dims(batches, 2, size)):
            ids, labels = (np.concatenate([b.column(c).to_numpy()[s] for b, s in held]) for c in (0, 1))
            t = grown(ids, labels, np.concatenate([_packed(b.column(2), dims, s) for b, s in held]), leaf)
            spans, balls = np.stack([t.lo, t.hi, t.least_id, t.label_lo, t.label_hi]), np.column_stack([t.centre, t.radius])
            yield pa.record_batch([pa.array([0], pa.int32()), pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([dims], pa.int32()), *map(_bytes, (t.ids, t.labels, t.q, spans, balls))], names=[c.split()[0] for c in TREE.split(", ")])

    return rows.coalesce(max(1, -(-total // size))).mapInArrow(run, TREE)


def query_blocks(queries: DataFrame, total: int, size: int = QUERIES) -> DataFrame:
    """TREE with other contents: (vec_id, label, q, low, high) rows packed; low and high are lists of one length, spans and balls hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for nth, (dims, held) in enumerate(_by_dims(batches, 2, size)):
            ids, labels = (np.concatenate([b.column(c).to_numpy()[s] for b, s in held]) for c in (0, 1))
            low, high = (np.concatenate([b.column(c).flatten().to_numpy().reshape(b.num_rows, -1)[s] for b, s in held]) for c in (3, 4))
            q = np.concatenate([_packed(b.column(2), dims, s) for b, s in held])
            yield pa.record_batch([pa.array([1], pa.int32()), pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([dims], pa.int32()), *map(_bytes, (ids, labels, q, low, high))], names=[c.split()[0] for c in TREE.split(", ")])

    return queries.coalesce(max(1, -(-total // size))).mapInArrow(run, TREE)


def _tree(r: dict) -> Tree:
    ids, labels, dims = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), r["dims"]
    lo, hi, least_id, label_lo, label_hi = np.frombuffer(r["spans"], np.int64).reshape(5, -1)
    balls = np.frombuffer(r["balls"], np.float64).reshape(len(lo), dims + 1)
    return Tree(ids, labels, np.frombuffer(r["q"], np.int32).reshape(len(ids), dims), lo, hi, balls[:, :dims], balls[:, dims], least_id, label_lo, label_hi)


def best_rows(index: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, same: bool, k: int, held: int = HELD, size: int = QUERIES) -> DataFrame:
    """vec_id, nth, id, score: what each tree's group found best for each query's nth window.

    Trees are dealt into groups that one task can hold, query blocks into slots;
    each (group, slot) is a cell: its trees come first, then query blocks
    stream past them. A tree is sent once for each slot, and a query block once
    for each group.
    """
    spark = index.sparkSession
    groups = max(1, -(-n_rows // held), min(spark.sparkContext.defaultParallelism, -(-n_rows // LEAST)))
    slots = max(1, -(-n_queries // (size * SLOT)))
    group = F.pmod(F.col("part") + F.col("nth") * 31, F.lit(groups))
    slot = F.pmod(F.col("part") + F.col("nth") * 31, F.lit(slots))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tree_rows = index.withColumn("slot", every(slots)).withColumn("cell", group * slots + F.col("slot")).drop("slot")
    query_rows = query_blocks(queries, n_queries, size).withColumn("group", every(groups)).withColumn("cell", F.col("group") * slots + slot).drop("group")
    cells = tree_rows.unionByName(query_rows).repartitionById(groups * slots, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, mine = None, []
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(j)[i].as_py() for j, c in enumerate(b.schema.names)}
                if r["cell"] != cell:
                    cell, mine = r["cell"], []
                if r["kind"] == 0:
                    mine.append(_tree(r))
                    continue
                fitting = [t for t in mine if t.q.shape[1] == r["dims"]]
                ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                q = np.frombuffer(r["q"], np.int32).reshape(len(ids), r["dims"])
                low, high = (np.frombuffer(r[c], np.int64).reshape(len(ids), -1) for c in ("spans", "balls"))
                for nth in range(low.shape[1]):
                    search = Search(Wanted(q, labels, ids, low[:, nth], high[:, nth], same, k))
                    for t in fitting:
                        search.over(t)
                    row, at = np.nonzero(search.score > NONE)
                    yield pa.record_batch([pa.array(ids[row]), pa.array(np.full(len(row), nth, np.int32)), pa.array(search.id[row, at]), pa.array(search.score[row, at])], names=["vec_id", "nth", "id", "score"])

    found = cells.mapInArrow(run, "vec_id long, nth int, id long, score long")
    best = Window.partitionBy("vec_id", "nth").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over rows (vec_id, label, q).

    An anchor's positives are its best other rows of its label. For each of
    them, the best rows of other labels whose scores are between low and high
    hundredths of the positive's come back; scores are whole inner products,
    ties go to the smaller id. Rows with a null id, label or vector take no
    part. Vectors meet only those with as many components; empty ones score 0.
    Rows that share an id are candidates each for itself; as an anchor such an
    id counts once, with the least label and vector, and none of them is its
    positive. A negative positive_score has no window. Empty table: no rows.
    Other columns are ignored.
    """
    spark = rows.sparkSession
    small_batches(spark)
    tables = Tables(spark)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "q").dropna()
    n_rows = rows.count()
    size = min(MOST, max(LEAST, n_rows // (2 * spark.sparkContext.defaultParallelism)))
    index = tables.keep(trees(rows, size, n_rows), "trees")
    anchors = tables.keep(rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.*"), "anchors")
    n_anchors = anchors.count()
    whole = lambda x: F.array(F.lit(x).cast("long"))
    first = best_rows(index, anchors.withColumns({"low": whole(NONE + 1), "high": whole(LAST)}), n_rows, n_anchors, True, positives)
    first = tables.keep(first.select("vec_id", F.col("rank").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # A window for each place; places without a positive have none.
    score = F.array_sort(F.collect_list(F.struct("of", "positive_score")))
    down = lambda x: ((x - F.pmod(x, F.lit(100))) / 100).cast("long")  # noqa: E731  the division has no remainder
    at = lambda i, f, none: F.coalesce(f(F.try_element_at("s", F.lit(i + 1))["positive_score"]), F.lit(none).cast("long"))
    lows = F.array(*[at(i, lambda s: -down(-s * low), LAST) for i in range(positives)])
    highs = F.array(*[at(i, lambda s: down(s * high), NONE) for i in range(positives)])
    asked = first.groupBy("vec_id").agg(score.alias("s")).join(anchors, "vec_id").select("vec_id", "label", "q", lows.alias("low"), highs.alias("high"))
    found = best_rows(index, asked, n_rows, n_anchors, False, negatives).withColumn("of", F.col("nth") + 1)
    out = found.join(first, ["vec_id", "of"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"), SCALE).where("vec_id IS NOT NULL AND label IS NOT NULL")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % EVERY == 0)


OP13_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE label <> anchor_label AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
