"""Nearest vectors by cosine, slices and closures of a graph under a budget."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spread import dealt
from ..plans.storage import cut
from .graphs import reach
from .ranked import greedy

#: Queries of a block: some 4 MB at 128 dimensions, the bound of what a task is sent.
BLOCK = 4096
#: Vectors scored at a time against a block: 16 MB of scores.
STEP = 512


def nearest(vectors: DataFrame, queries: DataFrame, id_: str = "vec_id", value: str = "embedding") -> DataFrame:
    """query_id, vec_id, cosine: of all other vectors the likest to each query, ties (to six places) to the smaller id.

    Queries are scored in blocks of BLOCK, each sent to all tasks, which score
    STEP vectors at a time and keep one row a query. Null, empty and zero vectors and those with null components
    take no part; vectors meet those of their own length. Empty tables: no rows.
    """
    usable = lambda df: df.select(F.col(id_).cast("long").alias("id"), F.transform(value, lambda x: x.cast("double")).alias("v")).where(F.col("id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)) & F.exists("v", lambda x: x != 0))
    rows, wanted = usable(vectors), usable(queries)
    bounds = [r[0] for r in wanted.select("id").sort("id").withColumn("n", F.monotonically_increasing_id()).where(F.col("n") % BLOCK == 0).collect()]  # one id for each block
    out = []
    for lo, hi in zip(bounds, [*bounds[1:], None]):
        block = wanted.where((F.col("id") >= lo) & (F.lit(True) if hi is None else F.col("id") < hi)).collect()  # BLOCK rows at most
        by_size: dict[int, list] = {}
        for r in block:
            by_size.setdefault(len(r.v), []).append(r)
        packs = {n: (np.array([r.id for r in rs]), np.array([np.array(r.v) / np.linalg.norm(r.v) for r in rs])) for n, rs in by_size.items()}
        held = rows.sparkSession.sparkContext.broadcast(packs)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best = {n: (np.full(len(ids), -np.inf), np.full(len(ids), -1)) for n, (ids, _) in held.value.items()}
            for b in batches:
                sizes = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
                for n, (ids, q) in held.value.items():
                    mine = b.filter(pa.array(sizes == n))
                    for lo in range(0, mine.num_rows, STEP):
                        some = mine.slice(lo, STEP)
                        v, at = some.column(1).flatten().to_numpy().reshape(-1, n), some.column(0).to_numpy()
                        score = np.round(q @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6)
                        score[ids[:, None] == at[None, :]] = -np.inf
                        order = np.argsort(at, kind="stable")
                        k = order[score[:, order].argmax(1)]
                        s, i = score[np.arange(len(ids)), k], at[k]
                        top, who = best[n]
                        wins = (s > top) | (s == top) & (i < who)
                        best[n] = (np.where(wins, s, top), np.where(wins, i, who))
            for n, (ids, _) in held.value.items():
                seen = np.isfinite(best[n][0])
                yield pa.record_batch([pa.array(ids[seen]), pa.array(best[n][1][seen]), pa.array(best[n][0][seen])], names=["query_id", "vec_id", "cosine"])

        out.append(rows.mapInArrow(run, "query_id long, vec_id long, cosine double"))
    if not out:
        return rows.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("cosine")).limit(0)
    found = reduce(DataFrame.unionByName, out)
    best = found.groupBy("query_id").agg(F.max(F.struct("cosine", (-F.col("vec_id")).alias("least"))).alias("b"))
    return best.select("query_id", (-F.col("b.least")).alias("vec_id"), F.col("b.cosine").alias("cosine"))


def sliced(edges: DataFrame, tokens: DataFrame, seeds: DataFrame, depth: int | None, budget: int) -> DataFrame:
    """item, tokens, included, running: what seeds reach, nearest first (then fewer tokens, then id), packed greedily under a budget."""
    at = cut(reach(edges, seeds, depth).join(tokens, "id"), "slice")
    return greedy(at, ["distance", "tokens", "id"], "tokens", budget).select(F.col("id").alias("item"), "tokens", "included", "running")


def pull_or_push(edges: DataFrame, tokens: DataFrame, wanted: DataFrame, signature: float = 0.1) -> DataFrame:
    """One row: tokens of all bodies (push), of all signatures and the wanted closure's bodies (pull), the buffer (largest body left out), and the decision."""
    inside = reach(edges, wanted.join(tokens.select("id"), "id", "left_semi")).select("id", F.lit(1).alias("inside"))
    t = tokens.join(inside, "id", "left")
    sums = t.agg(F.sum("tokens").alias("push"), F.sum(F.floor(F.col("tokens") * signature)).alias("signatures"), F.coalesce(F.sum(F.when(F.col("inside") == 1, F.col("tokens"))), F.lit(0)).alias("bodies"), F.coalesce(F.max(F.when(F.col("inside").isNull(), F.col("tokens"))), F.lit(0)).alias("buffer"), F.count("inside").alias("closure"))
    pull = F.col("signatures") + F.col("bodies")
    return sums.select("closure", "push", pull.alias("pull"), "buffer", F.when(pull + F.col("buffer") < F.col("push"), "pull").otherwise("push").alias("decision"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts of an order depend on the part with the next larger key in it; a part's tokens are its size."""
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = dealt(table.select("l_orderkey", "l_partkey"), table.count(), "l_orderkey").distinct()
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    a, b = lines.withColumnRenamed("l_partkey", "src"), lines.withColumnRenamed("l_partkey", "dst")
    edges = a.join(b, "l_orderkey").where("src < dst").groupBy("l_orderkey", "src").agg(F.min("dst").alias("dst")).select("src", "dst")  # repeats are nothing to reach
    return edges, part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("tokens"))


def _seeds(tokens: DataFrame) -> DataFrame:
    """The part with the smallest key: links lead to larger keys, so it has most to reach (the largest has nothing)."""
    return tokens.agg(F.min("id").alias("id"))


def j7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    best = nearest(v, v.where("vec_id % 20 = 0"))
    label = v.select(F.col("vec_id").alias("id"), "label")
    both = best.join(label.withColumnsRenamed({"id": "query_id", "label": "a"}), "query_id").join(label.withColumnsRenamed({"id": "vec_id", "label": "b"}), "vec_id")
    return both.select("query_id", "vec_id", "cosine", (F.col("cosine") >= 0.92).alias("hit"), (F.col("a") == F.col("b")).alias("fresh"))


def r2_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, tokens = _graph(spark, sf_dir)
    return sliced(edges, tokens, _seeds(tokens), 3, 400)


def r4_pull_or_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, tokens = _graph(spark, sf_dir)
    return pull_or_push(edges, tokens, _seeds(tokens))


QUERIES = {f.__name__: f for f in (j7_nearest, r2_slice, r4_pull_or_push)}
_EDGES = """l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), e AS (SELECT DISTINCT src, dst FROM (SELECT p AS src, lead(p) OVER (PARTITION BY o ORDER BY p) AS dst FROM l) x WHERE dst IS NOT NULL)"""
ORACLE_SQL = {
    "j7_nearest": """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS c, a.label = b.label AS fresh FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS k FROM s)
        SELECT query_id, vec_id, c AS cosine, c >= 0.92 AS hit, fresh FROM r WHERE k = 1""",
    "r2_slice": "WITH RECURSIVE " + _EDGES + """, r(id, d) AS (SELECT min(p_partkey), 0 FROM part UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON e.src = r.id WHERE r.d < 3), m AS (SELECT id, min(d) AS d FROM r GROUP BY id), o AS (SELECT id, CAST(p_size AS BIGINT) AS tokens, row_number() OVER (ORDER BY d, p_size, id) AS i FROM m JOIN part ON p_partkey = id),
        g AS (SELECT id, tokens, i, tokens <= 400 AS included, CASE WHEN tokens <= 400 THEN tokens ELSE 0 END AS running FROM o WHERE i = 1 UNION ALL SELECT o.id, o.tokens, o.i, g.running + o.tokens <= 400, g.running + CASE WHEN g.running + o.tokens <= 400 THEN o.tokens ELSE 0 END FROM g JOIN o ON o.i = g.i + 1)
        SELECT id AS item, tokens, included, CAST(running AS BIGINT) AS running FROM g""",
    "r4_pull_or_push": "WITH RECURSIVE " + _EDGES + """, r(id) AS (SELECT min(p_partkey) FROM part UNION SELECT e.dst FROM r JOIN e ON e.src = r.id), t AS (SELECT CAST(p_size AS BIGINT) AS tokens, r.id IS NOT NULL AS inside FROM part LEFT JOIN r ON r.id = p_partkey),
        s AS (SELECT count(*) FILTER (inside) AS closure, sum(tokens) AS push, sum(floor(tokens * 0.1)) + coalesce(sum(tokens) FILTER (inside), 0) AS pull, coalesce(max(tokens) FILTER (NOT inside), 0) AS buffer FROM t)
        SELECT closure, CAST(push AS BIGINT) AS push, CAST(pull AS BIGINT) AS pull, buffer, CASE WHEN pull + buffer < push THEN 'pull' ELSE 'push' END AS decision FROM s""",
}
