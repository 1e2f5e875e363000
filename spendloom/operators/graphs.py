"""Graph iterations: PageRank, reach with depth, dependency closure. Each round is one join and one aggregation, cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spread import dealt
from ..plans.storage import cut

#: Nodes of a frontier that are sent to all tasks; a larger one is dealt like the links.
SENT = 100_000


def pagerank(edges: DataFrame, bias: DataFrame | None = None, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank) of a graph (src, dst); ranks sum to 1.

    bias (id, weight): the teleport weights, equal where absent or all 0. Ranks
    of nodes without edges out go to the teleport. Stops when the ranks' summed
    change is under tolerance. Repeated edges count once; null ends are dropped.
    """
    edges = cut(edges.dropna(subset=["src", "dst"]).select("src", "dst").distinct(), "edges")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    if bias is not None:
        nodes = nodes.join(bias.groupBy("id").agg(F.sum("weight").alias("weight")), "id", "left").fillna(0.0, ["weight"])
    else:
        nodes = nodes.withColumn("weight", F.lit(1.0))
    degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    nodes = cut(nodes.join(degrees, "id", "left"), "nodes")
    n, total = nodes.agg(F.count("*"), F.sum("weight")).first()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    share = F.col("weight") / F.lit(float(total)) if total else F.lit(1.0 / n)
    nodes = nodes.withColumn("teleport", share).drop("weight")
    ranks = cut(nodes.withColumn("rank", F.lit(1.0 / n)), "ranks")
    for _ in range(rounds):
        sunk = ranks.where(F.col("degree").isNull()).agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = ranks.where(F.col("degree").isNotNull()).select(F.col("id").alias("src"), (F.col("rank") / F.col("degree")).alias("part"))
        got = edges.join(sent, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
        new = F.lit(damping) * F.coalesce("got", F.lit(0.0)) + (1.0 - damping + damping * sunk) * F.col("teleport")
        ranks = cut(ranks.join(got, "id", "left").select("id", "degree", "teleport", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")), "ranks")
        if ranks.agg(F.sum("moved")).first()[0] < tolerance:
            break
        ranks = ranks.drop("moved")
    return ranks.select("id", "rank")


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None, directed: bool = True) -> DataFrame:
    """(id, distance) of all nodes reachable from start (id) within depth steps. The frontier alone is joined in each round."""
    links = edges.dropna(subset=["src", "dst"]).select("src", "dst")
    if not directed:
        links = links.union(links.select(F.col("dst"), F.col("src")))
    links = cut(links, "links")  # repeats do no harm
    n = links.count()
    seen = frontier = cut(start.select("id").dropna().distinct().withColumn("distance", F.lit(0)), "reach")
    step, size = 0, seen.count()
    while depth is None or step < depth:
        step += 1
        at = frontier.select(F.col("id").alias("src"))
        near = links.join(F.broadcast(at), "src") if size <= SENT else dealt(links, n, "src").join(dealt(at, n, "src"), "src")
        near = dealt(near.select(F.col("dst").alias("id")), n, "id").distinct()
        frontier = cut(near.join(seen, "id", "left_anti").withColumn("distance", F.lit(step)), "reach")
        if not (size := frontier.count()):
            break
        seen = seen.union(frontier)
    return seen


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return dealt(lines.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000_000).alias("dst")), lines.count(), "src", "dst").distinct()


def r1_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank(_edges(spark, sf_dir), tolerance=1e-9).select("id", F.round("rank", 8).alias("rank"))


def r3_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return reach(edges, edges.agg(F.min("src").alias("id")), directed=False).withColumn("distance", F.col("distance").cast("long"))


#: The graph has edges from suppliers to parts alone, so the fixed point has a closed form: parts send nothing.
R1_SQL = """WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000000000 AS dst FROM lineitem), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v), d AS (SELECT src, count(*) AS d FROM e GROUP BY src),
  g AS (SELECT dst AS id, sum(1e0 / d) AS g FROM e JOIN d ON e.src = d.src GROUP BY dst), w AS (SELECT v.id, 1e0 + 0.85e0 * coalesce(g, 0e0) AS w FROM v LEFT JOIN g ON v.id = g.id)
  SELECT id, round(w / sum(w) OVER (), 8) AS rank FROM w"""
R3_SQL = """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000000000 AS dst FROM lineitem), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(id, distance) AS (SELECT min(src), 0 FROM e UNION SELECT b.dst, r.distance + 1 FROM r JOIN b ON b.src = r.id WHERE r.distance < 8)
  SELECT id, CAST(min(distance) AS BIGINT) AS distance FROM r WHERE id IS NOT NULL GROUP BY id"""
QUERIES = {"r1_pagerank": r1_pagerank, "r3_distances": r3_distances}
ORACLE_SQL = {"r1_pagerank": R1_SQL, "r3_distances": R3_SQL}
