"""Ranks, skylines and retention over whole tables, by ranges and running totals instead of one sorted task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import normal_cdf
from ..plans.prefix import running


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """value, ties, rank of each distinct value (1-based; rows that tie share the mean of their ranks). Nulls are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties"))
    ahead = running(counts, [F.col(value)], {"before": (F.sum, "ties")})
    return ahead.select(value, "ties", (F.coalesce("before", F.lit(0)) + (F.col("ties") + 1) / 2).alias("rank"))


def signed_ranks(differences: DataFrame, d: str = "d") -> DataFrame:
    """One row: n, plus, minus (sums of the ranks of positive and negative differences), ties (sum of t**3 - t). Zero and null differences are left out."""
    some = differences.select(F.col(d).cast("double").alias("d")).where("d <> 0")
    sided = some.groupBy(F.abs("d").alias("size")).agg(F.sum((F.col("d") > 0).cast("long")).alias("up"), F.count("*").alias("ties"))
    ahead = running(sided, [F.col("size")], {"before": (F.sum, "ties")})
    rank = F.coalesce("before", F.lit(0)) + (F.col("ties") + 1) / 2
    t = F.col("ties").cast("double")
    return ahead.agg(F.coalesce(F.sum("ties"), F.lit(0)).alias("n"), F.coalesce(F.sum(rank * F.col("up")), F.lit(0.0)).alias("plus"), F.coalesce(F.sum(rank * (F.col("ties") - F.col("up"))), F.lit(0.0)).alias("minus"), F.coalesce(F.sum(t * t * t - t), F.lit(0.0)).alias("ties"))


def wilcoxon(ranks: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """n, statistic, z, p of signed_ranks by the normal curve, with ties and continuity corrected. No differences, or no variance: p is 1 and z null."""
    n, plus, minus = F.col("n").cast("double"), F.col("plus"), F.col("minus")
    mean, variance = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    two = alternative == "two-sided"
    statistic = F.least(plus, minus) if two else plus
    off = F.abs(statistic - mean) - 0.5 if two else plus - mean + F.when(plus < mean, 0.5).otherwise(-0.5)
    fit = ranks.select("n", F.when(n > 0, statistic).otherwise(0.0).alias("statistic"), F.when((n > 0) & (variance > 0), off / F.sqrt(variance)).alias("z"))
    z = F.col("z")
    p = 2 * (1 - normal_cdf(F.abs(z))) if two else 1 - normal_cdf(z) if alternative == "greater" else normal_cdf(z)
    return fit.select("n", "statistic", (-z if two else z).alias("z"), F.when(z.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).alias("p"))


def pareto(df: DataFrame, cost: str, quality: str) -> DataFrame:
    """Rows that no other beats: none is as cheap and better, or cheaper and as good. Rows alike in both stay together; nulls are left out."""
    fit = df.where(F.col(cost).isNotNull() & F.col(quality).isNotNull())
    best = fit.groupBy(cost).agg(F.max(quality).alias(quality))
    ahead = running(best, [F.col(cost)], {"before": (F.max, quality)})
    return fit.join(ahead.where(F.col("before").isNull() | (F.col(quality) > F.col("before"))).select(cost, quality), [cost, quality])


def greedy(items: DataFrame, order: list[str], tokens: str, budget: int) -> DataFrame:
    """items with included and running: taken in order while they fit what is left of the budget; one that doesn't is skipped and later ones may fit. order has no ties; null tokens count 0.

    In rounds over running totals: a round takes all that fits before the first
    item that doesn't. After it only items of at most what is left can ever be
    taken, so the next round looks at those. The driver keeps that item and what
    is left for each round. The last item of a round that stops is larger than
    the rest, so rounds are few unless sizes fall slowly.
    """
    d = items.withColumn("_tokens", F.coalesce(F.col(tokens), F.lit(0)).cast("long")).withColumn("_key", F.struct(*order))
    rounds: list[tuple[object, int]] = []  # the first item that doesn't fit (none: all do), and what the round had
    left, after = budget, None
    while True:
        fit = d.where((F.col("_tokens") <= left) & (F.lit(True) if after is None else F.col("_key") > after))
        ahead = running(fit.select(*order, "_tokens", "_key"), [F.col(c) for c in order], {"_before": (F.sum, "_tokens")})
        before = F.coalesce("_before", F.lit(0))
        stop = ahead.where(before + F.col("_tokens") > left).agg(F.min(F.struct("_key", before.alias("_before"))).alias("s")).first()["s"]
        if stop is None:
            rounds.append((None, left))
            break
        after = F.struct(*[F.lit(v).cast(d.schema[c].dataType).alias(c) for c, v in zip(order, stop["_key"])])
        rounds.append((after, left))
        left -= stop["_before"]
    included = F.col("_tokens") <= rounds[-1][1]
    for key, had in reversed(rounds[:-1]):
        included = F.when(F.col("_key") < key, F.col("_tokens") <= had).when(F.col("_key") == key, F.lit(False)).otherwise(included)
    marked = d.withColumn("included", included).withColumn("_taken", F.when(F.col("included"), F.col("_tokens")).otherwise(0))
    out = running(marked.drop("_key"), [F.col(c) for c in order], {"_before": (F.sum, "_taken")})
    return out.select(*items.columns, "included", (F.coalesce("_before", F.lit(0)) + F.col("_taken")).alias("running"))


def a29_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("cost"), F.col("p_size").alias("quality"))
    return pareto(part, "cost", "quality").select("id", "cost", "quality")


def w27_average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.abs("s_acctbal").alias("size"))
    return s.join(average_ranks(s, "size"), "size").select("s_suppkey", F.col("rank").alias("average_rank"))


def q5_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_acctbal")
    d = s.join(F.broadcast(s.agg(F.avg("s_acctbal").alias("mean")))).select(F.round(F.col("s_acctbal") - F.col("mean"), 2).alias("d"))
    n, w = F.col("n").cast("double"), F.col("plus")
    mean = n * (n + 1) / 4
    z = (w - mean - F.when(w > mean, 0.5).when(w < mean, -0.5).otherwise(0.0)) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return signed_ranks(d).where("n > 0").select(n.alias("n"), w.alias("w"), F.round(z, 6).alias("z"))


def k6_retention(spark: SparkSession, sf_dir: str, since: str = "1995-01-01 00:00:00", most: int = 50) -> DataFrame:
    """The most used of what was used since a time; the sort keeps most rows in each task."""
    used = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey").agg(F.count("*").alias("uses"), F.max("l_shipdate").alias("used"))
    return used.where(F.col("used") >= F.lit(since).cast("timestamp")).orderBy(F.desc("uses"), F.desc("used"), "l_partkey").limit(most).select("l_partkey", "uses")


#: Their SQL twins are the declared queries of the same names, which rank in one task.
QUERIES = {f.__name__: f for f in (a29_pareto, w27_average_ranks, q5_wilcoxon, k6_retention)}
