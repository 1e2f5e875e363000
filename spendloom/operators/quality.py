"""Does a cheaper arm keep quality? Paired outcomes, exact and asymptotic tests, and the gate over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distributions import binomial_two_sided, chi_square_sf, normal_cdf
from ..plans.storage import cut
from .ranked import signed_ranks, wilcoxon

#: Margins of the acceptance and test-pass rates, and the level.
ACCEPTANCE, TESTS, ALPHA = 0.01, 0.005, 0.05
#: From so many discordant pairs on, McNemar's test takes the chi-square curve.
EXACT_BELOW = 25


def mcnemar(b: Column, c: Column) -> Column:
    """statistic, p, exact: b pairs lost under the treatment, c won. Exact below EXACT_BELOW pairs; none: p is 1."""
    n = b + c
    chi2 = F.pow(F.abs(b - c) - 1, F.lit(2)) / n
    exact = n < EXACT_BELOW
    statistic = F.when(n == 0, F.lit(0.0)).when(exact, F.least(b, c).cast("double")).otherwise(chi2)
    p = F.when(exact, binomial_two_sided(F.least(b, c), n)).otherwise(chi_square_sf(chi2, F.lit(1.0)))
    return F.struct(statistic.alias("statistic"), p.alias("p"), exact.alias("exact"))


def non_inferior(rates: DataFrame) -> DataFrame:
    """rates (n, control, treatment: counts of successes, margin) with statistic and p of the one-sided, unpooled test that the treatment's rate is at least the control's less the margin.

    Without spread the statistic is infinite if the margin is kept, else 0.
    Without rows it is 0 and p is 1.
    """
    n = F.col("n")
    pt, pc = F.col("treatment") / n, F.col("control") / n
    shifted, se = pt - pc + F.col("margin"), F.sqrt(pt * (1 - pt) / n + pc * (1 - pc) / n)
    z = F.when(n == 0, F.lit(0.0)).when(se == 0, F.when(shifted > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(shifted / se)
    p = F.when(n == 0, F.lit(1.0)).when(F.col("statistic") == float("inf"), F.lit(0.0)).otherwise(1 - normal_cdf(F.col("statistic")))
    return rates.withColumn("statistic", z).withColumn("p", p)


def gate(pairs: DataFrame, acceptance: float = ACCEPTANCE, tests: float = TESTS, alpha: float = ALPHA) -> DataFrame:
    """metric, non_inferior, n, control, treatment, statistic, p, passed (all three metrics are non-inferior), one row for each metric.

    pairs: control_accepted, treatment_accepted (null: not accepted),
    control_distance, treatment_distance, control_passed, treatment_passed (null:
    no tests ran). Edit distances count where both arms were accepted (a null
    one leaves its pair out) and must not be significantly greater; rates must
    keep within their margins; without pairs, or without tests on both sides,
    the rate isn't shown to be kept.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    ran = (F.col("control_passed").isNotNull() & F.col("treatment_passed").isNotNull()).cast("long")
    both = (yes("control_accepted") * yes("treatment_accepted") == 1) & F.col("control_distance").isNotNull() & F.col("treatment_distance").isNotNull()
    number = lambda x: F.coalesce(F.sum(x), F.lit(0))
    sums = pairs.agg(
        F.count("*").alias("n"), number(yes("control_accepted")).alias("ca"), number(yes("treatment_accepted")).alias("ta"), number(ran).alias("nt"), number(ran * yes("control_passed")).alias("ct"), number(ran * yes("treatment_passed")).alias("tt"),
        number(both.cast("long")).alias("nd"), F.avg(F.when(both, F.col("control_distance").cast("double"))).alias("cd"), F.avg(F.when(both, F.col("treatment_distance").cast("double"))).alias("td"),
    )
    distance = wilcoxon(signed_ranks(pairs.where(both).select((F.col("treatment_distance") - F.col("control_distance")).alias("d"))), "greater").select(F.col("statistic").alias("w"), F.col("p").alias("wp"))
    one = cut(sums.crossJoin(distance), "gate")  # one row and one row
    rate = lambda metric, n, c, t, margin: F.struct(F.lit(metric).alias("metric"), F.col(n).alias("n"), F.col(c).alias("control"), F.col(t).alias("treatment"), F.lit(margin).alias("margin"))
    rates = non_inferior(one.select(F.inline(F.array(rate("acceptance_rate", "n", "ca", "ta", acceptance), rate("test_pass_rate", "nt", "ct", "tt", tests)))))
    share = lambda x: F.when(F.col("n") > 0, F.col(x) / F.col("n")).otherwise(0.0).alias(x)
    rates = rates.select("metric", ((F.col("n") > 0) & (F.col("p") < alpha)).alias("non_inferior"), "n", share("control"), share("treatment"), "statistic", "p")
    distances = one.select(F.lit("edit_distance").alias("metric"), (F.col("wp") >= alpha).alias("non_inferior"), F.col("nd").alias("n"), F.coalesce("cd", F.lit(0.0)).alias("control"), F.coalesce("td", F.lit(0.0)).alias("treatment"), F.col("w").alias("statistic"), F.col("wp").alias("p"))
    every = rates.unionByName(distances)  # three rows
    return every.withColumn("passed", F.min("non_inferior").over(Window.partitionBy(F.lit(0))))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second lines of an order as its two arms (the best of lines with one number): returned lines weren't accepted, discounts are distances, untaxed lines had no tests."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber <= 2")
    arm = lambda k, name: [F.max(F.when(F.col("l_linenumber") == k, c)).alias(f"{name}_{what}") for what, c in (("accepted", F.col("l_returnflag") != "R"), ("distance", F.col("l_discount").cast("double")), ("passed", F.when(F.col("l_tax") > 0, F.col("l_linestatus") == "F")))]
    both = lines.groupBy("l_orderkey").agg(F.max("l_suppkey").alias("supplier"), *arm(1, "control"), *arm(2, "treatment"))
    return both.where("control_accepted IS NOT NULL AND treatment_accepted IS NOT NULL")


def q2_mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's orders: too few are discordant for the curve; and all of them, which are many."""
    pairs = _pairs(spark, sf_dir).withColumns({"b": (F.col("control_accepted") & ~F.col("treatment_accepted")).cast("long"), "c": (~F.col("control_accepted") & F.col("treatment_accepted")).cast("long")})
    sums = pairs.groupBy("supplier").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    every = sums.agg(F.lit(None).cast("long").alias("supplier"), F.sum("b").alias("b"), F.sum("c").alias("c"))
    test = sums.withColumn("supplier", F.col("supplier").cast("long")).unionByName(every).select("supplier", "b", "c", mcnemar(F.col("b"), F.col("c")).alias("t"))
    return test.select("supplier", "b", "c", F.round("t.statistic", 9).alias("statistic"), F.round("t.p", 9).alias("p"), F.col("t.exact").alias("exact"))


def q7_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gate(_pairs(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("control", "treatment", "statistic", "p")})


QUERIES = {f.__name__: f for f in (q2_mcnemar_exact, q7_quality_gate)}
_P = """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS supplier, bool_or(l_returnflag <> 'R') AS ok, CAST(max(l_discount) AS DOUBLE) AS d, bool_or(CASE WHEN l_tax > 0 THEN l_linestatus = 'F' END) AS passed FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey, l_linenumber),
    p AS (SELECT greatest(a.supplier, b.supplier) AS supplier, a.ok AS ca, b.ok AS ta, a.d AS cd, b.d AS td, a.passed AS cp, b.passed AS tp FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2)"""
_CDF = "0.5e0 * (1 + sign({0}) * (1 - (((((1.061405429e0 * t - 1.453152027e0) * t + 1.421413741e0) * t - 0.284496736e0) * t + 0.254829592e0) * t * exp(-{0} * {0} / 2))))"
_T = "1 / (1 + 0.3275911e0 * abs({0}) / sqrt(2e0))"
_RATE = "SELECT '{metric}' AS metric, n, c / n AS control, t / n AS treatment, (t / n - c / n + {margin}) / sqrt(t / n * (1 - t / n) / n + c / n * (1 - c / n) / n) AS z FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST({c} AS INT)) AS DOUBLE) AS c, CAST(sum(CAST({t} AS INT)) AS DOUBLE) AS t FROM p WHERE {where})"
#: The exact tail by factorials, the chi-square tail of one degree of freedom by a series of erf in double factorials; ranks by a window.
ORACLE_SQL = {
    "q2_mcnemar_exact": _P + """, s AS (SELECT CAST(supplier AS BIGINT) AS supplier, count(*) FILTER (WHERE ca AND NOT ta) AS b, count(*) FILTER (WHERE NOT ca AND ta) AS c FROM p GROUP BY supplier), u AS (SELECT * FROM s UNION ALL SELECT NULL, CAST(sum(b) AS BIGINT), CAST(sum(c) AS BIGINT) FROM s),
        x AS (SELECT *, b + c AS n, power(abs(b - c) - 1e0, 2) / (b + c) AS chi2 FROM u)
        SELECT supplier, b, c, CASE WHEN n = 0 THEN 0e0 WHEN n < 25 THEN CAST(least(b, c) AS DOUBLE) ELSE round(chi2, 9) END AS statistic, n < 25 AS exact,
          round(CASE WHEN n = 0 THEN 1e0 WHEN n < 25 THEN least(1e0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: CAST(factorial(CAST(n AS INT)) AS DOUBLE) / CAST(factorial(CAST(i AS INT)) AS DOUBLE) / CAST(factorial(CAST(n - i AS INT)) AS DOUBLE))) / power(2e0, n))
            WHEN chi2 = 0 THEN 1e0 ELSE 1 - 2 / sqrt(pi()) * exp(-chi2 / 2) * list_sum(list_transform(range(0, 400), lambda k: exp((2 * k + 1) * ln(sqrt(chi2 / 2)) + 2 * k * ln(2e0) + lgamma(k + 1e0) - lgamma(2 * k + 2e0)))) END, 9) AS p FROM x""",
    "q7_quality_gate": _P + f""", d AS (SELECT td - cd AS d, cd, td FROM p WHERE ca AND ta), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY abs(d)) AS ties FROM d WHERE d <> 0),
        w AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0e0 END) AS w, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie FROM k),
        v AS (SELECT w, (w - n * (n + 1) / 4 + CASE WHEN w < n * (n + 1) / 4 THEN 0.5e0 ELSE -0.5e0 END) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS z FROM w),
        m AS ({_RATE.format(metric='acceptance_rate', margin='0.01e0', c='ca', t='ta', where='true')} UNION ALL {_RATE.format(metric='test_pass_rate', margin='0.005e0', c='cp', t='tp', where='cp IS NOT NULL AND tp IS NOT NULL')}),
        a AS (SELECT metric, n, control, treatment, z AS statistic, z, {_T.format('z')} AS t FROM m UNION ALL SELECT 'edit_distance', (SELECT count(*) FROM d), (SELECT avg(cd) FROM d), (SELECT avg(td) FROM d), w, z, {_T.format('z')} FROM v),
        b AS (SELECT *, 1 - {_CDF.format('z')} AS p FROM a), c AS (SELECT *, CASE WHEN metric = 'edit_distance' THEN p >= 0.05e0 ELSE p < 0.05e0 END AS non_inferior FROM b)
        SELECT metric, non_inferior, CAST(n AS BIGINT) AS n, round(control, 6) AS control, round(treatment, 6) AS treatment, round(statistic, 6) AS statistic, round(p, 6) AS p, bool_and(non_inferior) OVER () AS passed FROM c""",
}
