"""Budget envelopes: charges that count against all envelopes above, their state at a time, and the verdict on a call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import cut

#: Output tokens taken where none are given: so many at least, or a share of the input. Hours that the burn rate looks back.
LEAST_OUT, SHARE_OUT, WINDOW_HOURS = 500, 0.3, 24
DAY_US = 86_400_000_000


def above(envelopes: DataFrame) -> DataFrame:
    """envelope_id, up: each envelope with itself and all above it. Parents that don't exist end a chain; a cycle is gone round once.

    A step a level: what is found last is joined to the parents, and what is new is kept.
    """
    parents = envelopes.select(F.col("envelope_id").alias("up"), F.col("parent_id").alias("next"))
    found = last = cut(envelopes.select("envelope_id", F.col("envelope_id").alias("up")).distinct(), "envelopes")
    known = envelopes.select(F.col("envelope_id").alias("next")).distinct()
    while True:
        step = last.join(parents, "up").select("envelope_id", "next").join(known, "next").select("envelope_id", F.col("next").alias("up")).distinct()
        last = cut(step.join(found, ["envelope_id", "up"], "left_anti"), "envelopes")
        if last.isEmpty():
            return found
        found = found.unionByName(last)


def rolled(charges: DataFrame, envelopes: DataFrame) -> DataFrame:
    """charges (charge_id, envelope_id, ts, cost) once for each envelope that they count against; ids of those above follow from the charge's own, so that doing it again repeats them."""
    up = above(envelopes)
    return charges.join(up, "envelope_id").select(
        F.when(F.col("up") == F.col("envelope_id"), F.col("charge_id").cast("string")).otherwise(F.concat(F.col("charge_id").cast("string"), F.lit("#roll:"), F.col("up").cast("string"))).alias("charge_id"),
        F.col("up").alias("envelope_id"), "ts", "cost", F.when(F.col("up") != F.col("envelope_id"), F.col("envelope_id")).alias("rolled_up_from"),
    )


def states(envelopes: DataFrame, charges: DataFrame, as_of: str, window_hours: float = WINDOW_HOURS) -> DataFrame:
    """envelopes (envelope_id, starts, ends, limit_usd, ...) with spent, remaining, spent_share, elapsed_share, expired, burn (a day), days_left, projected and exhausted_at.

    charges: as rolled gives them; those before the period or after as_of, or
    without a time or cost, don't count. exhausted_at is null unless the burn of the last
    hours uses up the limit before the period ends.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    now = F.unix_micros(F.lit(as_of).cast("timestamp"))
    e = envelopes.withColumns({"_from": us("starts"), "_to": us("ends")})
    period = e.select("envelope_id", "_from", F.greatest(now - int(window_hours * 3_600_000_000), F.col("_from")).alias("_since"))
    used = charges.withColumn("_at", us("ts")).join(period, "envelope_id").where((F.col("_at") >= F.col("_from")) & (F.col("_at") <= now))
    sums = used.groupBy("envelope_id").agg(F.sum("cost").alias("spent"), F.sum(F.when(F.col("_at") >= F.col("_since"), F.col("cost"))).alias("_recent"))
    d = e.join(sums, "envelope_id", "left").withColumns({"spent": F.coalesce("spent", F.lit(0.0)).cast("double"), "_recent": F.coalesce("_recent", F.lit(0.0)).cast("double")})
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    limit = F.col("limit_usd").cast("double")
    looked = now - F.greatest(now - int(window_hours * 3_600_000_000), F.col("_from"))
    d = d.withColumns({
        "remaining": F.greatest(F.lit(0.0), limit - F.col("spent")), "spent_share": F.when(limit > 0, unit(F.col("spent") / limit)).otherwise(1.0),
        "elapsed_share": unit((now - F.col("_from")) / F.greatest(F.lit(1), F.col("_to") - F.col("_from"))), "expired": now > F.col("_to"), "days_left": F.greatest(F.lit(0.0), (F.col("_to") - now) / DAY_US),
        "burn": F.when(looked > 0, F.col("_recent") / (looked / DAY_US)).otherwise(0.0),
    })
    end = now + F.when((F.col("burn") > 0) & (F.col("spent") < limit), F.round((limit - F.col("spent")) / F.col("burn") * DAY_US)).cast("long")
    d = d.withColumns({"projected": F.col("spent") + F.col("burn") * F.col("days_left"), "exhausted_at": F.when(end <= F.col("_to"), F.timestamp_micros(end))})
    return d.drop("_from", "_to", "_recent")


def estimated(requests: DataFrame, prices: DataFrame, fallback: tuple[float, float]) -> DataFrame:
    """requests (model, tokens_in, tokens_out) with estimate, approximate (the output was guessed) and priced (the model has a price of its own; else the fallback's, in and out for a million, are taken)."""
    d = requests.join(F.broadcast(prices.select("model", "in_usd", "out_usd")), "model", "left")  # a price list
    out = F.coalesce("tokens_out", F.greatest(F.lit(LEAST_OUT), F.ceil(F.col("tokens_in") * SHARE_OUT)))
    cost = (F.col("tokens_in") * F.coalesce("in_usd", F.lit(fallback[0])) + out * F.coalesce("out_usd", F.lit(fallback[1]))) / 1e6
    return d.withColumns({"estimate": cost, "approximate": F.col("tokens_out").isNull(), "priced": F.col("in_usd").isNotNull()}).drop("in_usd", "out_usd")


def decided(requests: DataFrame, held: DataFrame) -> DataFrame:
    """requests (envelope_id, estimate, approximate) with verdict, reason and warnings against states (soft and hard are shares of the limit).

    Blocked if the period is over or the estimate passes the hard cap; a warning
    each for the soft cap, a burn that ends before the period, and a guessed
    estimate. An unknown envelope blocks, too.
    """
    s = held.select("envelope_id", "expired", "spent", (F.col("limit_usd") * F.col("soft")).alias("_soft"), (F.col("limit_usd") * F.col("hard")).alias("_hard"), (F.col("exhausted_at") < F.col("ends").cast("timestamp")).alias("_burns"))
    d = requests.join(s, "envelope_id", "left").withColumn("projected_after", F.col("spent") + F.col("estimate"))
    reason = F.when(F.col("spent").isNull(), "no_envelope").when(F.col("expired"), "expired").when(F.col("projected_after") > F.col("_hard"), "hard_cap")
    d = d.withColumn("reason", reason)
    warnings = F.array_compact(F.array(F.when(F.col("projected_after") > F.col("_soft"), "soft_cap"), F.when(F.col("_burns"), "burn_rate"), F.when(F.col("approximate"), "estimated_only")))
    d = d.withColumn("warnings", F.when(F.col("reason").isNotNull(), F.array().cast("array<string>")).otherwise(warnings))
    verdict = F.when(F.col("reason").isNotNull(), "block").when(F.size("warnings") > 0, "warn").otherwise("allow")
    return d.withColumn("verdict", verdict).select(*requests.columns, "projected_after", "verdict", "reason", "warnings")


def f20_budget_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are envelopes within those of their regions, and orders are charges; each asks for a call of its own size."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders, customer, nation, region = read("orders"), read("customer").select("c_custkey", "c_nationkey"), read("nation"), read("region")
    period = [F.lit("1995-01-01").alias("starts"), F.when(F.col("k") % 6 == 5, "1997-12-31").otherwise("1998-12-31").alias("ends"), F.lit(0.75).alias("soft"), F.lit(1.0).alias("hard")]
    nations = nation.select(F.col("n_nationkey").alias("k"), F.concat(F.lit("n"), "n_nationkey").alias("envelope_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), ((F.col("n_nationkey") % 5 + 1) * 2e7).alias("limit_usd")).select("*", *period)
    regions = region.select(F.col("r_regionkey").alias("k"), F.concat(F.lit("r"), "r_regionkey").alias("envelope_id"), F.lit(None).cast("string").alias("parent_id"), ((F.col("r_regionkey") + 1) * 1e8).alias("limit_usd")).select("*", *period)
    envelopes = nations.unionByName(regions)
    charges = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("charge_id"), F.concat(F.lit("n"), "c_nationkey").alias("envelope_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").cast("decimal(18, 2)").alias("cost"))
    held = states(envelopes, rolled(charges, envelopes), "1998-03-01", 90 * 24)
    prices = spark.createDataFrame([("small", 0.5, 2.0), ("large", 5.0, 25.0)], "model string, in_usd double, out_usd double")
    asked = envelopes.select("envelope_id", F.when(F.col("k") % 3 == 0, "small").when(F.col("k") % 3 == 1, "large").otherwise("unknown").alias("model"), (F.col("k").cast("long") * 1_000_000_000).alias("tokens_in"), F.when(F.col("k") % 2 == 0, F.col("k").cast("long") * 1000).alias("tokens_out"))
    out = decided(estimated(asked, prices, (2.5, 10.0)), held)
    return out.select("envelope_id", "priced", F.round("estimate", 4).alias("estimate"), F.round("projected_after", 2).alias("projected_after"), "verdict", "reason", F.array_join("warnings", ",").alias("warnings"))


QUERIES = {"f20_budget_decisions": f20_budget_decisions}
#: Two levels by plain joins.
ORACLE_SQL = {
    "f20_budget_decisions": """WITH env AS (SELECT 'n' || n_nationkey AS id, n_nationkey AS k, (n_nationkey % 5 + 1) * 2e7 AS cap FROM nation UNION ALL SELECT 'r' || r_regionkey, r_regionkey, (r_regionkey + 1) * 1e8 FROM region),
        ch AS (SELECT c_nationkey, n_regionkey, CAST(o_orderdate AS DATE) AS d, o_totalprice AS cost FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1998-03-01'),
        c AS (SELECT 'n' || c_nationkey AS id, d, cost FROM ch UNION ALL SELECT 'r' || n_regionkey, d, cost FROM ch),
        s AS (SELECT id, sum(CAST(cost AS DECIMAL(18, 2))) AS spent, sum(CASE WHEN d >= DATE '1997-12-01' THEN CAST(cost AS DECIMAL(18, 2)) ELSE 0 END) / 90e0 AS burn FROM c GROUP BY id),
        e AS (SELECT env.id, k, cap, CASE WHEN k % 6 = 5 THEN DATE '1997-12-31' ELSE DATE '1998-12-31' END AS ends, CAST(coalesce(spent, 0) AS DOUBLE) AS spent, CAST(coalesce(burn, 0) AS DOUBLE) AS burn, k % 3 < 2 AS priced, (k * 1e9 * CASE k % 3 WHEN 0 THEN 0.5e0 WHEN 1 THEN 5e0 ELSE 2.5e0 END + CASE WHEN k % 2 = 0 THEN k * 1000 ELSE greatest(500, ceil(k * 1e9 * 0.3e0)) END * CASE k % 3 WHEN 0 THEN 2e0 WHEN 1 THEN 25e0 ELSE 10e0 END) / 1e6 AS estimate FROM env LEFT JOIN s ON env.id = s.id),
        f AS (SELECT *, spent + estimate AS after, ends < DATE '1998-03-01' AS expired, burn > 0 AND spent < cap AND (cap - spent) / burn < date_diff('day', DATE '1998-03-01', ends) AS burns FROM e),
        v AS (SELECT *, CASE WHEN expired THEN 'expired' WHEN after > cap THEN 'hard_cap' END AS reason FROM f)
        SELECT id AS envelope_id, priced, round(estimate, 4) AS estimate, round(after, 2) AS projected_after, CASE WHEN reason IS NOT NULL THEN 'block' WHEN after > cap * 0.75e0 OR burns OR k % 2 = 1 THEN 'warn' ELSE 'allow' END AS verdict, reason,
          CASE WHEN reason IS NOT NULL THEN '' ELSE concat_ws(',', CASE WHEN after > cap * 0.75e0 THEN 'soft_cap' END, CASE WHEN burns THEN 'burn_rate' END, CASE WHEN k % 2 = 1 THEN 'estimated_only' END) END AS warnings FROM v""",
}
