"""Spend: attribution, service levels, ledgers, savings, caches and budgets (aggregations over charges)."""

from ..plans.dialect import Query

#: Strict cost of a charge row c with price row p: null where the model has no price.
COST = "(greatest(0, c.tokens_in - c.tokens_cached) * p.in_usd + c.tokens_cached * coalesce(p.cached_usd, p.in_usd) + c.tokens_out * p.out_usd) / 1e6"

QUERIES = {
    "a1_spend_since": Query("SELECT agent_id, coalesce(round(sum(CASE WHEN ts >= TIMESTAMP '1996-01-01 00:00:00' THEN cost_usd END), 4), 0e0) AS spent FROM {charges} GROUP BY agent_id"),
    "a2_count_by_feature": Query("SELECT event_type, count(*) AS n FROM {events} WHERE event_type IS NOT NULL GROUP BY event_type"),
    "a3_attribution_rollup": Query("""SELECT coalesce(region, '(unattributed)') AS region, coalesce(nation, '(unattributed)') AS nation, concat_ws('|', region, nation) AS dim_key, CAST(sum(CAST(cost_usd AS DECIMAL(18, 4))) AS DOUBLE) AS cost,
        CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(tokens_cached) AS BIGINT) AS tokens_cached, count(*) AS n FROM {charges} GROUP BY region, nation ORDER BY cost DESC, dim_key"""),
    "a3_rollup_totals": Query("SELECT region, nation, CAST(sum(CAST(cost_usd AS DECIMAL(18, 4))) AS DOUBLE) AS cost, count(*) AS n FROM {charges} GROUP BY ROLLUP (region, nation)"),
    "a4_slo_sli": Query("""WITH lim AS (SELECT max(ts) AS as_of FROM {charges}), tasks AS (
        SELECT task_id, sum(cost_usd) AS cost FROM {charges} CROSS JOIN lim WHERE task_id IS NOT NULL AND ts >= @minus_days(as_of; 365) AND ts <= as_of GROUP BY task_id)
        SELECT count(*) AS tasks, CAST(sum(CASE WHEN cost > 100000e0 THEN 1 ELSE 0 END) AS BIGINT) AS exceeding, round(sum(greatest(0e0, cost - 100000e0)), 4) AS excess,
          CASE WHEN count(*) = 0 THEN 1e0 ELSE round(1e0 - sum(CASE WHEN cost > 100000e0 THEN 1e0 ELSE 0e0 END) / count(*), 6) END AS compliance, round(5000000e0 - sum(greatest(0e0, cost - 100000e0)), 4) AS budget_left,
          round(avg(cost), 4) AS mean_cost, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY cost), 4) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY cost), 4) AS p95, round(percentile_cont(0.99) WITHIN GROUP (ORDER BY cost), 4) AS p99 FROM tasks"""),
    "a5_task_ledger": Query("""WITH priced AS (SELECT c.*, (c.tokens_in * p.in_usd + c.tokens_out * p.out_usd + c.tokens_read * coalesce(p.cached_usd, p.in_usd)) / 1e6 AS cost FROM {spend} c LEFT JOIN {prices} p ON c.model = p.model)
        SELECT task_id, CAST(sum(tokens_in + tokens_out + tokens_read) AS BIGINT) AS tokens, count(*) AS requests, CAST(sum(CASE WHEN outcome = 'accepted' THEN 1 ELSE 0 END) AS BIGINT) AS accepted,
          CAST(sum(CASE WHEN outcome IN ('rejected', 'retry', 'abandoned') THEN tokens_in + tokens_out + tokens_read ELSE 0 END) AS BIGINT) AS wasted_tokens, count(cost) = count(*) AS cost_complete,
          CASE WHEN count(cost) = count(*) THEN floor(sum(cost) * 1e6 + 0.5e0) / 1e6 END AS cost,
          CASE WHEN count(cost) = count(*) AND sum(CASE WHEN outcome = 'accepted' THEN 1 ELSE 0 END) > 0 THEN round(sum(cost) / sum(CASE WHEN outcome = 'accepted' THEN 1 ELSE 0 END), 6) END AS cost_per_accepted FROM priced GROUP BY task_id"""),
    "a6_waste_memo": Query("""WITH w AS (SELECT concat(c.model, ':', c.provider) AS fingerprint, c.ts, c.tokens_in + c.tokens_out AS tokens, """ + COST + """ AS cost FROM {charges} c LEFT JOIN {prices} p ON c.model = p.model)
        SELECT fingerprint, count(*) AS occurrences, count(DISTINCT CAST(ts AS DATE)) AS days, CAST(sum(tokens) AS BIGINT) AS tokens, CASE WHEN count(cost) = count(*) THEN round(sum(cost), 4) END AS cost, min(ts) AS first_at, max(ts) AS last_at
        FROM w GROUP BY fingerprint HAVING count(*) >= 3 AND count(DISTINCT CAST(ts AS DATE)) >= 2 ORDER BY cost DESC NULLS LAST, tokens DESC, fingerprint LIMIT 5"""),
    "a7_savings_rollup": Query("""SELECT provider AS feature, CAST(sum(greatest(0, tokens_in - tokens_cached)) AS BIGINT) AS gross, CAST(sum(greatest(0, tokens_out - 300)) AS BIGINT) AS overhead,
        CAST(sum(greatest(0, tokens_in - tokens_cached)) - sum(greatest(0, tokens_out - 300)) AS BIGINT) AS net, CASE WHEN sum(greatest(0, tokens_in - tokens_cached)) > 0 THEN round(CAST(sum(greatest(0, tokens_out - 300)) AS DOUBLE) / sum(greatest(0, tokens_in - tokens_cached)), 6) END AS ratio,
        sum(greatest(0, tokens_out - 300)) <= 0.05e0 * sum(greatest(0, tokens_in - tokens_cached)) AS within_budget FROM {charges} GROUP BY provider"""),
    "a8_feature_telemetry": Query("""WITH ids AS (SELECT * FROM (VALUES ('signup'), ('view'), ('purchase'), ('error'), ('click'), ('never')) AS f(feature)), e AS (SELECT event_type, value, ts, event_id, @props(props) AS k FROM {events})
        SELECT feature, count(e.event_id) AS events, CAST(sum(k) AS BIGINT) AS k_sum, round(sum(value), 4) AS value_sum, max_by(e.event_id, struct_pack(ts := ts, id := event_id)) AS latest FROM ids LEFT JOIN e ON feature = event_type GROUP BY feature""".replace("struct_pack(ts := ts, id := event_id)", "@pair(ts; event_id)")),
    "a9_cache_metrics": Query("""SELECT c.model, round(CAST(sum(c.tokens_cached) AS DOUBLE) / (sum(c.tokens_in) + sum(c.tokens_cached) + sum(c.tokens_out)), 6) AS hit_rate, round(sum(c.tokens_in * p.in_usd + c.tokens_out * p.in_usd * 1.25e0 + c.tokens_cached * coalesce(p.cached_usd, p.in_usd * 0.1e0)) / 1e6, 6) AS actual_usd,
        round(sum((c.tokens_in + c.tokens_out + c.tokens_cached) * p.in_usd) / 1e6, 6) AS uncached_usd, round(greatest(0e0, sum((c.tokens_in + c.tokens_out + c.tokens_cached) * p.in_usd) - sum(c.tokens_in * p.in_usd + c.tokens_out * p.in_usd * 1.25e0 + c.tokens_cached * coalesce(p.cached_usd, p.in_usd * 0.1e0))) / 1e6, 6) AS saved_usd
        FROM {charges} c JOIN {prices} p ON c.model = p.model GROUP BY c.model"""),
    "a10_writer_harm": Query("""WITH w AS (SELECT o_custkey AS writer, count(*) AS writes, sum(CASE WHEN o_orderstatus = 'P' THEN 1e0 ELSE 0e0 END) / count(*) AS rejection_rate, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1e0 ELSE 0e0 END) / count(*) AS collision_rate FROM {orders} GROUP BY o_custkey)
        SELECT writer, writes, round(rejection_rate, 6) AS rejection_rate, round(collision_rate, 6) AS collision_rate, CASE WHEN writes >= 5 AND rejection_rate >= 0.3e0 THEN 'rejections' WHEN writes >= 5 AND collision_rate >= 0.3e0 THEN 'collisions' END AS quarantine FROM w"""),
    "a11_budget_state": Query("""WITH lim AS (SELECT max(ts) AS as_of FROM {charges}), s AS (SELECT region, sum(CASE WHEN ts >= date_trunc('month', as_of) AND ts <= as_of THEN cost_usd ELSE 0e0 END) AS spent, sum(CASE WHEN ts > @minus_days(as_of; 1) AND ts >= date_trunc('month', as_of) THEN cost_usd ELSE 0e0 END) AS burn FROM {charges} CROSS JOIN lim GROUP BY region)
        SELECT region, round(spent, 4) AS spent, round(spent / 1000000e0, 6) AS used_pct, round(burn, 4) AS burn_per_day, CASE WHEN burn > 0 THEN round(greatest(0e0, 1000000e0 - spent) / burn, 4) END AS days_left FROM s"""),
    "a13_amplification": Query("""WITH a AS (SELECT l_suppkey AS source, sum(l_quantity) AS action_tokens FROM {lineitem} GROUP BY l_suppkey)
        SELECT s_suppkey AS source, round(coalesce(action_tokens, 0e0) / greatest(1e0, abs(s_acctbal)), 6) AS amplification, coalesce(action_tokens, 0e0) / greatest(1e0, abs(s_acctbal)) >= 10 AS flagged, coalesce(action_tokens, 0e0) >= 2000 AND coalesce(action_tokens, 0e0) / greatest(1e0, abs(s_acctbal)) >= 10 AS quarantined FROM {supplier} LEFT JOIN a ON source = s_suppkey WHERE s_acctbal > 0"""),
    "a14_identical_actions": Query("""WITH g AS (SELECT user_id, event_type, props, count(*) AS n, max(event_id) AS last_turn FROM {events} GROUP BY user_id, event_type, props HAVING count(*) >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, last_turn DESC) AS k FROM g)
        SELECT user_id, event_type, props, n, last_turn FROM r WHERE k = 1"""),
    "a15_model_quality": Query("""SELECT source, lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS accepted, round(avg(CAST(quality AS DOUBLE)), 6) AS acceptance, round(avg(n_chars / 1e3), 6) AS mean_cost, CASE WHEN avg(n_chars) > 0 THEN round(avg(CAST(quality AS DOUBLE)) / avg(n_chars / 1e3), 6) END AS quality_per_dollar FROM {labels} JOIN {documents} USING (doc_id) GROUP BY source, lang"""),
    "a16_subagent_quantiles": Query("""SELECT provider, percentile_disc(0.5) WITHIN GROUP (ORDER BY tokens_in) AS p50, percentile_disc(0.9) WITHIN GROUP (ORDER BY tokens_in) AS p90, round(avg(tokens_in), 4) AS mean_tokens, 4 * percentile_disc(0.9) WITHIN GROUP (ORDER BY tokens_in) AS proposed_p90 FROM {charges} GROUP BY provider"""),
    "a17_max_tokens": Query("""SELECT model, count(*) AS samples, CAST(ceil(percentile_disc(0.95) WITHIN GROUP (ORDER BY tokens_out) * 1.15e0 / 256e0) * 256 AS BIGINT) AS calibrated, round(sum(CASE WHEN tokens_out > 512 THEN 1e0 ELSE 0e0 END) / count(*), 6) AS truncated_at_512 FROM {charges} GROUP BY model HAVING count(*) >= 20"""),
    "a18_routing_ledger": Query("""SELECT c.provider, round(sum(""" + COST + """), 6) AS actual, round(sum((c.tokens_in * 3e0 + c.tokens_out * 15e0) / 1e6), 6) AS baseline, round(sum((c.tokens_in * 3e0 + c.tokens_out * 15e0) / 1e6) - sum(""" + COST + """), 6) AS saved FROM {charges} c JOIN {prices} p ON c.model = p.model GROUP BY c.provider"""),
    "a21_tool_error_rate": Query("""SELECT user_id, count(*) AS total, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 0 THEN 'insufficient_data' WHEN count(*) >= 4 AND sum(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END) / count(*) >= 0.5e0 THEN 'warn' ELSE 'ok' END AS verdict FROM {events} GROUP BY user_id"""),
    "a22_paired_outcomes": Query("""WITH p AS (SELECT c_nationkey AS task, avg(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_acctbal END) AS control, avg(CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN c_acctbal END) AS treatment FROM {customer} GROUP BY c_nationkey)
        SELECT count(*) AS pairs, round(avg(control), 4) AS control, round(avg(treatment), 4) AS treatment, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY control - treatment), 4) AS median_saving FROM p WHERE control IS NOT NULL AND treatment IS NOT NULL"""),
    "a23_dominant_model": Query("""WITH c AS (SELECT agent_id, model, count(*) AS n, min(charge_id) AS first_id FROM {charges} GROUP BY agent_id, model), r AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY n DESC, first_id, model) AS k FROM c) SELECT agent_id, model, n FROM r WHERE k = 1"""),
    "a24_overview": Query("""WITH lim AS (SELECT CAST(max(ts) AS DATE) AS today FROM {events}), d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS spend, count(*) AS n FROM {events} GROUP BY CAST(ts AS DATE)), k AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6)) AS o(i))
        SELECT @days(today; -i) AS day, round(coalesce(spend, 0e0), 4) AS spend, coalesce(n, 0) AS n FROM k CROSS JOIN lim LEFT JOIN d ON d.day = @days(today; -i)"""),
    "a25_fix_association": Query("""WITH a AS (SELECT l_partkey % 100 AS atom, l_returnflag FROM {lineitem}) SELECT atom, count(*) AS n, CASE WHEN count(*) >= 2 THEN round((sum(CASE WHEN l_returnflag = 'A' THEN 1e0 ELSE 0e0 END) + 1e0) / (count(*) + 2e0), 6) END AS posterior FROM a GROUP BY atom"""),
    "a27_bounty": Query("""WITH p AS (SELECT o_custkey % 20 AS bounty, o_orderkey AS id, o_custkey AS submitter, o_totalprice AS cost FROM {orders} WHERE o_orderstatus = 'F'), r AS (SELECT *, row_number() OVER (PARTITION BY bounty ORDER BY cost, submitter, id) AS k FROM p) SELECT bounty, id, submitter, cost FROM r WHERE k = 1"""),
    "a29_pareto": Query("""WITH p AS (SELECT p_partkey AS id, p_retailprice AS cost, p_size AS quality FROM {part}), c AS (SELECT cost, max(quality) AS q FROM p GROUP BY cost), r AS (SELECT cost, q, max(q) OVER (ORDER BY cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
        SELECT p.id, p.cost, p.quality FROM p JOIN r ON p.cost = r.cost AND p.quality = r.q WHERE r.before IS NULL OR r.q > r.before"""),
    "a31_decayed_utility": Query("""WITH t AS (SELECT user_id, event_type, @us(ts; max(ts) OVER (PARTITION BY user_id)) / 3.6e9 AS age_hours FROM {events}) SELECT user_id, count(*) AS n, round(sum(power(0.5e0, age_hours / 72e0)), 6) AS included, round(sum(CASE WHEN event_type = 'purchase' THEN power(0.5e0, age_hours / 72e0) ELSE 0e0 END), 6) AS contributed,
        CASE WHEN count(*) >= 3 THEN round((1e0 + sum(CASE WHEN event_type = 'purchase' THEN power(0.5e0, age_hours / 72e0) ELSE 0e0 END)) / (2e0 + sum(power(0.5e0, age_hours / 72e0))), 6) END AS posterior FROM t GROUP BY user_id"""),
}
