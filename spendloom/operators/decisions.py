"""Decisions: prices, caches, lanes, quotes, gates, allowances and statistics (one projection each, over aggregates where they need them)."""

from ..plans.dialect import Query

_PRICED = "FROM {charges} c LEFT JOIN {prices} p ON c.model = p.model"
_ARMS = "SELECT CAST(sum(CASE WHEN source < 'src15' THEN 1 ELSE 0 END) AS DOUBLE) AS n1, CAST(sum(CASE WHEN source < 'src15' THEN quality ELSE 0 END) AS DOUBLE) AS k1, CAST(sum(CASE WHEN source >= 'src15' THEN 1 ELSE 0 END) AS DOUBLE) AS n2, CAST(sum(CASE WHEN source >= 'src15' THEN quality ELSE 0 END) AS DOUBLE) AS k2 FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"

QUERIES = {
    "f1_event_cost": Query("SELECT c.charge_id, c.task_id, round((greatest(0, c.tokens_in - c.tokens_cached) * p.in_usd + c.tokens_cached * coalesce(p.cached_usd, p.in_usd) + c.tokens_out * p.out_usd) / 1e6, 8) AS cost " + _PRICED),
    "f4_context_window": Query("SELECT c.model, count(*) AS n, max(CASE WHEN p.context > 0 THEN p.context END) AS context " + _PRICED + " GROUP BY c.model"),
    "f7_cache_economics": Query("SELECT c.charge_id, round(c.tokens_in * p.in_usd * 1.25e0 / 1e6, 8) AS write_usd, round(c.tokens_cached * (p.in_usd - coalesce(p.cached_usd, 0.1e0 * p.in_usd)) / 1e6, 8) AS read_saving_usd, round(c.tokens_in * p.in_usd / 1e6, 8) AS fresh_usd " + _PRICED),
    "f8_choose_ttl": Query("""WITH r AS (SELECT user_id, count(*) AS n, @us(min(ts); max(ts)) / 3.6e9 AS hours FROM {events} GROUP BY user_id)
        SELECT user_id, round(CASE WHEN hours > 0 THEN n / hours ELSE 0e0 END, 6) AS reads_per_hour, CASE WHEN hours > 0 AND n / hours >= 12 THEN '1h' ELSE '5m' END AS ttl FROM r"""),
    "f12_batch_lane": Query("""SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'interactive' WHEN o_totalprice < 1000 THEN 'no_slack' ELSE 'batch' END AS lane,
        round(o_totalprice * CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_totalprice < 1000 THEN 1e0 ELSE 0.5e0 END, 4) AS price FROM {orders}"""),
    "f13_futures_quote": Query("SELECT l_orderkey, l_linenumber, l_discount > 0 AND @us(o_orderdate; l_shipdate) >= 3600000000 AS eligible, round(CASE WHEN l_discount > 0 AND @us(o_orderdate; l_shipdate) >= 3600000000 THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END, 4) AS quote FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"),
    "f15_waterbed_net": Query("""WITH g AS (SELECT c.provider, sum(c.tokens_cached * p.in_usd) / 1e6 AS gross, CASE WHEN count(p.cached_usd) = count(*) THEN sum(c.tokens_out * p.cached_usd) / 1e6 END AS moved FROM {charges} c LEFT JOIN {prices} p ON c.model = p.model WHERE c.region IN ('ASIA', 'EUROPE') GROUP BY c.provider)
        SELECT provider, round(gross, 4) AS gross, round(gross - moved, 4) AS net, coalesce(gross - moved > 0.01e0, false) AS approved FROM g"""),
    # Doubles are added in order of event_id, so that the sum, and with it ties of the two costs, does not depend on how the table is split.
    "f16_retry_or_reframe": Query("""WITH e AS (SELECT user_id, event_id, event_type, value FROM {events} DISTRIBUTE BY user_id SORT BY user_id, event_id, value), s AS (SELECT user_id, count(*) AS n, (sum(CASE WHEN event_type = 'purchase' THEN 1e0 ELSE 0e0 END) + 1e0) / (count(*) + 2e0) AS p_retry, (sum(CASE WHEN event_type = 'view' THEN 1e0 ELSE 0e0 END) + 1e0) / (count(*) + 2e0) AS p_reframe, avg(value) AS cost FROM e GROUP BY user_id)
        SELECT user_id, round(cost / p_retry, 4) AS retry_cost, round(1.5e0 * cost / p_reframe, 4) AS reframe_cost, CASE WHEN 1.5e0 * cost / p_reframe < 0.9e0 * cost / p_retry THEN 'reframe' ELSE 'retry' END AS advice FROM s""",
        own="""WITH s AS (SELECT user_id, count(*) AS n, (sum(CASE WHEN event_type = 'purchase' THEN 1e0 ELSE 0e0 END) + 1e0) / (count(*) + 2e0) AS p_retry, (sum(CASE WHEN event_type = 'view' THEN 1e0 ELSE 0e0 END) + 1e0) / (count(*) + 2e0) AS p_reframe, avg(value) AS cost FROM {events} GROUP BY user_id)
        SELECT user_id, round(cost / p_retry, 4) AS retry_cost, round(1.5e0 * cost / p_reframe, 4) AS reframe_cost, CASE WHEN 1.5e0 * cost / p_reframe < 0.9e0 * cost / p_retry THEN 'reframe' ELSE 'retry' END AS advice FROM s"""),
    "f17_cache_reconcile": Query("""WITH r AS (SELECT agent_id, sum(tokens_cached) AS observed, sum(tokens_out) AS claimed FROM {charges} GROUP BY agent_id)
        SELECT agent_id, CASE WHEN claimed = 0 THEN 'no_claim' WHEN observed = 0 THEN 'stranded' WHEN CAST(observed AS DOUBLE) / claimed < 0.8e0 THEN 'below' WHEN CAST(observed AS DOUBLE) / claimed > 1.2e0 THEN 'above' ELSE 'match' END AS verdict, CAST(CASE WHEN observed = 0 THEN claimed ELSE 0 END AS BIGINT) AS stranded FROM r"""),
    "f18_ttl_regression": Query("""WITH g AS (SELECT user_id, @us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id); ts) / 1e6 AS gap FROM {events})
        SELECT user_id, round(max(gap), 3) AS observed_s, max(gap) < 3600e0 * 0.9e0 AS regressed FROM g WHERE gap IS NOT NULL GROUP BY user_id"""),
    "f22_should_spend": Query("SELECT p_partkey, CASE WHEN p_size IS NULL OR p_retailprice IS NULL THEN 'abstain' WHEN p_size * 50e0 >= 1.2e0 * p_retailprice THEN 'spend' ELSE 'hold' END AS decision FROM {part}"),
    "f24_cost_model": Query("""WITH b AS (SELECT covar_pop(cost_usd, CAST(tokens_in AS DOUBLE)) / var_pop(CAST(tokens_in AS DOUBLE)) AS slope FROM {charges}), r0 AS (SELECT c.model, c.nation, c.cost_usd - b.slope * c.tokens_in AS r FROM {charges} c CROSS JOIN b),
        m AS (SELECT model, avg(r) AS by_model FROM r0 GROUP BY model), r1 AS (SELECT r0.model, r0.nation, r0.r - m.by_model AS r, m.by_model FROM r0 JOIN m ON r0.model = m.model), n AS (SELECT nation, avg(r) AS by_nation FROM r1 GROUP BY nation HAVING count(*) >= 20)
        SELECT r1.model, r1.nation, round(max(r1.by_model), 3) AS by_model, round(max(coalesce(n.by_nation, 0e0)), 3) AS by_nation, round(avg(abs(r1.r - coalesce(n.by_nation, 0e0))), 3) AS mae FROM r1 LEFT JOIN n ON r1.nation = n.nation GROUP BY r1.model, r1.nation"""),
    "f29_allowance_split": Query("""WITH w AS (SELECT n_regionkey AS pool, n_name AS id, n_nationkey + 1 AS weight, sum(n_nationkey + 1) OVER (PARTITION BY n_regionkey) AS total FROM {nation}), s AS (SELECT *, CAST(floor(1000e0 * weight / total) AS BIGINT) AS share FROM w),
        r AS (SELECT *, 1000 - sum(share) OVER (PARTITION BY pool) AS rest, row_number() OVER (PARTITION BY pool ORDER BY id) AS k FROM s) SELECT pool, id, CAST(share + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS units FROM r"""),
    "f32_compaction_test": Query("""WITH s AS (SELECT conv_id, sum(tokens) AS before, sum(CASE WHEN role <> 'assistant' THEN tokens ELSE 0 END) AS kept FROM {turns} GROUP BY conv_id)
        SELECT conv_id, CASE WHEN before > 0 THEN round(1e0 - CAST(kept AS DOUBLE) / before, 6) END AS reduction, before > 0 AND 2 * kept <= before AS passes FROM s"""),
    "q1_normal_cdf": Query("""WITH m AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM {events}), z AS (SELECT event_id, (value - mu) / sd AS z FROM {events} CROSS JOIN m), t AS (SELECT event_id, z, 1e0 / (1e0 + 0.3275911e0 * abs(z) / sqrt(2e0)) AS t FROM z)
        SELECT event_id, round(0.5e0 * (1e0 + CASE WHEN z < 0 THEN -1e0 ELSE 1e0 END * (1e0 - ((((1.061405429e0 * t - 1.453152027e0) * t + 1.421413741e0) * t - 0.284496736e0) * t + 0.254829592e0) * t * exp(-z * z / 2e0))), 6) AS cdf FROM t"""),
    "q4_non_inferiority": Query("WITH a AS (" + _ARMS + """), p AS (SELECT n1, n2, k1 / n1 AS p1, k2 / n2 AS p2 FROM a WHERE n1 > 0 AND n2 > 0), s AS (SELECT *, sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) AS se FROM p)
        SELECT round(p1 - p2, 6) AS diff, CASE WHEN se > 0 THEN round((p1 - p2 + 0.05e0) / se, 6) END AS z, CASE WHEN se > 0 THEN (p1 - p2 + 0.05e0) / se >= 1.6448536269514722e0 ELSE p1 - p2 + 0.05e0 > 0 END AS passes FROM s"""),
    "q5_wilcoxon": Query("""WITH d AS (SELECT s_suppkey AS id, round(s_acctbal - avg(s_acctbal) OVER (), 2) AS d FROM {supplier}), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY abs(d)) AS ties FROM d WHERE d <> 0),
        s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0e0 END) AS w, sum(CAST(ties AS DOUBLE) * ties - 1e0) AS tie FROM r)
        SELECT n, w, round((w - n * (n + 1) / 4 - CASE WHEN w > n * (n + 1) / 4 THEN 0.5e0 WHEN w < n * (n + 1) / 4 THEN -0.5e0 ELSE 0e0 END) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48), 6) AS z FROM s WHERE n > 0"""),
    "q6_sample_size": Query("WITH a AS (" + _ARMS + ") SELECT CAST(ceil(power(1.6448536269514722e0 + 0.8416212335729143e0, 2) * (k1 / n1 * (1 - k1 / n1) + k2 / n2 * (1 - k2 / n2)) / power(0.05e0, 2)) AS BIGINT) AS n FROM a WHERE n1 > 0 AND n2 > 0"),
    "a19_replay_cost": Query("""WITH s AS (SELECT conv_id, sum(CASE WHEN role <> 'assistant' THEN tokens ELSE 0 END) AS tin, sum(CASE WHEN role = 'assistant' THEN tokens ELSE 0 END) AS tout, sum(CASE WHEN turn < 2 THEN tokens ELSE 0 END) AS shared FROM {turns} GROUP BY conv_id)
        SELECT conv_id, round((tin * 3e0 + tout * 15e0) / 1e6, 8) AS naive, round((shared * 0.3e0 + greatest(0, tin - shared) * 3e0 + tout * 15e0) / 1e6, 8) AS replay FROM s"""),
    "a20_navigation": Query("""WITH t AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC) AS k FROM {events}), r AS (SELECT user_id, event_type, props, count(DISTINCT CAST(ts AS DATE)) AS days FROM t WHERE k <= 4 GROUP BY user_id, event_type, props),
        v AS (SELECT user_id, sum(CASE WHEN days >= 2 THEN 1 ELSE 0 END) AS revisits FROM r GROUP BY user_id), n AS (SELECT user_id, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) AS nav, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS mut, max(k) AS turns FROM t WHERE k <= 4 GROUP BY user_id)
        SELECT n.user_id, CAST(nav AS BIGINT) AS nav, CAST(mut AS BIGINT) AS mut, CAST(revisits AS BIGINT) AS revisits, mut = 0 AND nav >= 5 AND revisits >= 1 AND turns >= 2 AS warns FROM n JOIN v ON n.user_id = v.user_id"""),
    "a26_marginal_value": Query("SELECT CASE WHEN quality IS NULL THEN 'unprobed' WHEN quality = 0 THEN 'zero' ELSE 'contributing' END AS class, count(*) AS n, CAST(sum(CASE WHEN quality = 0 THEN n_chars ELSE 0 END) AS BIGINT) AS wasted FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY CASE WHEN quality IS NULL THEN 'unprobed' WHEN quality = 0 THEN 'zero' ELSE 'contributing' END"),
    "a28_library_saving": Query("WITH u AS (SELECT l_partkey, count(*) AS uses FROM {lineitem} GROUP BY l_partkey) SELECT p_brand, CAST(sum(uses) AS BIGINT) AS uses, CAST(sum(p_size * 100 * uses) AS BIGINT) AS tokens, round(sum(p_size * 100 * uses) * 3e0 / 1e6, 6) AS usd FROM {part} JOIN u ON p_partkey = l_partkey GROUP BY p_brand"),
    "a30_batch_count": Query("WITH s AS (SELECT conv_id, sum(tokens) AS tokens FROM {turns} GROUP BY conv_id) SELECT conv_id, CAST(tokens AS BIGINT) AS tokens, CASE WHEN tokens > 5 * 100 THEN 'abort' WHEN tokens > 100 THEN 'squeeze' ELSE 'proceed' END AS decision FROM s"),
    "a32_known_spans": Query("""WITH k AS (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) - sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS margin FROM {lineitem} GROUP BY l_partkey)
        SELECT p_partkey, coalesce(margin, 0) >= 1 AS stub, CAST(CASE WHEN coalesce(margin, 0) >= 1 THEN greatest(0, p_size - 8) ELSE 0 END AS BIGINT) AS saved FROM {part} LEFT JOIN k ON p_partkey = l_partkey"""),
    "w11_large_result": Query("SELECT conv_id, max(tokens) AS largest, max_by(role, tokens * 100000 - turn) AS role, max(tokens) >= 0.15e0 * 2000 AS cause FROM {turns} GROUP BY conv_id"),
    "w20_step_novelty": Query("""WITH s AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) - 1 AS prior, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {events})
        SELECT event_id, round(1e0 / (1 + prior), 6) AS novelty, CASE WHEN n > 1 THEN round(CAST(i AS DOUBLE) / (n - 1), 6) ELSE 0e0 END AS position FROM s"""),
    "x4_trailing_day": Query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '24' HOUR PRECEDING AND CURRENT ROW), 3) AS spend, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '24' HOUR PRECEDING AND CURRENT ROW) AS n FROM {events}"),
    "k2_page_ascending": Query("SELECT event_id, ts FROM {events} WHERE ts > TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts, event_id LIMIT 100"),
    "k3_order_by_name": Query("SELECT n_nationkey, n_name FROM {nation} ORDER BY n_name"),
    "k6_retention": Query("""WITH u AS (SELECT l_partkey, count(*) AS uses, max(l_shipdate) AS used FROM {lineitem} GROUP BY l_partkey), r AS (SELECT *, row_number() OVER (ORDER BY uses DESC, used DESC, l_partkey) AS k FROM u WHERE used >= TIMESTAMP '1995-01-01 00:00:00')
        SELECT l_partkey, uses FROM r WHERE k <= 50"""),
    "e2_union_all": Query("SELECT 'customer' AS side, c_nationkey AS nation, count(*) AS n FROM {customer} GROUP BY c_nationkey UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM {supplier} GROUP BY s_nationkey"),
    "e4_set_operations": Query("""SELECT 'both' AS side, x FROM (SELECT c_nationkey AS x FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) a UNION ALL SELECT 'only_customers', x FROM (SELECT c_nationkey AS x FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier}) b
        UNION ALL SELECT 'either', x FROM (SELECT c_nationkey AS x FROM {customer} UNION SELECT s_nationkey FROM {supplier}) c"""),
    "e1_set_overlap": Query("""WITH s AS (SELECT DISTINCT s_nationkey AS a, l_partkey AS x FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey), z AS (SELECT a, count(*) AS n FROM s GROUP BY a), i AS (SELECT p.a, q.a AS b, count(*) AS both_n FROM s p JOIN s q ON p.x = q.x AND p.a < q.a GROUP BY p.a, q.a)
        SELECT i.a, i.b, both_n, u.n - both_n AS only_a, v.n - both_n AS only_b, round(CAST(both_n AS DOUBLE) / (u.n + v.n - both_n), 6) AS jaccard FROM i JOIN z u ON i.a = u.a JOIN z v ON i.b = v.a"""),
    "t5_text_similarity": Query("""WITH p AS (SELECT conv_id, turn, text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {conversations}), w AS (SELECT conv_id, turn, @wordset(text) AS w FROM {conversations}), n AS (SELECT conv_id, turn, count(*) AS n FROM w GROUP BY conv_id, turn),
        i AS (SELECT p.conv_id, p.turn, count(*) AS both_n FROM p JOIN w a ON p.conv_id = a.conv_id AND p.turn = a.turn JOIN w b ON p.conv_id = b.conv_id AND p.before = b.turn AND a.w = b.w GROUP BY p.conv_id, p.turn)
        SELECT p.conv_id, p.turn, round(coalesce(CAST(both_n AS DOUBLE), 0e0) / (a.n + b.n - coalesce(both_n, 0)), 6) AS words FROM p JOIN n a ON p.conv_id = a.conv_id AND p.turn = a.turn JOIN n b ON p.conv_id = b.conv_id AND p.before = b.turn LEFT JOIN i ON p.conv_id = i.conv_id AND p.turn = i.turn"""),
    "t7_text_equivalence": Query("""WITH p AS (SELECT p_partkey, p_name, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before FROM {part})
        SELECT p_partkey, CAST(@lev(p_name; before) AS BIGINT) AS distance, @lev(p_name; before) <= 0.05e0 * greatest(length(p_name), length(before)) AS same FROM p WHERE before IS NOT NULL"""),
    "t15_error_lines": Query("SELECT conv_id, turn, CAST(@matches(text; '[A-Za-z]*(Error|Exception):') AS BIGINT) AS errors, CAST(@matches(text; '[0-9]+-[0-9]+-[0-9]+') AS BIGINT) AS dates FROM {conversations} WHERE text IS NOT NULL"),
    "t20_reference_number": Query("SELECT page_id, regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS number FROM {pages} WHERE url IS NOT NULL"),
    "t24_verb_intent": Query("SELECT CASE WHEN event_type IN ('view', 'click') THEN 'read' WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'other' END AS intent, count(*) AS n, count(DISTINCT event_type) AS tools FROM {events} GROUP BY CASE WHEN event_type IN ('view', 'click') THEN 'read' WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'other' END"),
}
