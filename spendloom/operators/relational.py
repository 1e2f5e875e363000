"""Filters, joins, sorts, sets, decisions, statistics and text scores."""

from ..plans.dialect import Query

_WORDS = "SELECT doc_id, @wordset(text) AS w FROM {documents}"

_UP = """parents AS (SELECT n_name AS child, r_name AS parent FROM {nation} JOIN {region} ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'fleet' FROM {region}), up AS (SELECT child AS base, child AS envelope, 0 AS hops FROM parents UNION ALL SELECT up.base, p.parent, up.hops + 1 FROM up JOIN parents p ON p.child = up.envelope WHERE up.hops < 16)"""

QUERIES = {
    "p1_point_lookup": Query("SELECT s_suppkey, s_name, s_acctbal FROM {supplier} WHERE s_suppkey = 7 LIMIT 1"),
    "p2_time_range": Query("SELECT event_id, ts FROM {events} WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'"),
    "p3_keyset_page": Query("SELECT event_id, ts FROM {events} WHERE ts > TIMESTAMP '2024-01-10 00:00:00' OR (ts = TIMESTAMP '2024-01-10 00:00:00' AND event_id > 100) ORDER BY ts, event_id LIMIT 100"),
    "p4_dimension_filter": Query("SELECT charge_id, cost_usd FROM {charges} WHERE provider = 'BUILDING' AND model = 'NO'"),
    "p10_feature_enabled": Query("WITH f AS (SELECT * FROM (VALUES ('click', true, 'general'), ('view', true, 'shadow'), ('purchase', true, 'canary'), ('error', false, 'general')) AS f(feature, enabled, mode)) SELECT event_id FROM {events} JOIN f ON event_type = feature WHERE enabled AND mode IN ('general', 'canary')"),
    "j1_use_result": Query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text DESC) AS k FROM {conversations} WHERE role = 'assistant') SELECT u.conv_id, u.turn, CASE WHEN r.text IS NULL THEN 'active' WHEN length(r.text) < 60 THEN 'errored' ELSE 'completed' END AS status FROM {conversations} u LEFT JOIN r ON u.conv_id = r.conv_id AND r.turn = u.turn + 1 AND r.k = 1 WHERE u.role = 'user'"""),
    "j2_strict_price": Query("SELECT c.charge_id, CASE WHEN p.model IS NULL THEN NULL ELSE round((greatest(0, c.tokens_in - c.tokens_cached) * p.in_usd + c.tokens_cached * coalesce(p.cached_usd, p.in_usd) + c.tokens_out * p.out_usd) / 1e6, 9) END AS cost FROM {charges} c LEFT JOIN {prices} p ON c.model = p.model"),
    "g2_lenient_price": Query("SELECT c.charge_id, round((c.tokens_in * coalesce(p.in_usd, 3e0) + c.tokens_out * coalesce(p.out_usd, 15e0)) / 1e6, 9) AS cost, p.model IS NOT NULL AS exact FROM {charges} c LEFT JOIN {prices} p ON c.model = p.model"),
    "j4_lost_entities": Query("SELECT DISTINCT a.p_brand, a.p_type FROM {part} a LEFT ANTI JOIN (SELECT p_brand, p_type FROM {part} WHERE p_size > 25) b ON a.p_brand = b.p_brand AND lower(a.p_type) = lower(b.p_type)", own="SELECT DISTINCT p_brand, p_type FROM {part} a WHERE NOT EXISTS (SELECT 1 FROM {part} b WHERE b.p_size > 25 AND a.p_brand = b.p_brand AND lower(a.p_type) = lower(b.p_type))"),
    "j5_surviving_edges": Query("SELECT src, dst FROM {edges} e LEFT SEMI JOIN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal > 0) s ON e.src = s.s_suppkey LEFT SEMI JOIN (SELECT p_partkey + 1000000000000 AS node FROM {part} WHERE p_size >= 10) p ON e.dst = p.node",
        own="SELECT src, dst FROM {edges} WHERE src IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal > 0) AND dst - 1000000000000 IN (SELECT p_partkey FROM {part} WHERE p_size >= 10)"),
    "j6_symbol_edges": Query("SELECT DISTINCT a.l_suppkey AS src, b.ps AS dst FROM {lineitem} a JOIN (SELECT l_partkey AS pk, min(l_suppkey) AS ps FROM {lineitem} GROUP BY l_partkey) b ON a.l_partkey = b.pk WHERE a.l_suppkey <> b.ps"),
    "j8_skill_overlap": Query(f"""WITH w AS ({_WORDS}), q AS (SELECT item_id, @wordset(text) AS w FROM {{benchmark}}), nd AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), nq AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id), c AS (SELECT /*+ BROADCAST(q) */ item_id, doc_id, count(*) AS c FROM q JOIN w ON q.w = w.w GROUP BY item_id, doc_id),
        s AS (SELECT /*+ BROADCAST(nq) */ c.item_id, c.doc_id, CAST(c AS DOUBLE) / (nd.n + nq.n - c) AS sim FROM c JOIN nd ON c.doc_id = nd.doc_id JOIN nq ON c.item_id = nq.item_id), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, doc_id) AS k FROM s WHERE sim >= 0.5e0) SELECT item_id, doc_id, round(sim, 6) AS sim FROM r WHERE k <= 5""", own=f"""WITH w AS ({_WORDS}), q AS (SELECT item_id, @wordset(text) AS w FROM {{benchmark}}), nd AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), nq AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id), c AS (SELECT item_id, doc_id, count(*) AS c FROM q JOIN w ON q.w = w.w GROUP BY item_id, doc_id),
        s AS (SELECT c.item_id, c.doc_id, CAST(c AS DOUBLE) / (nd.n + nq.n - c) AS sim FROM c JOIN nd ON c.doc_id = nd.doc_id JOIN nq ON c.item_id = nq.item_id), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, doc_id) AS k FROM s WHERE sim >= 0.5e0) SELECT item_id, doc_id, round(sim, 6) AS sim FROM r WHERE k <= 5""", texts=("documents",)),
    "j10_divergence": Query("SELECT coalesce(a.user_id, b.user_id - 1) AS pair, min(CASE WHEN a.event_type IS NULL OR b.event_type IS NULL OR a.event_type <> b.event_type THEN coalesce(a.i, b.i) END) AS diverges_at FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {events} WHERE user_id % 2 = 0) a FULL JOIN (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {events} WHERE user_id % 2 = 1) b ON a.user_id = b.user_id - 1 AND a.i = b.i GROUP BY coalesce(a.user_id, b.user_id - 1)"),
    "j11_ancestor_charges": Query("WITH RECURSIVE " + _UP + """, c AS (SELECT nation, sum(CAST(cost_usd AS DECIMAL(18, 4))) AS cost, count(*) AS n FROM {charges} GROUP BY nation)
        SELECT envelope, hops, CAST(sum(cost) AS DOUBLE) AS cost, sum(n) AS n FROM c JOIN up ON nation = base GROUP BY envelope, hops""", own="WITH RECURSIVE " + _UP + """
        SELECT envelope, hops, CAST(sum(CAST(cost_usd AS DECIMAL(18, 4))) AS DOUBLE) AS cost, count(*) AS n FROM {charges} JOIN up ON nation = base GROUP BY envelope, hops"""),
    "k1_latest": Query("SELECT event_id, ts FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 100"),
    "k4_top_by_group": Query("WITH r AS (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM {customer}) SELECT c_mktsegment, c_custkey, c_acctbal, CAST(k AS BIGINT) AS k FROM r WHERE k <= 10"),
    "k5_lru": Query("WITH lim AS (SELECT max(ts) AS now FROM {events}), l AS (SELECT user_id, event_type, max(ts) AS hit, min(ts) AS made FROM {events} GROUP BY user_id, event_type), r AS (SELECT user_id, event_type, hit, made FROM l CROSS JOIN lim WHERE hit >= @minus_days(now; 7)) SELECT user_id, event_type, hit FROM r ORDER BY hit DESC, made DESC, user_id, event_type LIMIT 50"),
    "k7_offset": Query("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40"),
    "e3_keep_first": Query("WITH r AS (SELECT event_id, user_id, props, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) AS k FROM {events}) SELECT event_id, user_id, props FROM r WHERE k = 1"),
    "f3_detect_provider": Query("SELECT p_partkey, CASE WHEN p_type LIKE 'STANDARD%' THEN 'anthropic' WHEN p_type LIKE 'PROMO%' THEN 'google' ELSE 'openai' END AS provider FROM {part}"),
    "f10_prefix_alignment": Query("SELECT charge_id, CASE WHEN tokens_in < 1024 THEN 0 ELSE 1024 + CAST(floor((tokens_in - 1024) / 128e0) AS BIGINT) * 128 END AS aligned FROM {charges}"),
    "f20_budget_decision": Query("WITH s AS (SELECT agent_id, sum(cost_usd) AS spent FROM {charges} GROUP BY agent_id) SELECT agent_id, CASE WHEN spent > 2000000e0 THEN 'block' WHEN spent > 1500000e0 THEN 'warn' ELSE 'allow' END AS decision FROM s"),
    "f21_slo_breaker": Query("WITH s AS (SELECT provider, sum(greatest(0e0, cost_usd - 60000e0)) AS excess FROM {charges} GROUP BY provider) SELECT provider, CASE WHEN 10000000e0 - excess <= 0 THEN 'block' WHEN 10000000e0 - excess <= 5000000e0 THEN 'warn' ELSE 'allow' END AS decision FROM s"),
    "f30_periods": Query("SELECT event_id, date_trunc('day', ts) AS day_start, date_trunc('week', ts) AS week_start, date_trunc('month', ts) AS month_start FROM {events}"),
    "q2_mcnemar": Query("""WITH c AS (SELECT sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1e0 ELSE 0e0 END) AS b, sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1e0 ELSE 0e0 END) AS c FROM {labels}) SELECT b, c, CASE WHEN b + c >= 25 THEN round(power(greatest(0e0, abs(b - c) - 1e0), 2e0) / (b + c), 6) END AS chi2 FROM c"""),
    "q3_two_proportions": Query("""WITH s AS (SELECT sum(CASE WHEN lang = 'en' THEN 1e0 ELSE 0e0 END) AS n1, sum(CASE WHEN lang = 'en' THEN CAST(quality AS DOUBLE) ELSE 0e0 END) AS x1, sum(CASE WHEN lang <> 'en' THEN 1e0 ELSE 0e0 END) AS n2, sum(CASE WHEN lang <> 'en' THEN CAST(quality AS DOUBLE) ELSE 0e0 END) AS x2 FROM {labels} JOIN {documents} USING (doc_id))
        SELECT n1, n2, round((x1 / n1 - x2 / n2) / sqrt(((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 6) AS z FROM s"""),
    "t1_token_estimate": Query("SELECT doc_id, CAST(ceil(length(text) / 4e0) AS BIGINT) AS tokens, CAST(ceil(length(text) / 3e0) AS BIGINT) AS code_tokens FROM {documents}"),
    "t18_freshness": Query("SELECT doc_id, @sha(text) AS digest FROM {documents}"),
    "r5_in_degree": Query("SELECT dst, count(DISTINCT src) AS in_degree FROM {edges} GROUP BY dst"),
    "r7_keyword_search": Query(f"""WITH w AS ({_WORDS}), q AS (SELECT item_id, @wordset(text) AS w FROM {{benchmark}}), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id), s AS (SELECT /*+ BROADCAST(q) */ q.item_id, w.doc_id, count(*) AS c FROM q JOIN w ON q.w = w.w GROUP BY q.item_id, w.doc_id),
        r AS (SELECT /*+ BROADCAST(n) */ s.item_id, doc_id, CAST(c AS DOUBLE) / n AS score, row_number() OVER (PARTITION BY s.item_id ORDER BY CAST(c AS DOUBLE) / n DESC, doc_id) AS k FROM s JOIN n ON s.item_id = n.item_id) SELECT item_id, doc_id, round(score, 6) AS score FROM r WHERE k <= 10""", own=f"""WITH w AS ({_WORDS}), q AS (SELECT item_id, @wordset(text) AS w FROM {{benchmark}}), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id), s AS (SELECT q.item_id, w.doc_id, count(*) AS c FROM q JOIN w ON q.w = w.w GROUP BY q.item_id, w.doc_id),
        r AS (SELECT s.item_id, doc_id, CAST(c AS DOUBLE) / n AS score, row_number() OVER (PARTITION BY s.item_id ORDER BY CAST(c AS DOUBLE) / n DESC, doc_id) AS k FROM s JOIN n ON s.item_id = n.item_id) SELECT item_id, doc_id, round(score, 6) AS score FROM r WHERE k <= 10""", texts=("documents",)),
    "x3_tumbling": Query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS spend FROM {events} GROUP BY CAST(ts AS DATE), event_type"),
    "s18_churn": Query("SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS commits FROM {lineitem} GROUP BY l_partkey"),
}
