"""Gates and audits: budget verdicts, cache-habit lint, tool-definition audit, masking, detectors, guards, forecasts, exports."""

from ..plans.dialect import Query

#: Proposed actions of a session with what came before them. A customer is a session, a line item an action.
_ACTIONS = """a AS (SELECT o_custkey AS session, l_orderkey * 10 + l_linenumber AS action, l_shipdate AS ts, concat(l_returnflag, l_linestatus) AS model, CAST(l_quantity AS BIGINT) * 100 AS prompt_tokens, o_orderpriority AS tools, l_linenumber AS servers,
    CASE WHEN l_discount >= 0.07 THEN '1h' WHEN l_discount >= 0.02 THEN '5m' ELSE 'none' END AS ttl, 5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS effort, l_tax AS temperature, CAST(floor(l_extendedprice / 10) AS BIGINT) AS pasted, CASE WHEN l_linenumber = 1 THEN 'unknown' WHEN l_linenumber = 2 THEN 'url' ELSE 'editor' END AS paste_source,
    CASE WHEN l_linestatus = 'O' THEN 'stateful' ELSE 'stateless' END AS transport, CAST(floor(l_extendedprice) AS BIGINT) AS cache_tokens, CASE WHEN l_returnflag = 'A' THEN 1024 ELSE 4096 END AS least FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey),
  s AS (SELECT *, row_number() OVER w AS turns, lag(ts) OVER w AS ts0, lag(model) OVER w AS model0, lag(prompt_tokens) OVER w AS prompt0, lag(tools) OVER w AS tools0, lag(servers) OVER w AS servers0, lag(ttl) OVER w AS ttl0, lag(effort) OVER w AS effort0, lag(temperature) OVER w AS temperature0, lag(transport) OVER w AS transport0, lag(cache_tokens) OVER w AS cache0
    FROM a WINDOW w AS (PARTITION BY session ORDER BY ts, action, model, prompt_tokens, cache_tokens, pasted, ttl, temperature)),
  m AS (SELECT *, CASE WHEN model <> model0 THEN 1 ELSE 0 END AS c_model, CASE WHEN tools <> tools0 THEN 1 ELSE 0 END AS c_tools, CASE WHEN prompt_tokens <> prompt0 THEN 1 ELSE 0 END AS c_prompt, CASE WHEN servers <> servers0 THEN 1 ELSE 0 END AS c_servers, CASE WHEN ttl <> ttl0 AND ttl <> 'none' AND ttl0 <> 'none' THEN 1 ELSE 0 END AS c_ttl FROM s)"""
_RULES = {
    "CH-001": "c_model = 1", "CH-002": "prompt_tokens < least", "CH-003": "pasted >= least AND paste_source <> 'editor'", "CH-004": "ttl0 <> 'none' AND @us(ts0; ts) / 1e6 > CASE WHEN ttl0 = '1h' THEN 3600 ELSE 300 END",
    "CH-005": "c_tools = 1", "CH-006": "c_prompt = 1", "CH-007": "c_servers = 1", "CH-008": "c_ttl = 1", "CH-009": "effort > effort0", "CH-010": "temperature <> temperature0", "CH-011": "paste_source = 'unknown'",
    "CH-012": "c_model + c_tools + c_prompt + c_servers + c_ttl >= 2 AND cache0 >= least", "CH-013": "transport0 = 'stateful' AND transport = 'stateless'", "CH-014": "transport = 'stateless' AND turns >= 10 AND cache0 >= least",
}
_INFO = ("CH-002", "CH-009", "CH-010", "CH-014")
_WARN = " OR ".join(f"({r})" for k, r in _RULES.items() if k not in _INFO)
_WASTE = "coalesce(CASE WHEN c_model = 1 THEN cache0 END, 0) + CASE WHEN pasted >= least AND paste_source <> 'editor' THEN pasted ELSE 0 END + coalesce(CASE WHEN c_tools + c_servers >= 1 THEN cache0 END, 0) + coalesce(CASE WHEN transport0 = 'stateful' AND transport = 'stateless' THEN cache0 END, 0)"

_BUDGETS = """e AS (SELECT n_nationkey, n_name, 0.95e0 + 0.15e0 * n_regionkey AS share, 0.75e0 AS soft, 1e0 AS hard, TIMESTAMP '1995-01-01 00:00:00' AS starts, CASE WHEN r_name = 'AFRICA' THEN TIMESTAMP '1995-12-31 00:00:00' ELSE TIMESTAMP '1996-12-31 00:00:00' END AS ends FROM {nation} JOIN {region} ON n_regionkey = r_regionkey),
  c AS (SELECT nation, ts, CAST(floor(cost_usd * 100 + 0.5e0) AS BIGINT) AS cents FROM {charges} WHERE ts >= TIMESTAMP '1995-01-01 00:00:00' AND ts <= TIMESTAMP '1996-06-30 00:00:00'),
  g AS (SELECT e.n_name, e.share, e.soft, e.hard, e.ends, CAST(coalesce(sum(CASE WHEN c.ts <= e.ends THEN c.cents END), 0) AS DOUBLE) / 100 AS spent, CAST(coalesce(sum(CASE WHEN c.ts > TIMESTAMP '1996-05-31 00:00:00' AND c.ts <= e.ends THEN c.cents END), 0) AS DOUBLE) / 3000 AS burn FROM e LEFT JOIN c ON e.n_name = c.nation GROUP BY e.n_name, e.share, e.soft, e.hard, e.ends),
  b AS (SELECT *, share * 1.2e0 * (SELECT avg(spent) FROM g) AS limit_usd FROM g), d AS (SELECT *, spent + 0.01e0 * limit_usd AS after_call, ends < TIMESTAMP '1996-06-30 00:00:00' AS expired, CASE WHEN burn > 0 THEN greatest(0e0, limit_usd - spent) / burn END AS days_left FROM b),
  w AS (SELECT *, CASE WHEN NOT expired AND after_call <= limit_usd * hard THEN concat_ws(',', CASE WHEN after_call > limit_usd * soft THEN 'soft_cap' END, CASE WHEN days_left * 86400e6 < @us(TIMESTAMP '1996-06-30 00:00:00'; ends) THEN 'burn_rate' END) ELSE '' END AS warnings FROM d)"""

_FILL = ") IGNORE NULLS OVER"
_W9 = """WITH e AS (SELECT user_id, event_id, ts, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, CASE WHEN event_type = 'error' THEN 'unknown_window' WHEN value IS NULL OR value < 0 THEN 'malformed_usage' WHEN event_type = 'signup' THEN 'subagent_boundary' END AS skip, value / 100e0 AS x FROM {events}),
  c AS (SELECT *, sum(CASE WHEN skip IN ('unknown_window', 'malformed_usage') THEN 0e0 ELSE x - 0.5e0 END) OVER w AS up, sum(CASE WHEN skip IN ('unknown_window', 'malformed_usage') THEN 0e0 ELSE x - 0.75e0 END) OVER w AS high FROM e WINDOW w AS (PARTITION BY user_id, epoch ORDER BY ts, event_id)),
  s AS (SELECT *, up - least(0e0, min(up) OVER w) AS s_warn, high - least(0e0, min(high) OVER w) AS s_crit FROM c WINDOW w AS (PARTITION BY user_id, epoch ORDER BY ts, event_id))
  SELECT user_id, event_id, CAST(epoch AS BIGINT) AS epoch, skip, round(s_warn, 6) AS s_warn, round(s_crit, 6) AS s_crit, coalesce(last_value(CASE WHEN skip IN ('unknown_window', 'malformed_usage') THEN NULL WHEN s_crit >= 0.1e0 THEN 'critical' WHEN s_warn >= 0.05e0 THEN 'warning' END""" + _FILL + """ (PARTITION BY user_id, epoch ORDER BY ts, event_id), 'healthy') AS regime FROM s"""

QUERIES = {
    "f34_cache_habits": Query("WITH " + _ACTIONS + ", f AS (SELECT session, action, prompt_tokens, cache_tokens, concat_ws(',', " + ", ".join(f"CASE WHEN {r} THEN '{k}' END" for k, r in _RULES.items()) + f") AS rules, CASE WHEN {_WARN} THEN 'warn' WHEN " + " OR ".join(f"({_RULES[k]})" for k in _INFO) + f" THEN 'info' END AS severity, {_WASTE} AS waste_tokens FROM m) SELECT session, action, prompt_tokens, cache_tokens, rules, severity, CAST(waste_tokens AS BIGINT) AS waste_tokens FROM f WHERE rules <> ''"),
    "f20_budget_gate": Query("WITH " + _BUDGETS + """ SELECT n_name, round(spent, 2) AS spent, round(burn, 2) AS burn, CASE WHEN expired THEN 'block' WHEN after_call > limit_usd * hard THEN 'block' WHEN warnings <> '' THEN 'warn' ELSE 'allow' END AS verdict,
        CASE WHEN expired THEN 'expired' WHEN after_call > limit_usd * hard THEN 'hard_cap' END AS reason, warnings FROM w"""),
    "a12_tool_audit": Query("""WITH t AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, concat(event_type, '_', CAST(@props(props) % 7 AS STRING)) AS tool FROM {events}), n AS (SELECT max(ts) AS now, @us(min(ts); max(ts)) / 86400e6 AS days FROM t),
        s AS (SELECT DISTINCT user_id, day FROM t), z AS (SELECT count(*) AS sessions FROM s), o AS (SELECT DISTINCT user_id, tool FROM t), l AS (SELECT o.tool, count(*) AS loading FROM o JOIN s ON o.user_id = s.user_id GROUP BY o.tool),
        i AS (SELECT tool, count(*) AS invocations, max(ts) AS last FROM t GROUP BY tool), r AS (SELECT i.tool, invocations, loading, length(i.tool) * 40 AS tokens, invocations / (days / 7) AS per_week, sessions / (days / 7) AS sessions_per_week, @us(last; now) / 86400e6 AS idle, days FROM i JOIN l ON i.tool = l.tool CROSS JOIN n CROSS JOIN z),
        u AS (SELECT *, CASE WHEN tool LIKE 'purchase%' THEN 'critical' WHEN per_week >= 70 THEN 'high' WHEN per_week < 66 AND idle > 0.1e0 THEN 'waste' ELSE 'low' END AS utility FROM r)
        SELECT tool, invocations, loading, round(per_week, 6) AS per_week, round(idle, 6) AS idle_days, utility, round(sessions_per_week * tokens * (1 - least(1e0, CAST(invocations AS DOUBLE) / loading)), 4) AS wasted_per_week, utility = 'waste' AND days >= 14 AS remove_it FROM u"""),
    "w9_detector": Query(_W9, own=_W9.replace(_FILL, " IGNORE NULLS) OVER")),
    "w14_tool_list_drift": Query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type FROM {events} GROUP BY user_id, CAST(ts AS DATE), event_type), n AS (SELECT user_id, day, count(*) AS n, dense_rank() OVER (PARTITION BY user_id ORDER BY day) AS turn FROM d GROUP BY user_id, day), f AS (SELECT d.user_id, d.event_type, n.n AS n0 FROM d JOIN n ON d.user_id = n.user_id AND d.day = n.day WHERE n.turn = 1),
        m AS (SELECT n.user_id, n.day, n.turn, max(n.n) AS n, count(f.event_type) AS same, max(z.n0) AS n0 FROM n JOIN d ON n.user_id = d.user_id AND n.day = d.day JOIN (SELECT DISTINCT user_id, n0 FROM f) z ON z.user_id = n.user_id LEFT JOIN f ON f.user_id = d.user_id AND f.event_type = d.event_type GROUP BY n.user_id, n.day, n.turn)
        SELECT user_id, min(turn) AS first_drift, min_by(n - same, turn) AS added, min_by(n0 - same, turn) AS removed FROM m WHERE n <> same OR n0 <> same GROUP BY user_id"""),
    "w23_mask_plan": Query("""WITH o AS (SELECT conv_id, turn, role, tokens, role = 'system' AS pinned, text LIKE '%zz%' AS carried, lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS next_use, max(turn) OVER (PARTITION BY conv_id) AS now FROM {turns}),
        r AS (SELECT *, CASE WHEN pinned THEN 'pinned' WHEN carried THEN 'carried' WHEN now - turn > 3 THEN 'stale' ELSE 'live' END AS state, greatest(0, tokens - 4) AS reclaim FROM o),
        t AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) - sum(CASE WHEN state IN ('carried', 'stale') THEN reclaim ELSE 0 END) OVER (PARTITION BY conv_id) AS retained, sum(CASE WHEN state = 'live' THEN reclaim ELSE 0 END) OVER (PARTITION BY conv_id, state ORDER BY CASE WHEN next_use > now THEN next_use - now ELSE 1000000 END DESC, turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - reclaim AS evicted FROM r)
        SELECT conv_id, turn, CASE WHEN state = 'live' THEN 'budget' ELSE state END AS reason, CAST(reclaim AS BIGINT) AS reclaimed FROM t WHERE state IN ('carried', 'stale') OR state = 'live' AND retained - evicted > 60"""),
    "f2_estimate_cost": Query("SELECT c.charge_id, c.task_id, c.tokens_in, round((greatest(0, c.tokens_in - c.tokens_cached) * coalesce(p.in_usd, 2.5e0) + c.tokens_cached * coalesce(p.cached_usd, p.in_usd, 1.25e0) + c.tokens_out * coalesce(p.out_usd, 10e0)) / 1e6, 8) AS estimate FROM {charges} c LEFT JOIN {prices} p ON c.model = p.model"),
    "f9_idle_guard": Query("""WITH g AS (SELECT event_id, value, event_type, @us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id); ts) / 1e6 AS idle, CASE WHEN event_type IN ('view', 'click') THEN '5m' ELSE '1h' END AS ttl, least(1e0, greatest(0e0, value / 100)) AS p FROM {events}), t AS (SELECT *, CASE WHEN ttl = '5m' THEN 300e0 ELSE 3600e0 END AS lasts, CASE WHEN ttl = '5m' THEN 0.1e0 / 1.15e0 ELSE 0.1e0 / 1.9e0 END AS threshold, CAST(floor(value) AS BIGINT) * 100 AS prefix FROM g WHERE idle IS NOT NULL)
        SELECT event_id, round(lasts - idle, 3) AS seconds_left, CASE WHEN prefix < 1024 THEN 'nothing_to_protect' WHEN idle >= lasts THEN 'already_expired' WHEN lasts - idle > 60 THEN 'wait' WHEN p < threshold THEN 'let_expire' ELSE 'heartbeat' END AS action, round(p * prefix * CASE WHEN ttl = '5m' THEN 1.25e0 ELSE 2e0 END * 3e0 / 1e6 - prefix * 0.1e0 * 3e0 / 1e6, 8) AS value_usd FROM t"""),
    "f11_prefix_warm": Query("""WITH g AS (SELECT event_id, value, @us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id); ts) AS idle, event_type IN ('view', 'purchase') AS reused FROM {events}), s AS (SELECT *, CASE WHEN idle IS NULL THEN 'absent' WHEN idle < 86400000000 THEN 'warm' ELSE 'expired' END AS status FROM g)
        SELECT event_id, status, CASE WHEN status = 'warm' THEN 86400000000 - idle ELSE 0 END AS us_left, CASE WHEN NOT reused THEN 'skip' WHEN status = 'warm' AND idle < 64800000000 THEN 'skip' WHEN status = 'warm' THEN 'refresh' ELSE 'warm' END AS action, round(greatest(0e0, value) * 0.9e0, 6) AS hit_savings FROM s"""),
    "f14_price_tag": Query("""WITH c AS (SELECT p_partkey, p_size * 100 AS tokens, p_type LIKE '%STEEL%' AS proven, CASE WHEN p_brand LIKE '%1' THEN NULL ELSE 3e0 END AS chosen_rate, CASE WHEN p_brand LIKE '%2' THEN 4e0 ELSE 0.8e0 END AS cheap_rate FROM {part}), k AS (SELECT *, tokens * chosen_rate / 1e6 AS chosen, tokens * cheap_rate / 1e6 AS cheap FROM c), s AS (SELECT *, CASE WHEN cheap < chosen THEN floor((chosen - cheap) * 1e6 + 0.5e0) / 1e6 END AS saved FROM k)
        SELECT p_partkey, round(saved, 6) AS saved, CASE WHEN saved IS NOT NULL AND chosen > 0 THEN round(floor(saved / chosen * 1e8 + 0.5e0) / 1e6, 4) END AS saved_percent, CASE WHEN proven AND saved > 0.001e0 THEN 'cheap' ELSE 'chosen' END AS recommended FROM s"""),
    "f19_anti_synergy": Query("""WITH t AS (SELECT conv_id, turn, role, tokens, role = 'system' OR turn = 0 AS anchor, tokens * 2 AS busted, CASE WHEN role = 'user' THEN tokens ELSE 0 END AS repin, count(*) OVER (PARTITION BY conv_id, role) AS uses FROM {turns})
        SELECT conv_id, turn, CAST(CASE WHEN anchor THEN tokens - CASE WHEN repin > 0 THEN least(busted, repin) ELSE busted END ELSE tokens END AS BIGINT) AS net, CASE WHEN anchor AND tokens - CASE WHEN repin > 0 THEN least(busted, repin) ELSE busted END <= 0 THEN 'blocked' ELSE 'safe' END AS prune, CASE WHEN uses >= 3 THEN 'blocked' ELSE 'safe' END AS skip, CASE WHEN anchor THEN 'blocked' ELSE 'safe' END AS resqueeze FROM t"""),
    "f25_turn_risk": Query("""WITH t AS (SELECT conv_id, turn, length(text) AS chars, @rx(text; '[A-Z][a-z]+ [A-Z]|[0-9]') AS target, @rx(lower(text); 'fix|broken|again|st[aeiou]n') AS vague, tokens, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS filled, lag(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {turns} WHERE role = 'user' AND text IS NOT NULL),
        f AS (SELECT *, CASE WHEN vague AND NOT target THEN 0.35e0 ELSE 0e0 END AS f1, CASE WHEN chars > 0 AND chars < 25 THEN 0.15e0 ELSE 0e0 END AS f2, CASE WHEN NOT target THEN 0.15e0 ELSE 0e0 END AS f3, CASE WHEN before < 20 THEN 0.1e0 ELSE 0e0 END AS f4, CASE WHEN least(100e0, filled / 2e0) >= 80 THEN floor((least(100e0, filled / 2e0) - 80) / 20 * 0.2e0 * 1000 + 0.5e0) / 1000 ELSE 0e0 END AS f5 FROM t), r AS (SELECT *, least(1e0, f1 + f2 + f3 + f4 + f5) AS risk FROM f)
        SELECT conv_id, turn, round(risk, 3) AS risk, CASE WHEN round(risk, 3) >= 0.6e0 THEN 'high' WHEN round(risk, 3) >= 0.35e0 THEN 'elevated' ELSE 'low' END AS band FROM r"""),
    "f27_influence": Query("""WITH s AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) - 1 AS prior, event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS same, event_type IN ('purchase', 'signup') AS intent FROM {events}),
        x AS (SELECT *, -0.4e0 + 3.2e0 * CASE WHEN intent THEN 1e0 ELSE 0e0 END + 1.4e0 / (1 + prior) + 0.8e0 * CASE WHEN intent THEN 1e0 ELSE 0e0 END - 3.6e0 * CASE WHEN coalesce(same, false) THEN 1e0 ELSE 0e0 END + 0.06e0 * ln(1 + greatest(0e0, value)) AS logit FROM s) SELECT event_id, round(1 / (1 + exp(-logit)), 6) AS score, 1 / (1 + exp(-logit)) < 0.15e0 AND prior > 0 AS advised FROM x"""),
    "f31_subagent_policy": Query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS active, max(ts) AS last, min(ts) AS first, count(DISTINCT event_type) AS kinds FROM {events} GROUP BY user_id, CAST(ts AS DATE)), h AS (SELECT user_id, day, max(n) AS burst FROM (SELECT user_id, CAST(ts AS DATE) AS day, hour(ts) AS h, count(*) AS n FROM {events} GROUP BY user_id, CAST(ts AS DATE), hour(ts)) x GROUP BY user_id, day)
        SELECT d.user_id, d.day, CASE WHEN @us(first; last) / 60e6 > 1380 THEN 'UNATTENDED_LOOP' WHEN active > 8 THEN 'CONCURRENT_CAP' WHEN burst > 3 THEN 'FAN_OUT_RUNAWAY' WHEN kinds > 4 THEN 'PEAK_PARALLEL_IN_TURN' END AS pattern, kinds > 3 AND kinds <= 4 OR @us(first; last) / 60e6 > 1200 AS warns FROM d JOIN h ON d.user_id = h.user_id AND d.day = h.day"""),
    "j13_freshness": Query("""WITH k AS (SELECT p_brand AS entry, p_partkey AS dep, @sha(concat(p_name, CASE WHEN p_size = 1 THEN '!' ELSE '' END)) AS held, @sha(p_name) AS now FROM {part}) SELECT entry, count(*) AS deps, sum(CASE WHEN held <> now THEN 1 ELSE 0 END) = 0 AS fresh, CAST(sum(CASE WHEN held <> now THEN 1 ELSE 0 END) AS BIGINT) AS stale FROM k GROUP BY entry"""),
    "p5_dimensions": Query("""SELECT agent_id, count(*) AS charges, count(DISTINCT coalesce(concat(provider, '|', model), '(unattributed)')) AS keys, min(coalesce(nation, '(unattributed)')) AS project, min(coalesce(region, '(unattributed)')) AS branch FROM {charges} GROUP BY agent_id"""),
    "p8_read_only_tools": Query("""SELECT conv_id, turn, @rx(lower(text); '^[a-z]+ [a-z]+') AND NOT @rx(text; '[&|<>$`]') AND NOT text LIKE '%;%' AND NOT @rx(lower(text); '(^|[^a-z])(delete|exec|okdir)([^a-z]|$)') AS eligible FROM {conversations} WHERE text IS NOT NULL"""),
    "p9_paths": Query("""SELECT page_id, @rx(url; '[.](html?|php|js)$') AS code, @rx(url; '(^|/)(test|tests|spec)(/|$)') AS test_path, @rx(url; '(^|/)(grade|grader|eval)(/|$)') AS grader FROM {pages} WHERE url IS NOT NULL"""),
    "g7_clamped": Query("""SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR value < 0 THEN 0e0 ELSE value END AS value, value IS NULL OR isnan(value) OR value < 0 AS clamped FROM {events}"""),
    "g3_nullable_sum": Query("""SELECT c_mktsegment, round(sum(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END), 2) AS credit, sum(CASE WHEN c_acctbal > 1e9 THEN c_acctbal END) AS none_seen FROM {customer} GROUP BY c_mktsegment"""),
    "g4_skipped": Query("""SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value IS NULL OR value < 1 OR props IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS skipped, round(sum(CASE WHEN value >= 1 AND props IS NOT NULL THEN value ELSE 0e0 END), 3) AS total FROM {events} GROUP BY event_type"""),
    "s20_focus_export": Query("""WITH c AS (SELECT *, tokens_in + tokens_out + tokens_cached AS tokens, round(cost_usd, 4) AS usd, CASE WHEN tokens_in + tokens_out + tokens_cached > 0 THEN round(cost_usd / ((tokens_in + tokens_out + tokens_cached) / 1e6), 4) END AS unit FROM {charges})
        SELECT usd AS BilledCost, 'Usage' AS ChargeCategory, concat(model, ' inference: ', CAST(tokens AS STRING), ' tokens') AS ChargeDescription, ts AS ChargePeriodStart, ts AS ChargePeriodEnd, CAST(NULL AS STRING) AS CommitmentDiscountCategory, CAST(NULL AS STRING) AS CommitmentDiscountId, CAST(NULL AS STRING) AS CommitmentDiscountName, CAST(NULL AS STRING) AS CommitmentDiscountStatus, CAST(NULL AS STRING) AS CommitmentDiscountType,
          tokens AS ConsumedQuantity, 'tokens' AS ConsumedUnit, usd AS ContractedCost, unit AS ContractedUnitPrice, usd AS EffectiveCost, provider AS InvoiceIssuerName, usd AS ListCost, unit AS ListUnitPrice, 'Standard' AS PricingCategory, tokens AS PricingQuantity, '1M_tokens' AS PricingUnit, provider AS ProviderName, provider AS PublisherName, CAST(NULL AS STRING) AS RegionId, region AS RegionName,
          charge_id AS ResourceId, model AS ResourceName, 'AIModel' AS ResourceType, 'AI and Machine Learning' AS ServiceCategory, provider AS ServiceName, 'Generative AI' AS ServiceSubcategory, model AS SkuId, concat(model, '#recorded') AS SkuPriceId, nation AS SubAccountId, nation AS SubAccountName, concat(chr(123), '"agent_id":"', CAST(agent_id AS STRING), '","charge_source":"recorded"', chr(125)) AS Tags FROM c"""),
}
