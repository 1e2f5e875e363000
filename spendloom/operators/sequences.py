"""Sequences: sessions, turns, change points, runs, lags and streaks (window functions, one order for each key)."""

from ..plans.dialect import Query

QUERIES = {
    "w1_sessions": Query("""WITH g AS (SELECT *, CASE WHEN @us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id); ts) > 1800000000 THEN 1 ELSE 0 END AS cut FROM {events}), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
        SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS events, round(sum(value), 4) AS spend FROM s GROUP BY user_id, session"""),
    "w2_turn_segments": Query("""WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM {turns})
        SELECT conv_id, CAST(segment AS BIGINT) AS segment, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens, min(turn) AS first_turn FROM t WHERE segment > 0 GROUP BY conv_id, segment"""),
    "w7_context_fill": Query("""SELECT c.charge_id, CASE WHEN p.context IS NULL OR p.context <= 0 THEN NULL ELSE round(least(1e0, greatest(0e0, (c.tokens_in + 0.5e0 * c.tokens_cached + c.tokens_out) / p.context)), 8) END AS fill, p.context IS NULL AS unknown_window FROM {charges} c LEFT JOIN {prices} p ON c.model = p.model"""),
    "w8_cusum": Query("""WITH x AS (SELECT user_id, event_id, ts, value / 100e0 AS x FROM {events}), c AS (SELECT *, sum(x - 0.5e0) OVER w AS up, sum(x - 0.75e0) OVER w AS high FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, up - least(0e0, min(up) OVER w) AS s_warn, high - least(0e0, min(high) OVER w) AS s_crit FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, event_id, round(s_warn, 6) AS s_warn, round(s_crit, 6) AS s_crit, coalesce(last_value(CASE WHEN s_crit >= 0.1e0 THEN 'critical' WHEN s_warn >= 0.05e0 THEN 'warning' END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id), 'healthy') AS regime FROM s""",
        own="""WITH x AS (SELECT user_id, event_id, ts, value / 100e0 AS x FROM {events}), c AS (SELECT *, sum(x - 0.5e0) OVER w AS up, sum(x - 0.75e0) OVER w AS high FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, up - least(0e0, min(up) OVER w) AS s_warn, high - least(0e0, min(high) OVER w) AS s_crit FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, event_id, round(s_warn, 6) AS s_warn, round(s_crit, 6) AS s_crit, coalesce(last_value(CASE WHEN s_crit >= 0.1e0 THEN 'critical' WHEN s_warn >= 0.05e0 THEN 'warning' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'healthy') AS regime FROM s"""),
    "w10_rolling_slope": Query("""WITH i AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS i FROM {events}) SELECT user_id, event_id, CASE WHEN i < 2 THEN 0e0 ELSE round(regr_slope(value, i) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 5) END AS slope FROM i"""),
    "w12_silent_runs": Query("""WITH t AS (SELECT *, CASE WHEN tokens_in >= 2048 AND tokens_cached = 0 THEN 1 ELSE 0 END AS silent, row_number() OVER (PARTITION BY agent_id ORDER BY ts, charge_id, tokens_in, tokens_out, tokens_cached, cost_usd) AS i FROM {charges}), g AS (SELECT *, i - row_number() OVER (PARTITION BY agent_id, silent ORDER BY i) AS island FROM t)
        SELECT agent_id, min(i) AS first_turn, count(*) AS run, CAST(sum(tokens_in) AS BIGINT) AS tokens FROM g WHERE silent = 1 GROUP BY agent_id, island HAVING count(*) >= 3"""),
    "w13_ttl_penalty": Query("""WITH p AS (SELECT *, lag(tokens_in) OVER w AS before, lag(ts) OVER w AS before_ts FROM {charges} WINDOW w AS (PARTITION BY agent_id ORDER BY ts, charge_id, tokens_in, tokens_out, tokens_cached, cost_usd)) SELECT agent_id, count(*) AS penalties, CAST(sum(tokens_in) AS BIGINT) AS tokens FROM p WHERE before > 0 AND tokens_in > 0 AND abs(tokens_in - before) <= 0.3e0 * before AND @us(before_ts; ts) > 300000000 GROUP BY agent_id"""),
    "w16_fanout_acceleration": Query("""WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM {events} GROUP BY user_id, CAST(ts AS DATE)), d AS (SELECT *, n - lag(n) OVER w AS d1, n - 2 * lag(n) OVER w + lag(n, 2) OVER w AS d2 FROM b WINDOW w AS (PARTITION BY user_id ORDER BY day)) SELECT user_id, day, n, d1, d2 FROM d WHERE d2 >= 2 AND d1 > 0 AND n >= 3"""),
    "w17_edit_thrash": Query("""WITH e AS (SELECT user_id, event_type AS sha, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {events})
        SELECT user_id, CAST(sum(CASE WHEN nth > 1 AND sha <> before THEN 1 ELSE 0 END) AS BIGINT) AS cycles, count(*) - count(DISTINCT sha) AS wasted FROM e GROUP BY user_id HAVING sum(CASE WHEN nth > 1 AND sha <> before THEN 1 ELSE 0 END) >= 2"""),
    "w18_tier_drift": Query("""WITH t AS (SELECT agent_id, model, charge_id, cost_usd, lag(model) OVER (PARTITION BY agent_id ORDER BY ts, charge_id, tokens_in, tokens_out, tokens_cached, cost_usd) AS before, row_number() OVER (PARTITION BY agent_id ORDER BY ts, charge_id, tokens_in, tokens_out, tokens_cached, cost_usd) AS i FROM {charges}), f AS (SELECT agent_id, min(i) AS flip FROM t WHERE before IS NOT NULL AND model <> before GROUP BY agent_id)
        SELECT t.agent_id, f.flip, round(sum(CASE WHEN i >= flip THEN cost_usd ELSE 0e0 END), 4) AS cost_after FROM t JOIN f ON t.agent_id = f.agent_id GROUP BY t.agent_id, f.flip"""),
    "w19_duplicate_calls": Query("""WITH f AS (SELECT event_id, user_id, first_value(event_id) OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS first_id FROM {events}) SELECT event_id, user_id, first_id FROM f WHERE first_id <> event_id"""),
    "w22_latest": Query("SELECT conv_id, max(turn) AS turn, max_by(role, turn) AS role FROM {conversations} GROUP BY conv_id"),
    "w26_recency": Query("""WITH m AS (SELECT event_id, @us(min(ts) OVER (PARTITION BY user_id); ts) AS a, @us(min(ts) OVER (PARTITION BY user_id); max(ts) OVER (PARTITION BY user_id)) AS span FROM {events}) SELECT event_id, CASE WHEN span = 0 THEN 1e0 ELSE round(CAST(a AS DOUBLE) / span, 8) END AS recency FROM m"""),
    "w27_average_ranks": Query("""WITH r AS (SELECT s_suppkey, rank() OVER (ORDER BY abs(s_acctbal)) AS r, count(*) OVER (PARTITION BY abs(s_acctbal)) AS ties FROM {supplier}) SELECT s_suppkey, r + (ties - 1) / 2e0 AS average_rank FROM r"""),
    "r8_markov": Query("""WITH b AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM {events}), n AS (SELECT a, b, count(*) AS n FROM b WHERE b IS NOT NULL GROUP BY a, b), t AS (SELECT *, (n + 1e0) / (sum(n) OVER (PARTITION BY a) + count(*) OVER (PARTITION BY a)) AS p FROM n),
        r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY p DESC, b) AS k FROM t) SELECT a AS tool, b AS predicted, round(p, 6) AS p, CAST(k AS BIGINT) AS k FROM r WHERE k <= 3 AND p >= 0.2e0"""),
    "f38_read_gate": Query("""WITH e AS (SELECT event_id, lag(props) OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts, event_id) AS before, props FROM {events}) SELECT event_id, CASE WHEN before = props THEN 'deny' ELSE 'allow' END AS decision FROM e"""),
    "f42_severity_transitions": Query("""WITH s AS (SELECT event_id, user_id, ts, CASE WHEN value >= 75 THEN 'red' WHEN value >= 50 THEN 'yellow' ELSE 'green' END AS severity FROM {events}), l AS (SELECT *, lag(severity) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s) SELECT event_id, before, severity FROM l WHERE before <> severity"""),
    "f43_speculation_breaker": Query("""WITH m AS (SELECT event_id, count(*) OVER w AS samples, avg(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END) OVER w AS wasted FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) SELECT event_id, samples, round(wasted, 6) AS wasted, samples >= 10 AND wasted >= 0.6e0 AS is_open FROM m"""),
}
