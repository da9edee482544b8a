"""Network log, span, ledger and reputation queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import netlog as N
from .registry import query, with_fixtures as W

NE = "net_events"
RQ = "rq AS (SELECT capture_id, request_id, min(sequence) AS sequence, arg_max(state, sequence) AS state, sum(body_bytes)::BIGINT AS body_bytes FROM net_events GROUP BY 1, 2)"
CHAIN = "SELECT l_orderkey * 100 + n AS request_id, CASE WHEN n > 1 AND l_partkey % 6 > 0 THEN l_orderkey * 100 + n - 1 ELSE NULL END AS redirected_from FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem) x"


@query("net_redirect_parent", f"""
WITH RECURSIVE c AS ({CHAIN}), d AS (SELECT request_id, redirected_from, 0 AS depth FROM c WHERE redirected_from IS NULL UNION ALL SELECT c.request_id, c.redirected_from, d.depth + 1 FROM c JOIN d ON c.redirected_from = d.request_id)
SELECT request_id, redirected_from AS parent_id, depth FROM d""")
def _(t):
    return N.net_redirect_parent(t.sql(CHAIN))


@query("net_request_cap", W("SELECT capture_id, least(count(*), 10) AS kept, greatest(count(*) - 10, 0) AS dropped FROM rq GROUP BY 1", NE, RQ))
def _(t):
    return N.net_request_cap(N.net_requests(t.net_events), 10)


@query("body_budget", "WITH RECURSIVE " + W("""
SELECT capture_id, request_id, status FROM f WHERE n > 0 UNION ALL SELECT capture_id, request_id, 'dropped' FROM o WHERE n > 12""", NE, RQ,
  "o AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY sequence, request_id) AS n FROM rq)",
  """f AS (SELECT capture_id, 0::BIGINT AS n, '' AS request_id, '' AS status, 0::BIGINT AS used FROM (SELECT DISTINCT capture_id FROM o)
  UNION ALL SELECT o.capture_id, o.n, o.request_id, CASE WHEN body_bytes > 250 THEN 'body_limit' WHEN used + body_bytes > 600 THEN 'total_limit' ELSE 'captured' END,
    CASE WHEN body_bytes > 250 OR used + body_bytes > 600 THEN used ELSE used + body_bytes END FROM f JOIN o ON o.capture_id = f.capture_id AND o.n = f.n + 1 WHERE o.n <= 12)""")[5:])
def _(t):
    return N.body_budget(N.net_requests(t.net_events), 250, 600, 12)


CURSOR = "SELECT DISTINCT user_id AS capture_id, CASE WHEN user_id % 10 = 0 THEN 99999999 ELSE user_id * 20 END AS after_sequence FROM events"


@query("request_page", W(f"""
SELECT capture_id, request_id, sequence, k > 5 AS has_more, NULL AS problem FROM (SELECT rq.*, row_number() OVER (PARTITION BY capture_id ORDER BY sequence) AS rn, count(*) OVER (PARTITION BY capture_id) AS k FROM rq JOIN ({CURSOR}) USING (capture_id) WHERE sequence > after_sequence) WHERE rn <= 5
UNION ALL SELECT capture_id, NULL, NULL, NULL, 'INVALID_CURSOR' FROM ({CURSOR}) JOIN (SELECT capture_id, max(sequence) AS m FROM rq GROUP BY 1) USING (capture_id) WHERE after_sequence > m""", NE, RQ))
def _(t):
    return N.request_page(N.net_requests(t.net_events), t.sql(CURSOR), 5)


@query("span_busy_time", W("""
SELECT run_id, sum(z - a)::BIGINT AS busy_ms FROM (SELECT run_id, g, min(start_ms) AS a, max(end_ms) AS z FROM (SELECT *, sum(CASE WHEN p IS NULL OR start_ms > p THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY start_ms, end_ms) AS g FROM (
  SELECT *, max(end_ms) OVER (PARTITION BY run_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM spans WHERE end_ms > start_ms)) GROUP BY 1, 2) GROUP BY 1""", "spans"))
def _(t):
    return N.span_busy_time(t.spans, 1000)


@query("span_stats", W("SELECT run_id, name, count(*) AS n, count(*) FILTER (NOT success) AS failures, quantile_cont((end_ms - start_ms)::DOUBLE, 0.5) AS p50, quantile_cont((end_ms - start_ms)::DOUBLE, 0.95) AS p95 FROM spans GROUP BY 1, 2", "spans"))
def _(t):
    return N.span_stats(t.spans)


@query("reputation_stats", W(f"SELECT url_id, {', '.join(f'count(*) FILTER (category = {chr(39)}{c}{chr(39)}) AS {c.replace(chr(45), chr(95))}' for c in N.ENGINE_CATEGORIES)}, 0 AS unknown_category FROM reputation GROUP BY 1", "reputation"))
def _(t):
    return N.reputation_stats(t.reputation)


@query("top_engines", W("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_id ORDER BY CASE category WHEN 'malicious' THEN 0 WHEN 'suspicious' THEN 1 ELSE 2 END, engine, category) AS rank FROM (SELECT DISTINCT * FROM reputation)) WHERE rank <= 8", "reputation"))
def _(t):
    return N.top_engines(t.reputation, 8)


@query("recent_jobs", W("SELECT * FROM (SELECT owner, job_id, created_at, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, job_id DESC) AS rank FROM jobs) WHERE rank <= 5", "jobs"))
def _(t):
    return N.recent_jobs(t.derived("jobs"), 5).select("owner", "job_id", "created_at", "rank")


@query("quota_usage", "SELECT strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) >= 300 AS exhausted FROM events GROUP BY 1, 2 UNION ALL SELECT strftime(ts, '%Y-%m'), NULL, count(*), count(*) >= 9000 FROM events GROUP BY 1")
def _(t):
    return N.quota_usage(t.events, 300, 9000)


LEDGER = """CASE ledger_status WHEN 'PENDING' THEN 'RUNNING' WHEN 'L1_DONE' THEN 'RUNNING' WHEN 'FAILED' THEN 'FAILED' WHEN 'ODD' THEN 'UNKNOWN_STATE' ELSE 'COMPLETED' END"""


@query("ledger_status", W(f"SELECT job_id, {LEDGER} AS status, CASE WHEN {LEDGER} = 'RUNNING' THEN NULL WHEN ledger_status = 'JUDGED' AND final_verdict <> 'PENDING' THEN final_verdict ELSE 'UNDETERMINED' END AS verdict FROM jobs", "jobs"))
def _(t):
    return N.ledger_status(t.derived("jobs"))


FRAGMENTS = "SELECT l_orderkey AS job_id, CASE l_linenumber WHEN 1 THEN 'l0' WHEN 2 THEN 'l1' WHEN 3 THEN 'gate' WHEN 4 THEN 'l2' WHEN 5 THEN 'l3' WHEN 6 THEN 'l4' ELSE 'other' END AS layer, CASE l_returnflag WHEN 'A' THEN 'COMPLETED' WHEN 'R' THEN 'STUB' ELSE 'PENDING' END AS status FROM lineitem"


@query("job_progress", W(f"""
SELECT job_id, d0 + CASE WHEN outcome IN ('COMPLETED', 'SKIPPED') THEN 1 ELSE 0 END AS done, 8 AS total, stub, outcome FROM (SELECT job_id, coalesce(d, 0) AS d0, coalesce(stub, false) AS stub, CASE WHEN ledger_status = 'FAILED' THEN 'FAILED' WHEN ledger_status IN ('GATE_BLOCKED', 'DNS_NAME_NONEXISTENT_AT_SCAN') THEN 'SKIPPED'
  WHEN ledger_status = 'JUDGED' THEN CASE WHEN final_verdict <> 'PENDING' THEN 'COMPLETED' ELSE 'UNAVAILABLE' END ELSE 'PENDING' END AS outcome
FROM jobs LEFT JOIN (SELECT job_id, count(DISTINCT layer) FILTER (status <> 'PENDING') AS d, bool_or(status = 'STUB') AS stub FROM ({FRAGMENTS}) WHERE layer <> 'other' GROUP BY 1) USING (job_id))""", "jobs"))
def _(t):
    return N.job_progress(t.derived("jobs"), t.sql(FRAGMENTS))


SNAP = "SELECT user_id AS run_id, concat(upper(event_type), '#w', CAST(event_id AS STRING)) AS key, CASE WHEN value > 50 THEN 'running' ELSE 'completed' END AS status FROM events"
WORKER = "SELECT c_custkey AS run_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Failed' ELSE 'Running' END AS worker_state FROM customer"


@query("run_snapshot", f"""
SELECT run_id, upper(event_type) AS kind, event_id AS num, CASE WHEN value > 50 AND c_mktsegment = 'BUILDING' THEN 'failed' WHEN value > 50 THEN 'running' ELSE 'completed' END AS status FROM (SELECT *, user_id AS run_id FROM events) LEFT JOIN customer ON c_custkey = run_id""")
def _(t):
    return N.run_snapshot(t.sql(SNAP), t.sql(WORKER))
