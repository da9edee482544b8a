"""Streaming queries, run over the given tables as file streams of several batches that come out of order."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as X
from .registry import query, with_fixtures as W

#: How late rows come at most: two of the six stretches that a month of events arrives in.
DELAY = "12 days"
DELAY_MICROS = 12 * 86_400_000_000


def arriving(t):
    return X.arrivals(t.events, "ts")


def events(t):
    e = arriving(t)
    kind = F.col("event_type")
    state = F.when(kind.isin("view", "signup"), "request").when(kind == "click", "response_received").when(kind == "purchase", "completed").otherwise("failed")
    return e.select(F.col("user_id").alias("capture_id"), F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(F.col("event_id") / 400).cast("string")).alias("request_id"),
                    F.col("event_id").alias("sequence"), "ts", F.when(kind.isNotNull(), state).alias("state"), F.floor("value").alias("body_bytes"))


NE = "net_events"


@query("stream_request_state", W("""
SELECT capture_id, request_id, coalesce(arg_min(state, sequence) FILTER (state IN ('completed', 'failed')), arg_max(state, sequence)) AS state FROM net_events GROUP BY 1, 2""", NE))
def _(t):
    return X.drain(X.stream_request_state(events(t).where("capture_id IS NOT NULL")), "update", ["capture_id", "request_id"])


@query("stream_first_wins", W("SELECT DISTINCT capture_id, request_id FROM net_events", NE))
def _(t):
    return X.drain(X.stream_first_wins(events(t), ["capture_id", "request_id"]), "append").select("capture_id", "request_id")


@query("stream_changes_only", W("""
SELECT key, sequence, state AS status, body FROM (SELECT *, lag(state || '|' || body) OVER (PARTITION BY key ORDER BY sequence) AS p, coalesce(sum(CASE WHEN state IN ('completed', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ends
  FROM (SELECT request_id AS key, sequence, state, 'b' || (body_bytes % 2) AS body FROM net_events)) WHERE ends = 0 AND p IS DISTINCT FROM state || '|' || body""", NE))
def _(t):
    e = events(t).select(F.col("request_id").alias("key"), "sequence", F.unix_micros("ts").alias("clock"), F.col("state").alias("status"), F.concat(F.lit("b"), (F.col("body_bytes") % 2).cast("string")).alias("body"))
    return X.stream_changes_only(e, DELAY_MICROS)[0]


# A host's answers live for one to four hours, by kind of event.
LIFE = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 4 END"


@query("stream_negative_ttl", f"""
WITH a AS (SELECT user_id AS host, ts, ts + INTERVAL 1 HOUR * {LIFE} AS until, event_id FROM events),
b AS (SELECT *, max(until) OVER (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM a),
c AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ts, event_id) AS g FROM b),
d AS (SELECT host, g, min(ts) AS low, max(until) AS high, count(*) AS answers FROM c GROUP BY host, g)
SELECT host, true AS usable, epoch_us(low) AS at_us, answers FROM d UNION ALL SELECT host, false, epoch_us(high) // 1000 * 1000, answers FROM d""")
def _(t):
    e = arriving(t).select(F.col("user_id").alias("host"), F.col("ts").alias("observed_at"), (F.unix_millis("ts") + F.expr(LIFE) * 3_600_000).alias("valid_until_ms"))
    got = X.drain(X.stream_negative_ttl(e, DELAY), "append")
    at = F.unix_micros("at")
    return got.select("host", "usable", F.when(F.col("usable"), at).otherwise(F.floor(at / 1000) * 1000).alias("at_us"), "answers")


@query("stream_daily_quota", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS provider, count(*) AS n, count(*) >= 60 AS exhausted FROM events GROUP BY 1, 2")
def _(t):
    e = arriving(t).select("ts", F.col("event_type").alias("provider"))
    return X.drain(X.stream_daily_quota(e, 60, DELAY), "append")


@query("stream_capture_summary", W("""
SELECT capture_id, min(ts) AS opened_at, count(*) FILTER (state = 'request') AS requests, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed,
  greatest(count(*) FILTER (state = 'request') - count(*) FILTER (state IN ('completed', 'failed')), 0) AS unfinished, sum(body_bytes)::BIGINT AS bytes
FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY ts, sequence) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY capture_id ORDER BY ts, sequence) AS p FROM net_events)) GROUP BY capture_id, g""", NE))
def _(t):
    return X.drain(X.stream_capture_summary(events(t), delay=DELAY), "append")


@query("stream_job_progress", "SELECT l_orderkey AS job_id, count(DISTINCT l_linenumber % 4) FILTER (l_returnflag <> 'N') AS done FROM lineitem GROUP BY 1")
def _(t):
    li = t.lineitem.select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("l"), (F.col("l_linenumber") % 4).cast("string")).alias("layer"), F.col("l_returnflag").alias("status"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return X.drain(X.stream_job_progress(X.arrivals(li, "ts").where("job_id IS NOT NULL"), ("l0", "l1", "l2", "l3"), ("A", "R")), "update", ["job_id"])
