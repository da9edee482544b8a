"""Streams over several files out of order: nothing is lost, late rows are named, and the state ends with the data."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from clewline.session import scratch_path
from clewline.streaming import streams as X

SNAP = "key string, sequence bigint, clock bigint, status string, body string"


def feed(spark, batches, delay):
    f = X.ChangeFeed(spark, scratch_path(spark, "feed"), delay)
    for no, rows in enumerate(batches):
        f.step(spark.createDataFrame(rows, SNAP), no)
    f.step(spark.createDataFrame([], SNAP), len(batches), closing=True)
    return sorted(map(tuple, f.result().collect())), sorted(map(tuple, f.result("late").collect()))


def snap(k, n, status="request"):
    return k, n, n, status, f"b{n}"


def test_later_file_with_lower_numbers(spark):
    got, late = feed(spark, [[snap("a", n) for n in range(20, 40)], [snap("a", n) for n in range(20)]], 100)
    assert [r[1] for r in got] == list(range(40)) and late == []


def test_changes_across_batches(spark):
    same = lambda n, body, status="request": ("k", n, n, status, body)
    batches = [[same(3, "x"), same(1, "x")], [same(2, "x"), same(6, "z", "completed")], [same(5, "y"), same(4, "x")], [same(7, "w"), same(8, "v")]]
    got, late = feed(spark, batches, 4)
    assert [(r[1], r[3]) for r in got] == [(1, "x"), (5, "y"), (6, "z")] and late == []


def test_too_late_rows_are_named(spark):
    got, late = feed(spark, [[snap("a", 50)], [snap("a", 100)], [snap("a", 3), snap("b", 99)]], 10)
    assert [r[1] for r in got] == [50, 100, 99] and [r[1] for r in late] == [3]


def test_many_batches_keep_the_last_row(spark):
    """More batches than are compacted at a time; a key that is silent for long is still known."""
    batches = [[("quiet", 0, 0, "request", "x"), snap("a", 1)]] + [[snap("a", 10 * n)] for n in range(1, X.COMPACT + 4)] + [[("quiet", 900, 900, "request", "x"), ("quiet", 901, 901, "request", "y")]]
    got, _ = feed(spark, batches, 0)
    assert [(r[1], r[3]) for r in got if r[0] == "quiet"] == [(0, "x"), (901, "y")]


def test_null_keys_and_empty_batches(spark):
    got, late = feed(spark, [[], [(None, 5, 5, "request", "x"), ("a", 1, 1, None, None)], []], 2)
    assert got == [("a", 1, None, None)] and late == []


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("build", ["quota", "capture", "ttl"])
def test_append_mode_over_many_files_and_the_state_ends(spark, build):
    rows = [(k % 3, at(97 * k), ["request", "completed", "failed"][k % 3], k) for k in range(300)]
    df = spark.createDataFrame(rows, "capture_id bigint, ts timestamp, state string, body_bytes bigint")
    stream = X.arrivals(df, "ts", files=6)
    if build == "quota":
        out = X.stream_daily_quota(stream.select("ts", F.col("capture_id").cast("string").alias("provider")), 5, "12 days")
        total = F.sum("n")
    elif build == "capture":
        out, total = X.stream_capture_summary(stream, "3 hours", "12 days"), F.sum(F.col("requests") + F.col("completed") + F.col("failed"))
    else:
        out = X.stream_negative_ttl(stream.select(F.col("capture_id").alias("host"), F.col("ts").alias("observed_at"), (F.unix_millis("ts") + 600_000 * (1 + F.col("capture_id"))).alias("valid_until_ms")), "12 days")
        total = F.sum(F.when(F.col("usable"), F.col("answers")))
    root = scratch_path(spark, "run")
    q = X.run_all(out, "append", root, lambda b, no: b.write.mode("overwrite").parquet(f"{root}/rows/batch={no}"))
    progress = [json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress]
    assert sum(p["numInputRows"] > 0 for p in progress) >= 6
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0
    assert sum(o.get("numRowsDroppedByWatermark", 0) for p in progress for o in p["stateOperators"]) == 0
    assert spark.read.parquet(f"{root}/rows").agg(total).first()[0] == 300


def test_answers_that_overlap_are_one_stretch(spark):
    rows = [("h", at(0), 60), ("h", at(30), 10), ("h", at(50), 60), ("h", at(200), 5), ("g", at(205), 5)]
    df = spark.createDataFrame(rows, "host string, observed_at timestamp, life int").withColumn("valid_until_ms", F.unix_millis("observed_at") + F.col("life") * 60_000)
    got = X.drain(X.stream_negative_ttl(X.arrivals(df, "observed_at", files=2), "3 days"), "append")
    assert sorted((r.host, r.usable, r["at"]) for r in got.collect()) == [("g", False, at(210)), ("g", True, at(205)), ("h", False, at(110)), ("h", False, at(205)), ("h", True, at(0)), ("h", True, at(200))]
