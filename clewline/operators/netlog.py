"""Network log, timing spans, ledger and reputation reports."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.joins import left_lookup
from ..functions.logic import first_true
from ..session import materialise

# Engine categories, progress layers and ledger words.
ENGINE_CATEGORIES = ("confirmed-timeout", "failure", "harmless", "malicious", "suspicious", "timeout", "type-unsupported", "undetected")
DONE_WORDS = ("COMPLETED", "STUB", "PARTIAL", "SKIPPED", "NOT_PERFORMED")
PROGRESS_LAYERS = ("l0", "l1", "gate", "l2", "l3", "l4", "final")
RUNNING_WORDS = ("PENDING", "L0_DONE", "L1_DONE", "REACH_DONE", "COLLECT_DONE", "EXPLORE_DONE", "FINAL_DONE", "COLLECT_SKIPPED")
SKIPPED_WORDS = ("GATE_BLOCKED", "TARGET_BLOCKED", "DNS_NAME_NONEXISTENT_AT_SCAN", "URL_UNREACHABLE_AT_SCAN")


def net_requests(events: DataFrame) -> DataFrame:
    """One row per request, keyed by its first event."""
    return events.groupBy("capture_id", "request_id").agg(F.min("sequence").alias("sequence"), F.max_by("state", "sequence").alias("state"), F.sum("body_bytes").alias("body_bytes"))


def net_redirect_parent(requests: DataFrame) -> DataFrame:
    """Parent request and depth in its redirect chain; the depth is NULL where the chain runs in a circle.

    Pointers are doubled until a round ends no more chains, so the rounds grow with the logarithm of the longest chain.
    Rows at the end of their chain take no part in a round's join.
    """
    edges = requests.select("request_id", F.col("redirected_from").alias("parent_id"))
    known = edges.select(F.col("request_id").alias("_r"))
    out = left_lookup(edges, known, "parent_id", "_r").select(
        "request_id", "parent_id", F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.col("_r").alias("_at"))
    out, open_ = materialise(out, "chains"), None
    while True:
        left = out.where("_at IS NOT NULL").count()
        if left == 0 or left == open_:
            return out.select("request_id", "parent_id", F.when(F.col("_at").isNull(), F.col("depth")).alias("depth"))
        open_ = left
        above = out.select(F.col("request_id").alias("_r"), F.col("depth").alias("_d"), F.col("_at").alias("_next"))
        j = out.where("_at IS NOT NULL").join(above, F.col("_at") == F.col("_r"), "left")
        further = j.select("request_id", "parent_id", (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_next").alias("_at"))
        out = materialise(out.where("_at IS NULL").unionByName(further), "chains")


def first_requests(requests: DataFrame, n: int) -> DataFrame:
    """First n requests of each capture; ranks above n are cut before the shuffle."""
    w = Window.partitionBy("capture_id").orderBy("sequence", "request_id")
    return requests.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def net_request_cap(requests: DataFrame, n: int) -> DataFrame:
    g = requests.groupBy("capture_id").agg(F.count("*").alias("total"))
    return g.select("capture_id", F.least("total", F.lit(n)).alias("kept"), F.greatest(F.col("total") - n, F.lit(0)).alias("dropped"))


def body_budget(bodies: DataFrame, per_body: int, total: int, request_cap: int | None = None) -> DataFrame:
    """captured / body_limit / total_limit in order; a body that is not stored uses no budget.

    A capture's requests pass by in order, sorted within their partition, and one number is kept. Requests beyond
    ``request_cap`` (none unless given: it is the capture's own limit) are reported as dropped.
    """
    import pyarrow as pa

    def run(batches):
        capture, used, seen = None, 0, 0
        for batch in batches:
            captures, sizes, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for own, size in zip(captures, sizes):
                if own != capture:
                    capture, used, seen = own, 0, 0
                seen += 1
                if request_cap is not None and seen > request_cap:
                    out.append("dropped")
                elif size is not None and size > per_body:
                    out.append("body_limit")
                elif size is not None and used + size > total:
                    out.append("total_limit")
                else:
                    used += size or 0
                    out.append("captured")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["capture_id", "request_id", "status"])

    kinds = dict(bodies.dtypes)
    rows = bodies.repartition("capture_id").sortWithinPartitions("capture_id", "sequence", "request_id")
    schema = f"capture_id {kinds['capture_id']}, request_id {kinds['request_id']}, status string"
    return rows.select("capture_id", "request_id", F.col("body_bytes").cast("bigint")).mapInArrow(run, schema)


def request_page(requests: DataFrame, after: DataFrame, limit: int) -> DataFrame:
    """Rows after each capture's cursor, at most ``limit``, with has_more and the next cursor.

    A cursor beyond the newest sequence is a problem row. One extra row tells has_more, so a
    capture contributes at most limit + 1 rows to the sort.
    """
    newest = requests.groupBy("capture_id").agg(F.max("sequence").alias("newest"))
    c = after.join(newest, "capture_id", "left")
    bad = c.where((F.col("after_sequence") > F.coalesce("newest", F.lit(0)))).select(
        "capture_id", F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("bigint").alias("sequence"),
        F.lit(None).cast("boolean").alias("has_more"), F.lit("INVALID_CURSOR").alias("problem"))
    j = requests.join(after, "capture_id").where(F.col("sequence") > F.col("after_sequence"))
    top = first_requests(j, limit + 1)
    more = F.max("rn").over(Window.partitionBy("capture_id")) > limit
    page = top.withColumn("has_more", more).where(F.col("rn") <= limit).select(
        "capture_id", "request_id", "sequence", "has_more", F.lit(None).cast("string").alias("problem"))
    return page.unionByName(bad)


def span_busy_time(spans: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Union length of overlapping spans per run.

    Spans are clipped to time buckets; the union inside a bucket needs only that bucket's
    rows and bucket lengths add up exactly, so one long run spreads over many tasks.
    """
    b = F.lit(bucket_ms)
    s = spans.where("end_ms > start_ms").select("run_id", "start_ms", "end_ms").distinct()
    first, last = F.floor(F.col("start_ms") / b), F.floor((F.col("end_ms") - 1) / b)
    x = s.select("run_id", "start_ms", "end_ms", F.explode(F.sequence(first, last)).alias("bucket"))
    x = x.select("run_id", "bucket", F.greatest("start_ms", F.col("bucket") * b).alias("a"), F.least("end_ms", (F.col("bucket") + 1) * b).alias("z"))
    x = x.groupBy("run_id", "bucket", "a").agg(F.max("z").alias("z"))
    w = Window.partitionBy("run_id", "bucket").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("z") - F.greatest("a", F.coalesce(F.max("z").over(w), F.col("a"))))
    return x.select("run_id", new.alias("d")).groupBy("run_id").agg(F.sum("d").alias("busy_ms"))


QUANTILES = {"p50": 0.5, "p95": 0.95}
#: Bits of a duration that one round of the selection tells apart.
DIGIT = 12


def span_stats(spans: DataFrame) -> DataFrame:
    """Per run and name: count, failures, and exact interpolated quantiles of the duration, whatever the size of a group.

    Ranks are found digit by digit: the counts of the leading digits (combined before the shuffle, at most 2^12 for a
    group) say which digit holds a rank, and the next round counts only what shares it.
    """
    # One text names a group, also where a part of its name is missing.
    g = F.to_json(F.struct("run_id", "name"), {"ignoreNullFields": "false"})
    d = spans.select(g.alias("g"), "run_id", "name", "success", (F.col("end_ms") - F.col("start_ms")).alias("d"))
    lowest, highest = d.agg(F.min("d"), F.max("d")).first()
    groups = d.groupBy("g", "run_id", "name").agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("failures"), F.count("d").alias("m"))
    if lowest is None:
        return groups.select("run_id", "name", "n", "failures", *[F.lit(None).cast("double").alias(q) for q in QUANTILES])
    # Values are counted from the least one, so digits are never negative.
    v = d.where("d IS NOT NULL").select("g", (F.col("d") - lowest).alias("v"))
    rounds = max(1, -(-(highest - lowest).bit_length() // DIGIT))
    at = lambda q: (F.col("m") - 1) * F.lit(q)
    ranks = F.array(*[F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), rank(at(q)).cast("bigint").alias("rank")) for name, q in QUANTILES.items() for side, rank in (("low", F.floor), ("high", F.ceil))])
    open_ = materialise(groups.where("m > 0").select("g", F.explode(ranks).alias("r")).select("g", "r.*", F.lit(0).cast("bigint").alias("prefix")), "ranks")
    for k in reversed(range(rounds)):
        shift = k * DIGIT
        own = v.withColumn("prefix", F.shiftright("v", shift + DIGIT)).withColumn("digit", F.shiftright("v", shift).bitwiseAND(F.lit((1 << DIGIT) - 1)))
        if k < rounds - 1:
            own = own.join(open_.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi")
        counts = own.groupBy("g", "prefix", "digit").agg(F.count("*").alias("c"))
        w = Window.partitionBy("g", "prefix").orderBy("digit")
        upto = counts.select("g", "prefix", "digit", F.sum("c").over(w).alias("upto"), "c")
        hit = open_.join(upto, ["g", "prefix"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        open_ = materialise(hit.select("g", "q", "side", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), (F.shiftleft("prefix", DIGIT) + F.col("digit")).alias("prefix")), "ranks")
    side = lambda name, s: F.max(F.when((F.col("q") == name) & (F.col("side") == s), F.col("prefix") + lowest))
    found = open_.groupBy("g").agg(*[side(name, s).alias(f"{name}_{s}") for name in QUANTILES for s in ("low", "high")])
    between = lambda name, q: F.col(f"{name}_low") + (at(q) - F.floor(at(q))) * (F.col(f"{name}_high") - F.col(f"{name}_low"))
    return groups.join(found, "g", "left").select("run_id", "name", "n", "failures", *[between(name, q).cast("double").alias(name) for name, q in QUANTILES.items()])


def reputation_stats(engines: DataFrame) -> DataFrame:
    """Counts for the eight engine categories, missing ones zero; unknown words are a problem count."""
    c = F.col("category")
    cols = [F.count_if(c == k).alias(k.replace("-", "_")) for k in ENGINE_CATEGORIES]
    return engines.groupBy("url_id").agg(*cols, F.count_if(~c.isin(*ENGINE_CATEGORIES)).alias("unknown_category"))


def top_engines(engines: DataFrame, n: int = 256) -> DataFrame:
    rank = F.when(F.col("category") == "malicious", 0).when(F.col("category") == "suspicious", 1).otherwise(2)
    d = engines.select("url_id", "engine", "category").distinct()
    w = Window.partitionBy("url_id").orderBy(rank, "engine", "category")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recent_jobs(jobs: DataFrame, n: int = 20) -> DataFrame:
    """Newest n jobs of every owner; a rank limit, cut before the shuffle."""
    w = Window.partitionBy("owner").orderBy(F.desc("created_at"), F.desc("job_id"))
    return jobs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def quota_usage(requests: DataFrame, per_day: int = 500, per_month: int = 15500) -> DataFrame:
    r = requests.select(F.date_format("ts", "yyyy-MM").alias("month"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    g = r.rollup("month", "day").agg(F.count("*").alias("n")).where("month IS NOT NULL")
    return g.withColumn("exhausted", F.when(F.col("day").isNull(), F.col("n") >= per_month).otherwise(F.col("n") >= per_day))


def ledger_status(jobs: DataFrame) -> DataFrame:
    """Internal word to public status and verdict; blocked or unknown is never shown as benign."""
    s, v = F.col("ledger_status"), F.col("final_verdict")
    status = first_true([(s.isin(*RUNNING_WORDS), "RUNNING"), (s == "FAILED", "FAILED"), ((s == "JUDGED") | s.isin(*SKIPPED_WORDS), "COMPLETED")], "UNKNOWN_STATE")
    verdict = first_true([(status == "RUNNING", F.lit(None).cast("string")), ((s == "JUDGED") & v.isNotNull() & (v != "PENDING"), v)], "UNDETERMINED")
    return jobs.select("job_id", status.alias("status"), verdict.alias("verdict"))


def job_progress(jobs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Layers done of all, judgment outcome, and whether a layer was a stub."""
    f = fragments.where(F.col("layer").isin(*PROGRESS_LAYERS)).groupBy("job_id").agg(
        F.count_distinct(F.when(F.col("status").isin(*DONE_WORDS), F.col("layer"))).alias("done"), F.bool_or(F.col("status") == "STUB").alias("stub"))
    s, v = F.col("ledger_status"), F.col("final_verdict")
    outcome = first_true([(s == "FAILED", "FAILED"), (s.isin(*SKIPPED_WORDS), "SKIPPED"),
                          ((s == "JUDGED") & v.isNotNull() & (v != "PENDING"), "COMPLETED"), (s == "JUDGED", "UNAVAILABLE"),
                          (s.isin("FINAL_DONE", "COLLECT_SKIPPED"), "RUNNING")], "PENDING")
    # The judgment is one more step after the layers.
    done = F.coalesce("done", F.lit(0)) + F.when(outcome.isin("COMPLETED", "SKIPPED"), 1).otherwise(0)
    return jobs.join(f, "job_id", "left").select("job_id", done.alias("done"), F.lit(len(PROGRESS_LAYERS) + 1).alias("total"),
                                                 F.coalesce("stub", F.lit(False)).alias("stub"), outcome.alias("outcome"))


def run_snapshot(records: DataFrame, worker: DataFrame) -> DataFrame:
    """``KIND#id`` keys split, the id's number numeric so that it orders right; a broken worker overrides an open status."""
    k = F.split_part("key", F.lit("#"), F.lit(1))
    num = F.regexp_replace(F.split_part("key", F.lit("#"), F.lit(2)), "^[^0-9]+", "").try_cast("bigint")
    r = records.select("run_id", k.alias("kind"), num.alias("num"), "status").join(worker, "run_id", "left")
    broken = F.col("worker_state").isin("Failed", "Cancelled", "TimedOut", "Cancelling")
    final = F.when(broken & (F.col("status") != "completed"), F.lit("failed")).otherwise(F.col("status"))
    return r.select("run_id", "kind", "num", final.alias("status"))
