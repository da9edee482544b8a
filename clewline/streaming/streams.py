"""Structured Streaming forms of the log and ledger operators, and a bounded runner for tests and backfills.

Aggregates are closed by the watermark and leave the state with it. What needs the order of a log keeps the rows that may
still be overtaken in a written table and releases them by the clock of the data. Everything runs on Spark expressions.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..session import scratch_path

TERMINAL = ("completed", "failed")
#: Batches after which the last rows of all keys are written together again.
COMPACT = 10


def arrivals(rows: DataFrame, time: str, files: int = 6, ahead: str = "400 days") -> DataFrame:
    """A table as a file stream of several batches that come out of order, timestamps as instants.

    Stretches of time are written one after the other, each second one before the one it follows; a last file holds one row
    with nothing but a time ``ahead`` of all, which closes what the watermark closes.
    """
    spark, root = rows.sparkSession, scratch_path(rows.sparkSession, "arrivals")
    rows = rows.select([F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in rows.dtypes])
    low, high = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    if low is None:
        low = high = 0
    part = F.least(F.floor((F.unix_micros(time) - low) * files / (high - low + 1)).cast("int"), F.lit(files - 1))
    cut = rows.withColumn("_part", F.coalesce(part, F.lit(0)))
    order = [k ^ 1 if k ^ 1 < files else k for k in range(files)]
    for k in order:
        cut.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(root)
    last = spark.range(1).select([(F.timestamp_micros(F.lit(high)) + F.expr(f"INTERVAL {ahead}")).alias(c) if c == time else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    last.write.mode("append").parquet(root)
    written = len(spark.read.schema(rows.schema).parquet(root).inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, written // (files + 1))).parquet(root)


def present(df: DataFrame, key: str, time: str) -> DataFrame:
    """Rows with a key. The condition reads the time, so rows that only move the clock have moved it by then."""
    return df.where(F.when(F.col(time).isNotNull(), F.col(key).isNotNull()).otherwise(False))


def run_all(df: DataFrame, mode: str, out: str, write) -> StreamingQuery:
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def drain(df: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there now and return its result table.

    Each batch overwrites its own folder, so a retried batch leaves no copies. Update mode
    keeps each key's last row; append mode has every row once.
    """
    spark, out = df.sparkSession, scratch_path(df.sparkSession, "stream")
    run_all(df, mode, out, lambda batch, no: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={no}"))
    rows = spark.read.parquet(f"{out}/rows")
    if keys:
        cols = [c for c in df.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("x")).select(*keys, "x.*")
    return rows.drop("batch")


def stream_request_state(events: DataFrame) -> DataFrame:
    """State per request; the first terminal event settles it, later ones are ignored."""
    end = F.col("state").isin(*TERMINAL)
    return events.groupBy("capture_id", "request_id").agg(F.coalesce(
        F.min_by(F.when(end, F.col("state")), F.when(end, F.col("sequence"))), F.max_by("state", "sequence")).alias("state"))


def stream_first_wins(items: DataFrame, keys: list[str], time: str = "ts", delay: str = "30 days") -> DataFrame:
    """First item per key wins; keys are remembered for the delay."""
    return present(items.withWatermark(time, delay), keys[0], time).dropDuplicatesWithinWatermark(keys)


class ChangeFeed:
    """A log's rows (key, sequence, clock, status, body) to those that differ from the one before of their key; nothing after a terminal status.

    Rows may come up to ``delay`` of the clock (a number that grows with the sequence) after others that follow them. Until
    then they wait in a written table, so what is released is in order whatever files and batches it came in; a row that
    comes later still is written to ``late`` and counted, not mixed in. Per key the last released row is kept: every batch
    writes those that changed, every ``COMPACT``-th all of them. All steps are joins and windows over tables named by
    their batch, so a batch that is tried again replaces itself.
    """

    def __init__(self, spark: SparkSession, root: str, delay: int):
        self.spark, self.root, self.delay = spark, root, delay

    def _path(self, name: str, no: int) -> str:
        return f"{self.root}/{name}/batch={no}"

    def _read(self, name: str, schema, *batches: int) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*[self._path(name, b) for b in batches])

    def step(self, batch: DataFrame, no: int, closing: bool = False) -> None:
        rows = batch.select("key", "sequence", "clock", "status", "body")
        kept = "key string, sequence bigint, digest string, ended boolean, batch int"
        before = self._read("clock", "top bigint, batch int", *([no - 1] if no else []))
        released = F.coalesce(F.max("top") - self.delay, F.lit(-(1 << 62)))
        floor = before.agg(released.alias("floor")).first()["floor"]
        waiting = self._read("waiting", rows.schema, *([no - 1] if no else [])).select(rows.columns)
        late = F.col("clock") <= floor
        both = waiting.unionByName(rows.where(~late))
        top = both.agg(F.max("clock")).first()[0]
        top = max(x for x in (top, floor + self.delay if no else None, -(1 << 61)) if x is not None)
        ready = F.lit(True) if closing else F.col("clock") <= top - self.delay

        start = (no - 1) // COMPACT * COMPACT if no else 0
        last = self._read("last", kept, *range(start, no))
        last = last.groupBy("key").agg(F.max_by(F.struct("sequence", "digest", "ended"), "batch").alias("x")).select("key", "x.*")
        go = both.where(ready & F.col("key").isNotNull())
        digest = F.concat_ws("|", F.coalesce("status", F.lit("")), F.coalesce("body", F.lit("")))
        go = go.select("*", digest.alias("digest"), F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False)).alias("ended"), F.lit(True).alias("new"))
        known = last.join(go.select("key").distinct(), "key", "left_semi").select("key", "sequence", "digest", "ended", F.lit(False).alias("new"))
        w = Window.partitionBy("key").orderBy("sequence", "new")
        past = F.coalesce(F.max("ended").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        seen = go.unionByName(known, allowMissingColumns=True).select(
            "*", past.alias("over"), (~F.col("digest").eqNullSafe(F.lag("digest").over(w))).alias("changed"))
        seen.where("new and changed and not over").select("key", "sequence", "status", "body").write.mode("overwrite").parquet(self._path("rows", no))

        newest = seen.groupBy("key").agg(F.max_by(F.struct("sequence", "digest"), F.struct("sequence", "new")).alias("x"), F.bool_or("ended").alias("ended"))
        newest = newest.select("key", "x.*", "ended")
        if no % COMPACT == 0:
            newest = newest.unionByName(last.join(newest, "key", "left_anti"))
        newest.write.mode("overwrite").parquet(self._path("last", no))
        both.where(~ready).write.mode("overwrite").parquet(self._path("waiting", no))
        rows.where(late & F.col("key").isNotNull()).write.mode("overwrite").parquet(self._path("late", no))
        self.spark.createDataFrame([(top,)], "top bigint").write.mode("overwrite").parquet(self._path("clock", no))

    def result(self, name: str = "rows") -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}").drop("batch")


def stream_changes_only(snapshots: DataFrame, delay: int) -> tuple[DataFrame, DataFrame]:
    """Changes, and late rows, of a stream (key, sequence, clock, status, body) that is run to its end and closed; see :class:`ChangeFeed`."""
    out = scratch_path(snapshots.sparkSession, "changes")
    feed, last = ChangeFeed(snapshots.sparkSession, out, delay), [-1]

    def step(batch: DataFrame, no: int) -> None:
        feed.step(batch, no)
        last[0] = no

    run_all(snapshots, "append", out, step)
    feed.step(snapshots.sparkSession.createDataFrame([], snapshots.schema), last[0] + 1, closing=True)
    return feed.result(), feed.result("late")


def stream_negative_ttl(answers: DataFrame, delay: str = "1 minute") -> DataFrame:
    """A negative answer (host, observed_at, valid_until_ms) makes a host unusable until it ends; then a row says unknown again.

    Answers that meet before they end are one stretch, whatever their order: a session window whose gap is each answer's own
    life. Both rows come when the watermark has passed the end, and the stretch leaves the state.
    """
    a = present(answers.withWatermark("observed_at", delay), "host", "observed_at")
    life = F.concat((F.col("valid_until_ms") - F.unix_millis("observed_at")).cast("string"), F.lit(" milliseconds"))
    g = a.groupBy(F.session_window("observed_at", life), "host").agg(F.count("*").alias("answers"))
    rows = F.array(F.struct(F.lit(True).alias("usable"), F.col("session_window.start").alias("at")), F.struct(F.lit(False).alias("usable"), F.col("session_window.end").alias("at")))
    return g.select("host", "answers", F.explode(rows).alias("x")).select("host", "x.usable", "x.at", "answers")


def stream_daily_quota(requests: DataFrame, limit: int, delay: str = "1 hour") -> DataFrame:
    """Requests per provider and day when the day is over, and whether they reached the limit."""
    r = present(requests.withWatermark("ts", delay), "provider", "ts")
    g = r.groupBy(F.window("ts", "1 day"), "provider").agg(F.count("*").alias("n"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "provider", "n", (F.col("n") >= limit).alias("exhausted"))


def stream_capture_summary(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Per capture session when it is over: events, ended requests, bytes. What never ended is unfinished then."""
    c = F.col("state")
    e = present(events.withWatermark("ts", delay), "capture_id", "ts")
    g = e.groupBy(F.session_window("ts", gap), "capture_id").agg(
        F.count_if(c == "request").alias("requests"), F.count_if(c == "completed").alias("completed"), F.count_if(c == "failed").alias("failed"), F.sum("body_bytes").alias("bytes"))
    done = F.col("completed") + F.col("failed")
    return g.select("capture_id", F.col("session_window.start").alias("opened_at"), "requests", "completed", "failed", F.greatest(F.col("requests") - done, F.lit(0)).alias("unfinished"), "bytes")


def stream_job_progress(fragments: DataFrame, layers: tuple[str, ...], done_words: tuple[str, ...]) -> DataFrame:
    """Distinct layers done per job, one flag per layer so that repeats do not count twice."""
    done = F.col("status").isin(*done_words)
    flags = fragments.groupBy("job_id").agg(*[F.max(F.when(done & (F.col("layer") == x), 1).otherwise(0)).alias(x) for x in layers])
    total = F.lit(0)
    for x in layers:
        total = total + F.col(x)
    return flags.select("job_id", total.alias("done"))
