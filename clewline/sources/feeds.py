"""Feed and dataset readers, feed union and checks, and sinks."""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.logic import first_true
from ..operators.domains import etld1
from ..operators.url_checks import feed_active_flag, with_rejection
from ..refdata import SuffixIndex
from ..session import materialise

FEED_COLUMNS = ("url", "label", "category", "source", "source_id", "source_status", "collected_at")
REQUIRED_FIELDS = ("label", "category", "source", "collected_at")
DATASET_COLUMNS = ("url", "sources", "source_status", "first_seen")


def _text(cols) -> StructType:
    return StructType([StructField(c, StringType()) for c in cols])


def parse_commented_csv(lines: DataFrame, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """CSV lines whose column names sit in a ``# id,...`` comment; wrong arity goes to skipped verbatim."""
    named = lines.where(F.col("value").startswith("#")).select(F.trim(F.regexp_replace("value", "^#+", "")).alias("h")).where(F.col("h").startswith("id,"))
    head = named.first()
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cols = [c.strip() for c in head["h"].split(",")] if head else []
    if not set(required) <= set(cols):
        return body.sparkSession.createDataFrame([], _text(required)), body.select(F.col("value").alias("line"))
    schema = ", ".join(f"`{c}` STRING" for c in cols) + ", `_bad` STRING"
    parsed = body.select("value", F.from_csv("value", schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    good = parsed.where("r._bad IS NULL").select(*[F.coalesce(F.col("r")[c], F.lit("")).alias(c) for c in cols])
    return good, parsed.where("r._bad IS NOT NULL").select(F.col("value").alias("line"))


def read_feed_commented_csv(spark: SparkSession, path: str, required=("id", "dateadded", "url", "url_status")):
    return parse_commented_csv(spark.read.text(path), required)


def read_feed_gz_csv(spark: SparkSession, path: str, required=("phish_id", "url", "submission_time")) -> tuple[DataFrame, DataFrame]:
    """Headered CSV (any codec by extension); rows with an empty required field or extra fields are skipped."""
    cols = spark.read.option("header", True).csv(path).columns
    schema = StructType(_text(cols).fields + [StructField("_bad", StringType())])
    d = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", "_bad").option("enforceSchema", True).csv(path)
    empty = F.lit(False)
    for c in required:
        empty = empty | (F.coalesce(F.trim(c), F.lit("")) == "")
    d = d.withColumn("_skip", empty | F.col("_bad").isNotNull())
    return d.where("NOT _skip").drop("_skip", "_bad"), d.where("_skip").drop("_skip")


def read_feed_url_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    t = spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")
    ok = F.col("url").rlike("^https?://")
    return t.where(ok), t.where(~ok).withColumnRenamed("url", "line")


def read_feed_commented_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    t = spark.read.text(path).where(F.trim("value") != "")
    note = F.col("value").startswith("#")
    return t.where(~note).withColumnRenamed("value", "url"), t.where(note).withColumnRenamed("value", "line")


def feed_freshness(lines: DataFrame | None = None, rows: DataFrame | None = None, time_col: str = "submission_time") -> DataFrame:
    """Newest time a feed states: its ``Last updated`` comment, or the newest row time, else empty."""
    if lines is not None:
        t = F.when(F.col("value").startswith("#") & F.col("value").contains("Last updated"), F.trim(F.regexp_replace(F.trim("value"), "^#+|#+$", "")))
        return lines.agg(F.coalesce(F.max(t), F.lit("")).alias("freshness"))
    return rows.agg(F.coalesce(F.max(time_col), F.lit("")).alias("freshness"))


def feed_union(parts: list[DataFrame]) -> DataFrame:
    """Sources as one 7-column table; URL text is not changed, absent columns are empty."""
    out = None
    for p in parts:
        p = p.select(*[c for c in FEED_COLUMNS if c in p.columns])
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FEED_COLUMNS])


def write_feed_dataset(df: DataFrame, path: str) -> None:
    df.select(*FEED_COLUMNS).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def collection_manifest(rows: DataFrame, skipped: DataFrame, files: DataFrame) -> DataFrame:
    """Per source file, hash, sample and skipped counts; a source without rows is a failure."""
    r = rows.groupBy("source").agg(F.count("*").alias("sample_count"))
    s = skipped.groupBy("source").agg(F.count("*").alias("skipped_count"))
    j = files.join(r, "source", "full_outer").join(s, "source", "full_outer")
    n = F.coalesce("sample_count", F.lit(0))
    return j.withColumns({"sample_count": n, "skipped_count": F.coalesce("skipped_count", F.lit(0)),
                          "failure": first_true([(F.col("sha256").isNull(), "no_file"), (n == 0, "no_rows")])})


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def numbered(rows: DataFrame, start: int = 2) -> DataFrame:
    """Row numbers of a written table (path, block, place, ...) in order of file names, blocks and places.

    Each block counts its own rows; a running sum over the blocks, one short row each, says how many come before. Blocks
    are joined by path and start, so neither their number nor the order in which tasks read them matters.
    """
    blocks = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.orderBy("path", "block")) - F.col("n")
    at = blocks.select("path", "block", "first", before.alias("before"))
    j = rows.join(at, ["path", "block"])
    return j.withColumn("row_number", F.lit(start) + F.col("before") + F.col("place") - F.col("first")).drop("path", "block", "place", "first", "before")


def read_url_dataset(spark: SparkSession, path: str) -> DataFrame:
    """URL dataset CSV with row numbers from 2, files in order of name; a missing column is an error that names it."""
    cols = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(DATASET_COLUMNS) - set(cols))
    if missing:
        raise ValueError(f"dataset CSV is missing required columns: {missing}")
    d = spark.read.schema(_text(cols)).option("header", True).option("escape", '"').csv(path)
    # Rows of a block are read one after the other, so within a block their ids grow by one.
    placed = d.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
                      *[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in DATASET_COLUMNS])
    return numbered(materialise(placed, "dataset"))


def read_ranked_domains(docs: DataFrame, index: SuffixIndex, n: int, col: str = "body") -> DataFrame:
    """Ranking entries to (rank, registered domain): bad entries dropped, first entry per domain, best n ranks."""
    e = docs.select("doc_no", F.posexplode(F.from_json(col, "array<struct<rank:string,domain:string>>")).alias("pos", "e"))
    rank = F.when(F.col("e.rank").rlike("^[0-9]+$"), F.col("e.rank").try_cast("bigint"))
    e = e.select("doc_no", "pos", rank.alias("rank"), F.concat(F.lit("https://"), F.regexp_replace(F.lower(F.trim("e.domain")), r"\.+$", "")).alias("u")).where("rank > 0 AND u IS NOT NULL")
    d = etld1(e, index, "u", "domain").where("domain IS NOT NULL")
    best = d.groupBy("domain").agg(F.min_by("rank", F.struct("doc_no", "pos")).alias("rank"))
    return best.orderBy("rank", "domain").limit(n)


BRAND_FIELDS = ("requested_name", "entity_id", "label", "aliases", "expected_domains", "selection_domain", "selection_rank")


def read_brand_table(docs: DataFrame, index: SuffixIndex, col: str = "body") -> tuple[DataFrame, DataFrame]:
    """Brand entries and problem rows: unknown field, duplicate id, duplicate folded label, no usable domain."""
    shape = "struct<requested_name:string,entity_id:string,label:string,aliases:array<string>,expected_domains:array<string>>"
    b = docs.select("doc_no", F.from_json(col, shape).alias("b"), F.json_object_keys(col).alias("keys"))
    b = b.select("doc_no", "keys", "b.*")
    dom = etld1(b.select("doc_no", F.explode("expected_domains").alias("d")).withColumn("u", F.concat(F.lit("https://"), F.lower(F.trim("d")))), index, "u", "domain")
    dom = dom.where("domain IS NOT NULL").select("doc_no", "domain").distinct()
    problem = lambda df, name: df.select("doc_no", F.lit(name).alias("problem"))
    unknown = b.where(F.size(F.array_except("keys", F.array(*[F.lit(f) for f in BRAND_FIELDS]))) > 0)
    twice = lambda key: b.join(b.groupBy(key.alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1"), key == F.col("_k"), "left_semi")
    problems = problem(unknown, "unknown_field").unionByName(problem(twice(F.col("entity_id")), "duplicate_entity_id")).unionByName(
        problem(twice(F.lower("label")), "duplicate_label")).unionByName(problem(b.join(dom, "doc_no", "left_anti"), "no_domain"))
    brands = b.join(dom, "doc_no").join(problems.select("doc_no").distinct(), "doc_no", "left_anti").select("doc_no", "entity_id", "label", "domain")
    return brands, problems


def write_split_result(results: DataFrame, raw_cols: list[str], signal_cols: list[str], keys: list[str], base: str) -> None:
    """Raw and signal columns to two sinks that share trace keys, partitioned by layer."""
    for name, cols in (("raw", raw_cols), ("signals", signal_cols)):
        results.select(*keys, *cols).write.mode("errorifexists").partitionBy("layer").parquet(f"{base}/{name}")


def new_attempts(incoming: DataFrame, existing: DataFrame, keys=("job_id", "attempt")) -> tuple[DataFrame, DataFrame]:
    """Rows that may be written, and rows refused because their attempt is stored already."""
    known = existing.select(*keys).distinct()
    return incoming.join(known, list(keys), "left_anti"), incoming.join(known, list(keys), "left_semi")


def write_attempt_immutable(raws: DataFrame, records: DataFrame, base: str, day: str) -> DataFrame:
    """Raw rows first, records last, each batch in a new folder of its day; an attempt that is stored is refused, never overwritten.

    Returns the refused records. Stored are the attempts of all records written before, of any day.
    """
    spark = raws.sparkSession
    key = ["job_id", "attempt"]
    try:
        known = spark.read.parquet(f"{base}/records").select(*key).distinct()
    except AnalysisException:  # nothing is written yet
        known = spark.createDataFrame([], records.select(*key).schema)
    new, refused = new_attempts(records, known)
    refused = materialise(refused, "refused")
    batch = uuid.uuid4().hex
    raws.join(new.select(*key).distinct(), key, "left_semi").write.mode("errorifexists").parquet(f"{base}/raw/dt={day}/batch={batch}")
    new.write.mode("errorifexists").parquet(f"{base}/records/dt={day}/batch={batch}")
    return refused


def dataset_summary(dataset: DataFrame) -> DataFrame:
    """Totals, and counts by rejection reason, source and status, in one pass of grouping sets."""
    d = with_rejection(dataset).select("reason", feed_active_flag().alias("active"), "sources", "source_status")
    ok = F.col("reason").isNull()
    totals = d.agg(F.count("*").alias("total"), F.count_if("active").alias("active"), F.count_if(ok).alias("eligible"), F.count_if(ok & F.col("active")).alias("active_eligible"))
    t = totals.select(F.explode(F.create_map(*[x for c in totals.columns for x in (F.lit(c), F.col(c))])).alias("value", "n")).select(F.lit("total").alias("dimension"), "value", "n")
    g = d.groupingSets([["reason"], ["sources"], ["source_status"]], "reason", "sources", "source_status").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    dim = F.when(F.col("gid") == 3, "rejected").when(F.col("gid") == 5, "source").otherwise("status")
    val = F.when(F.col("gid") == 3, F.col("reason")).when(F.col("gid") == 5, F.col("sources")).otherwise(F.col("source_status"))
    return t.unionByName(g.select(dim.alias("dimension"), val.alias("value"), "n").where("value IS NOT NULL"))


def dataset_quality(rows: DataFrame, manifest: DataFrame, expected: DataFrame, hashes: DataFrame) -> DataFrame:
    """Problem rows: exact counts, manifest counts, empty required fields, file hashes."""
    n = rows.groupBy("source").agg(F.count("*").alias("n"))
    row = lambda df, check, subject, message: df.select(F.lit(check).alias("check_name"), subject.cast("string").alias("subject"), message.cast("string").alias("message"))
    e = expected.join(n, "source", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> expected")
    m = manifest.join(n, "source", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("NOT (sample_count <=> n)")
    empties = F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED_FIELDS])
    r = rows.select("source_id", F.explode(F.array_compact(empties)).alias("field"))
    h = manifest.join(hashes.withColumnRenamed("sha256", "actual"), "source", "left").where("NOT (sha256 <=> actual)")
    return (row(e, "count", F.col("source"), F.col("n")).unionByName(row(m, "manifest_count", F.col("source"), F.col("n")))
            .unionByName(row(r, "required_field", F.col("source_id"), F.col("field")))
            .unionByName(row(h, "sha256", F.col("source"), F.when(F.col("actual").isNull(), "missing").otherwise("mismatch"))))


def feed_latest_per_source(feed: DataFrame, n: int, time_col: str = "first_seen", tie: str = "url") -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc(time_col), tie)
    return feed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def seeded_sample(rows: DataFrame, seed: str, n: int, col: str = "url") -> DataFrame:
    """Reproducible sample of fixed size: the n smallest seeded hashes."""
    return rows.withColumn("h", F.md5(F.concat(F.lit(seed), F.col(col)))).orderBy("h", col).limit(n)


def scan_candidates(dataset: DataFrame, offset: int, limit: int, active_only: bool = True) -> DataFrame:
    d = with_rejection(dataset).where("reason IS NULL")
    d = d.where(feed_active_flag()) if active_only else d
    return d.orderBy("row_number").offset(offset).limit(limit)


def charset_choice(body: Column, declared: Column) -> tuple[Column, Column]:
    """(charset, source): byte-order mark, HTTP charset, meta tag in the first 1024 bytes, UTF-8."""
    head = F.hex(F.substring(body, 1, 3))
    text = F.decode(F.substring(body, 1, 1024), "ISO-8859-1")
    meta = F.nullif(F.regexp_extract(text, r"(?i)<meta\s[^>]*?charset\s*=\s*[\"']?([a-zA-Z0-9._-]+)", 1), F.lit(""))
    bom = F.when(head.startswith("EFBBBF"), "utf-8-sig").when(head.rlike("^(FFFE|FEFF)"), "utf-16")
    source = first_true([(bom.isNotNull(), "bom"), (F.nullif(declared, F.lit("")).isNotNull(), "http_charset"), (meta.isNotNull(), "html_meta")], "default")
    return F.coalesce(bom, F.nullif(declared, F.lit("")), meta, F.lit("utf-8")), source


def decode_html_bytes(pages: DataFrame, body: str = "body", declared: str = "declared_charset") -> DataFrame:
    """Page bytes to text. UTF-8 stays in the JVM; other charsets go through one Arrow function."""
    from ..functions.udfs import decode_html_udf
    name, source = charset_choice(F.col(body), F.col(declared))
    p = pages.withColumns({"encoding": F.lower(name), "encoding_source": source})
    utf8 = F.col("encoding").isin("utf-8", "utf8")
    plain = p.where(utf8).withColumn("text", F.make_valid_utf8(F.col(body).cast("string")))
    other = p.where(~utf8).withColumn("text", decode_html_udf(F.col(body), F.col("encoding")))
    return plain.unionByName(other).withColumn("loss", F.contains("text", F.lit("�")))
