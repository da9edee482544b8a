"""Feed, dataset and sink queries. Readers run over files that Spark writes from the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..session import scratch_path
from ..sources import feeds as S
from .q_urls import REJECTED
from .registry import query, with_fixtures as W
from .sqlparts import dom


def put_text(df, label: str, **options) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").options(**options).text(path)
    return path


def outcome(rows, skipped, *cols):
    """Rows and skipped lines in one relation, for comparison."""
    a = rows.select(*cols, F.lit("row").alias("outcome"))
    return a.unionByName(skipped.select(F.col("line").alias(cols[-1]), F.lit("skipped").alias("outcome")), allowMissingColumns=True)


HEAD = "SELECT '# Last updated: 2024-01-31 10:00:00 (UTC) #' AS value FROM region WHERE r_regionkey = 0 UNION ALL SELECT '# id,dateadded,url,url_status' FROM region WHERE r_regionkey = 0"
CSV_LINES = """SELECT CASE page_id % 7 WHEN 3 THEN concat('"', CAST(page_id AS STRING), '","only","three"') WHEN 5 THEN concat('"', CAST(page_id AS STRING), '","d","', url, '","online","extra"')
  ELSE concat('"', CAST(page_id AS STRING), '","2024-01-', CAST(page_id % 28 + 1 AS STRING), '","', url, '","', CASE WHEN page_id % 2 = 0 THEN '' ELSE 'on,line' END, '"') END AS value FROM pages"""


@query("read_feed_commented_csv", f"""
SELECT CASE WHEN page_id % 7 NOT IN (3, 5) THEN page_id::VARCHAR END AS id, CASE WHEN page_id % 7 NOT IN (3, 5) THEN CASE WHEN page_id % 2 = 0 THEN '' ELSE 'on,line' END END AS url_status,
  CASE WHEN page_id % 7 NOT IN (3, 5) THEN url ELSE value END AS url, CASE WHEN page_id % 7 NOT IN (3, 5) THEN 'row' ELSE 'skipped' END AS outcome
FROM pages JOIN (SELECT value, try_cast(regexp_extract(value, '^"([0-9]+)"', 1) AS BIGINT) AS page_id FROM ({CSV_LINES})) USING (page_id)""")
def _(t):
    path = put_text(t.sql(HEAD).unionByName(t.sql(CSV_LINES)), "feed-csv")
    return outcome(*S.read_feed_commented_csv(t.spark, path), "id", "url_status", "url")


@query("read_feed_gz_csv", "SELECT page_id::VARCHAR AS phish_id, CASE WHEN page_id % 6 = 1 THEN 'skipped' ELSE 'row' END AS outcome FROM pages")
def _(t):
    path = scratch_path(t.spark, "feed-gz")
    t.pages.select(F.col("page_id").cast("string").alias("phish_id"), F.when(F.col("page_id") % 6 == 1, "").otherwise(F.col("url")).alias("url"), F.lit("2024-01-02T03:04:05").alias("submission_time")).write.option(
        "header", True).option("compression", "gzip").csv(path)
    rows, skipped = S.read_feed_gz_csv(t.spark, path)
    return rows.select("phish_id", F.lit("row").alias("outcome")).unionByName(skipped.select("phish_id", F.lit("skipped").alias("outcome")))


LINES = "SELECT CASE page_id % 5 WHEN 0 THEN concat('  ', url, ' ') WHEN 1 THEN 'ftp://x/y' WHEN 2 THEN '   ' WHEN 3 THEN concat('# ', url) ELSE url END AS value FROM pages"


@query("read_feed_url_lines", f"SELECT trim(value) AS url, CASE WHEN trim(value) LIKE 'http%' THEN 'row' ELSE 'skipped' END AS outcome FROM ({LINES}) WHERE trim(value) <> ''")
def _(t):
    return outcome(*S.read_feed_url_lines(t.spark, put_text(t.sql(LINES), "feed-lines")), "url")


@query("read_feed_commented_lines", f"SELECT value AS url, CASE WHEN value LIKE '#%' THEN 'skipped' ELSE 'row' END AS outcome FROM ({LINES}) WHERE trim(value) <> ''")
def _(t):
    return outcome(*S.read_feed_commented_lines(t.spark, put_text(t.sql(LINES), "feed-notes")), "url")


@query("feed_freshness", "SELECT 'comment' AS source, 'Last updated: 2024-01-31 10:00:00 (UTC)' AS freshness UNION ALL SELECT 'rows', strftime(max(o_orderdate), '%Y-%m-%d') FROM orders")
def _(t):
    lines = t.spark.read.text(put_text(t.sql(HEAD).unionByName(t.sql(CSV_LINES)), "feed-csv"))
    rows = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("submission_time"))
    return S.feed_freshness(lines=lines).select(F.lit("comment").alias("source"), "freshness").unionByName(S.feed_freshness(rows=rows).select(F.lit("rows").alias("source"), "freshness"))


FEED7 = """SELECT url, 'malicious' AS label, CASE page_id % 9 WHEN 4 THEN '' ELSE 'phishing' END AS category, concat('feed-', CAST(page_id % 3 AS STRING)) AS source, CAST(page_id AS STRING) AS source_id, 'online' AS source_status, '2024-01-02' AS collected_at FROM pages"""


@query("feed_union", f"SELECT url, label, category, source, source_id, CASE source WHEN 'feed-1' THEN '' ELSE source_status END AS source_status, collected_at FROM ({FEED7})")
def _(t):
    f = t.sql(FEED7)
    return S.feed_union([f.where("source = 'feed-0'"), f.where("source = 'feed-1'").drop("source_status"), f.where("source = 'feed-2'"), f.where("source = 'failed'")])


@query("write_feed_dataset", FEED7)
def _(t):
    path = scratch_path(t.spark, "dataset")
    S.write_feed_dataset(t.sql(FEED7), path)
    d = t.spark.read.option("header", True).option("escape", '"').csv(path)
    return d.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in S.FEED_COLUMNS])


@query("collection_manifest", f"""
SELECT 'feed-' || k AS source, CASE WHEN k < 3 THEN (SELECT count(*) FROM pages WHERE page_id % 3 = k AND page_id % 9 <> 4) ELSE 0 END AS sample_count, CASE WHEN k < 3 THEN (SELECT count(*) FROM pages WHERE page_id % 3 = k AND page_id % 9 = 4) ELSE 0 END AS skipped_count,
  CASE k WHEN 3 THEN 'no_rows' END AS failure, true AS hashed FROM range(4) r(k)""")
def _(t):
    f = t.sql(FEED7)
    path = scratch_path(t.spark, "raw")
    t.sql("SELECT concat('feed-', CAST(r_regionkey AS STRING)) AS source, r_name AS body FROM region WHERE r_regionkey < 4").repartition("source").write.partitionBy("source").text(path)
    files = S.file_hashes(t.spark, path).select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), "sha256").groupBy("source").agg(F.min("sha256").alias("sha256"))
    m = S.collection_manifest(f.where("category <> ''"), f.where("category = ''"), files)
    return m.select("source", "sample_count", "skipped_count", "failure", (F.length("sha256") == 64).alias("hashed"))


DATASET = "SELECT row_number, url, source AS sources, source_status, CAST(first_seen AS STRING) AS first_seen FROM feed"


@query("read_url_dataset", W(f"SELECT row_number() OVER (ORDER BY row_number) + 1 AS row_number, url, sources, trim(source_status) AS source_status FROM ({DATASET})", "feed"))
def _(t):
    # Files whose names follow the row numbers while their sizes do not.
    path = scratch_path(t.spark, "urls")
    rows = t.sql(DATASET, "feed").withColumn("_part", F.floor(F.sqrt("row_number") / 4)).repartitionByRange(5, "_part", "row_number").sortWithinPartitions("row_number")
    rows.drop("row_number", "_part").write.option("header", True).csv(path)
    return S.read_url_dataset(t.spark, path).select("row_number", "url", "sources", "source_status")


RANK_DOCS = """SELECT page_id AS doc_no, concat('[{"rank":', CAST(page_id * 7 % 251 AS STRING), ',"domain":"', regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '."},{"rank":"x","domain":"a.com"},{"rank":5,"domain":"localhost"}]') AS body FROM pages"""


@query("read_ranked_domains", W("""
SELECT rank, domain FROM (SELECT reg AS domain, arg_min(rank, page_id) AS rank FROM (SELECT page_id, page_id * 7 % 251 AS rank, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages) JOIN d USING (host) WHERE rank > 0 GROUP BY 1) ORDER BY rank, domain LIMIT 50""",
  "suffix_rules", dom("d", "SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages")))
def _(t):
    return S.read_ranked_domains(t.sql(RANK_DOCS), R.suffix_index(t.suffix_rules), 50)


BRAND_DOCS = """SELECT s_suppkey AS doc_no, concat('{"requested_name":"r","entity_id":"Q', CAST(CASE WHEN s_suppkey % 10 = 3 THEN 3 ELSE s_suppkey END AS STRING), '","label":"', CASE WHEN s_suppkey % 10 = 4 THEN CASE WHEN s_suppkey > 50 THEN 'ACME' ELSE 'acme' END ELSE s_name END,
  '","aliases":[],"expected_domains":[', CASE WHEN s_suppkey % 10 = 5 THEN '' ELSE concat('"www.s', CAST(s_suppkey AS STRING), '.example.com"') END, ']', CASE WHEN s_suppkey % 10 = 6 THEN ',"odd":1' ELSE '' END, '}') AS body FROM supplier"""


@query("read_brand_table", """
WITH s AS (SELECT s_suppkey AS doc_no, s_suppkey % 10 AS k FROM supplier), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1)
SELECT doc_no, CASE k WHEN 3 THEN CASE WHEN n > 1 THEN 'duplicate_entity_id' END WHEN 4 THEN CASE WHEN n > 1 THEN 'duplicate_label' END WHEN 5 THEN 'no_domain' WHEN 6 THEN 'unknown_field' END AS problem,
  CASE WHEN k IN (5, 6) OR (k IN (3, 4) AND n > 1) THEN NULL ELSE 'example.com' END AS domain FROM s JOIN n USING (k)""")
def _(t):
    brands, problems = S.read_brand_table(t.sql(BRAND_DOCS), R.suffix_index(t.suffix_rules))
    return brands.select("doc_no", "domain").unionByName(problems, allowMissingColumns=True)


@query("write_split_result", W("SELECT request_id, signal_no, layer, status FROM record_signals", "record_signals"))
def _(t):
    base = scratch_path(t.spark, "split")
    S.write_split_result(t.record_signals, ["error_code"], ["status", "detected"], ["request_id", "signal_no", "layer"], base)
    sig, raw = t.spark.read.parquet(f"{base}/signals"), t.spark.read.parquet(f"{base}/raw")
    return raw.join(sig, ["request_id", "signal_no", "layer"]).select("request_id", "signal_no", "layer", "status")


INCOMING = "SELECT o_orderkey AS job_id, 1 AS attempt, o_orderstatus AS payload FROM orders"
STORED = "SELECT DISTINCT l_orderkey AS job_id, 1 AS attempt, CAST(NULL AS STRING) AS payload FROM lineitem WHERE l_returnflag = 'R'"


@query("write_attempt_immutable", f"SELECT job_id, attempt, CASE WHEN job_id IN (SELECT job_id FROM ({STORED})) THEN 'refused' ELSE 'written' END AS outcome FROM ({INCOMING})")
def _(t):
    base = scratch_path(t.spark, "attempts")
    S.write_attempt_immutable(t.sql(STORED), t.sql(STORED), base, "2024-01-02")
    incoming = t.sql(INCOMING)
    refused = S.write_attempt_immutable(incoming, incoming.select("job_id", "attempt"), base, "2024-01-02")
    # Of the second batch of that day the raw rows tell what was written.
    written = t.spark.read.parquet(f"{base}/raw").where("payload IS NOT NULL")
    return written.select("job_id", "attempt", F.lit("written").alias("outcome")).unionByName(refused.select("job_id", "attempt", F.lit("refused").alias("outcome")))


ACTIVE = "(len(list_intersect(list_transform(string_split(source_status, '|'), lambda x: lower(trim(x))), ['active', 'online', 'yes'])) > 0 AND len(list_intersect(list_transform(string_split(source_status, '|'), lambda x: lower(trim(x))), ['inactive', 'offline'])) = 0)"


@query("dataset_summary", W("""
SELECT 'total' AS dimension, 'total' AS value, count(*) AS n FROM x UNION ALL SELECT 'total', 'active', count(*) FILTER (active) FROM x UNION ALL SELECT 'total', 'eligible', count(*) FILTER (reason IS NULL) FROM x
UNION ALL SELECT 'total', 'active_eligible', count(*) FILTER (active AND reason IS NULL) FROM x UNION ALL SELECT 'rejected', reason, count(*) FROM x WHERE reason IS NOT NULL GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM x GROUP BY 2 UNION ALL SELECT 'status', source_status, count(*) FROM x GROUP BY 2""", "feed", f"x AS (SELECT *, {ACTIVE} AS active FROM ({REJECTED}))"))
def _(t):
    return S.dataset_summary(t.sql(DATASET, "feed"))


@query("dataset_quality", f"""
WITH f AS ({FEED7}), n AS (SELECT source, count(*) AS n FROM f GROUP BY 1)
SELECT 'count' AS check_name, source AS subject, n::VARCHAR AS message FROM n WHERE n <> 83 UNION ALL SELECT 'manifest_count', source, n::VARCHAR FROM n WHERE source <> 'feed-0'
UNION ALL SELECT 'required_field', source_id, 'category' FROM f WHERE category = '' UNION ALL SELECT 'sha256', source, CASE source WHEN 'feed-1' THEN 'mismatch' ELSE 'missing' END FROM n WHERE source <> 'feed-0'""")
def _(t):
    f = t.sql(FEED7)
    n = f.groupBy("source").agg(F.count("*").alias("c"))
    manifest = n.select("source", F.when(F.col("source") == "feed-0", F.col("c")).otherwise(F.lit(1)).alias("sample_count"), F.sha2("source", 256).alias("sha256"))
    hashes = n.where("source <> 'feed-2'").select("source", F.when(F.col("source") == "feed-1", "bad").otherwise(F.sha2("source", 256)).alias("sha256"))
    return S.dataset_quality(f, manifest, n.select("source", F.lit(83).alias("expected")), hashes)


@query("feed_latest_per_source", W("SELECT source, url, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seen_at DESC, sighting_id) AS rank FROM sightings) WHERE rank <= 25", "sightings"))
def _(t):
    return S.feed_latest_per_source(t.sightings, 25, "seen_at", "sighting_id").select("source", "url", "rank")


@query("seeded_sample", "SELECT url FROM pages ORDER BY md5('7' || url), url LIMIT 40")
def _(t):
    return S.seeded_sample(t.pages, "7", 40).select("url")


@query("scan_candidates", W(f"SELECT row_number, url FROM ({REJECTED}) WHERE reason IS NULL AND {ACTIVE} ORDER BY row_number LIMIT 30 OFFSET 5", "feed"))
def _(t):
    return S.scan_candidates(t.sql(DATASET, "feed"), 5, 30).select("row_number", "url")


@query("decode_html_bytes")
def _(t):
    latin = F.col("page_id") % 4 == 1
    body = F.when(latin, F.encode("html", "ISO-8859-1")).when(F.col("page_id") % 4 == 2, F.encode("html", "UTF-16")).otherwise(F.encode("html", "UTF-8"))
    p = t.pages.select("page_id", body.alias("body"), F.when(latin, "iso-8859-1").alias("declared_charset"))
    return S.decode_html_bytes(p).select("page_id", "encoding", "encoding_source", "loss", F.length("text").alias("chars"))
