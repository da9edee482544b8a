"""Redirect journeys, HTTP header facts and certificate observations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import url as U
from ..functions.logic import first_true, not3
from ..refdata import DOWNLOAD_EXTENSIONS, EXECUTABLE_MIMES, MIME_ALIASES, SuffixIndex
from .domains import etld1_or_host

# Protocol versions counted as legacy.
LEGACY_TLS = ("SSLv2", "SSLv3", "TLSv1", "TLSv1.1")


def _journey(journeys: DataFrame, per_hop: DataFrame) -> DataFrame:
    """Hop aggregates joined to every journey; nothing observed at all stays NULL."""
    return journeys.join(per_hop, "journey_id", "left").withColumn(
        "_seen", F.col("hop_count").isNotNull() | F.col("final_url").isNotNull())


def _journey_urls(journeys: DataFrame, hops: DataFrame) -> DataFrame:
    """URLs of a journey, its own as hop 0, dealt out by journey before hosts are taken apart.

    Narrow rows that many journeys share a URL of arrive in few partitions; what follows a journey needs this order anyway.
    Their number is given, as partitions are joined by their bytes else, and short URLs take long to be taken apart.
    """
    urls = journeys.select("journey_id", F.lit(0).alias("hop_no"), F.col("original_url").alias("u"), F.lit(True).alias("own")).unionByName(
        hops.select("journey_id", "hop_no", F.col("destination_url").alias("u"), F.lit(False).alias("own")))
    return urls.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "journey_id")


def journey_urls(journeys: DataFrame, hops: DataFrame, index: SuffixIndex) -> DataFrame:
    """journey_id, hop_no, u, own, host, dom of the URLs of journeys; a table that has them is returned as is.

    Write it once where several checks read it: they take it in place of ``hops``.
    """
    if "dom" in hops.columns:
        return hops
    return etld1_or_host(_journey_urls(journeys, hops), index, "u", "dom", "host")


def redirect_chain(journeys: DataFrame, hops: DataFrame) -> DataFrame:
    agg = hops.groupBy("journey_id").agg(
        F.count("*").alias("hop_count"), F.max_by("destination_url", "hop_no").alias("last_destination"))
    j = _journey(journeys, agg)
    return j.select("journey_id", F.when(F.col("_seen"), F.col("hop_count").isNotNull()).alias("detected"),
                    F.coalesce("hop_count", F.lit(0)).alias("redirect_count"), "last_destination", "final_url")


def redirect_domain_change(journeys: DataFrame, hops: DataFrame, index: SuffixIndex) -> DataFrame:
    """Domain changes along a journey: each hop is compared with the one before it."""
    d = journey_urls(journeys, hops, index)
    w = Window.partitionBy("journey_id").orderBy("hop_no")
    step = d.withColumn("changed", (F.col("hop_no") > 0) & ~F.col("dom").eqNullSafe(F.lag("dom").over(w)))
    agg = step.groupBy("journey_id").agg(
        F.count_if("changed").alias("changes"), F.count_distinct("dom").alias("unique_domains"),
        F.min_by("dom", "hop_no").alias("original_domain"), F.max_by("dom", "hop_no").alias("final_domain"),
        F.nullif(F.count("*") - 1, F.lit(0)).alias("hop_count"))
    j = _journey(journeys, agg)
    return j.select("journey_id", F.when(F.col("_seen"), F.col("changes") > 0).alias("detected"), "changes", "unique_domains",
                    "original_domain", "final_domain", (F.col("original_domain") != F.col("final_domain")).alias("final_changed"))


def redirect_to_ip(journeys: DataFrame, hops: DataFrame) -> DataFrame:
    split = "dom" in hops.columns
    h = hops.where("NOT own").select("journey_id", "hop_no", F.col("u").alias("destination_url"), F.col("host").alias("h")) if split else U.with_host(hops, "destination_url", "h")
    ip = U.ip_kind(F.col("h")).isNotNull()
    agg = h.groupBy("journey_id").agg(
        F.count("*").alias("hop_count"), F.bool_or(ip).alias("hit"),
        F.min_by(F.when(ip, F.col("destination_url")), F.when(ip, F.col("hop_no"))).alias("destination_url"),
        F.min_by(F.when(ip, F.col("h")), F.when(ip, F.col("hop_no"))).alias("destination_ip"))
    j = _journey(journeys, agg)
    return j.select("journey_id", F.when(F.col("_seen"), F.coalesce("hit", F.lit(False))).alias("detected"), "destination_url", "destination_ip")


def shortener_journey(journeys: DataFrame, hops: DataFrame, index: SuffixIndex, shorteners: DataFrame) -> DataFrame:
    d = journey_urls(journeys, hops, index).join(shorteners.withColumnRenamed("domain", "s"), F.col("dom") == F.col("s"), "left")
    agg = d.groupBy("journey_id").agg(
        F.count("s").alias("matches"), F.min_by("s", F.when(F.col("s").isNotNull(), F.col("hop_no"))).alias("shortener"),
        F.nullif(F.count("*") - 1, F.lit(0)).alias("hop_count"))
    j = _journey(journeys, agg)
    hit = F.col("matches") > 0
    return j.select("journey_id", F.when(hit, True).when(F.col("_seen"), False).alias("detected"), "shortener",
                    F.when(hit & F.col("hop_count").isNotNull(), F.col("final_url")).alias("resolved"), "matches")


def protocol_downgrade(journeys: DataFrame, hops: DataFrame) -> DataFrame:
    s, d = U.scheme(F.col("source_url")), U.scheme(F.col("destination_url"))
    h = hops.withColumns({"down": (s == "https") & (d == "http"), "up": (s == "http") & (d == "https")})
    first = lambda c: F.min_by(F.when(F.col("down"), F.col(c)), F.when(F.col("down"), F.col("hop_no")))
    agg = h.groupBy("journey_id").agg(
        F.count("*").alias("hop_count"), F.count_if("down").alias("downgrades"), F.count_if("up").alias("upgrades"),
        first("source_url").alias("source_url"), first("destination_url").alias("destination_url"))
    j = _journey(journeys, agg)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("journey_id", F.when(F.col("_seen"), F.coalesce("downgrades", F.lit(0)) > 0).alias("detected"),
                    zero("downgrades"), zero("upgrades"), "source_url", "destination_url")


def journey_connected(hops: DataFrame) -> DataFrame:
    """Hops whose source is not where the hop before them ended."""
    w = Window.partitionBy("journey_id").orderBy("hop_no")
    h = hops.withColumn("previous_destination", F.lag("destination_url").over(w)).withColumn("n", F.row_number().over(w))
    return h.where((F.col("n") > 1) & (F.col("source_url") != F.col("previous_destination"))).select(
        "journey_id", "hop_no", "previous_destination", "source_url")


# ---- headers -------------------------------------------------------------------------------

def header_first(pages: DataFrame, name: str, headers: str = "headers", out: str = "value") -> DataFrame:
    """First value of a header by case-insensitive name; ``headers`` is an ordered array of (name, value)."""
    hit = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return pages.withColumn(out, F.get(hit, F.lit(0))["value"])


def mime(col: str) -> Column:
    return F.nullif(F.lower(F.trim(F.split_part(F.col(col), F.lit(";"), F.lit(1)))), F.lit(""))


def mime_type(pages: DataFrame, col: str = "content_type") -> DataFrame:
    return pages.withColumn("mime", mime(col))


def content_disposition(pages: DataFrame, col: str = "disposition") -> DataFrame:
    """Disposition type and file name; quoted separators kept, extended name preferred."""
    v = F.col(col)
    # Parts between semicolons outside quotes; names and values from each part.
    parts = F.transform(F.regexp_extract_all(v, F.lit(r'(?:[^;"]++|"[^"]*+"|")++'), F.lit(0)), lambda x: F.trim(x))
    after = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    value = lambda name: F.regexp_replace(F.get(F.filter(after, lambda x: F.lower(F.regexp_extract(x, r"^([^=\s]+)\s*=", 1)) == name), F.lit(0)), r"^[^=]*=\s*", "")
    ext, plain = value("filename*"), value("filename")
    ext_value = F.when(ext.rlike("^[^']*'[^']*'"), F.regexp_replace(ext, r"^[^']*'[^']*'", "")).otherwise(ext)
    name = F.coalesce(F.nullif(U.percent_decode(F.trim(ext_value)), F.lit("")), F.nullif(F.trim(F.regexp_replace(F.trim(plain), "^[\"']+|[\"']+$", "")), F.lit("")))
    return pages.withColumns({
        "disposition_type": F.nullif(F.lower(F.trim(F.split_part(v, F.lit(";"), F.lit(1)))), F.lit("")), "disposition_filename": name})


def extension_of(name: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.regexp_extract(name, r"\.([^.]*)$", 1))), F.lit(""))


def download_fields(pages: DataFrame) -> DataFrame:
    d = content_disposition(pages)
    seg = F.trim(U.percent_decode(F.regexp_extract(U.path(F.col("final_url")), r"([^/]*)$", 1)))
    d = d.withColumn("filename", F.coalesce("disposition_filename", F.when(seg.contains("."), seg)))
    return d.withColumns({"extension": extension_of(F.col("filename")), "mime": mime("content_type"),
                          "magic_hex": F.when(F.octet_length("body") > 0, F.lower(F.hex(F.substring(F.encode("body", "UTF-8"), 1, 8))))})


def body_identity(pages: DataFrame) -> DataFrame:
    """Size and hash of a complete body only; a cut body keeps the declared length."""
    n = F.octet_length("body")
    return pages.withColumns({
        "size": F.when(n == 0, F.lit(None)).when(F.col("truncated"), F.when(F.col("content_length").rlike("^[0-9]+$"), F.col("content_length").try_cast("bigint"))).otherwise(n.cast("bigint")),
        "sha256": F.when((n > 0) & ~F.col("truncated"), F.sha2("body", 256))})


def content_type_mismatch(pages: DataFrame) -> DataFrame:
    m, d = mime("content_type"), F.col("detected_type")
    same = m == d
    for a, b in MIME_ALIASES:
        same = same | ((m == a) & (d == b)) | ((m == b) & (d == a))
    return pages.select("page_id", m.alias("declared_type"), "detected_type", not3(same).alias("detected"))


def dangerous_download(pages: DataFrame) -> DataFrame:
    d = download_fields(pages)
    ext = F.coalesce(F.col("extension").isin(*DOWNLOAD_EXTENSIONS), F.lit(False))
    kind = F.coalesce(F.col("detected_type").isin(*EXECUTABLE_MIMES), F.lit(False))
    return d.select("page_id", "filename", "extension", F.when(~ext & F.col("detected_type").isNull(), None).otherwise(ext | kind).alias("detected"))


def forced_download(pages: DataFrame) -> DataFrame:
    d = content_disposition(pages)
    return d.select(
        "page_id", F.when(F.col("disposition").isNotNull(), F.coalesce(F.col("disposition_type") == "attachment", F.lit(False)))
        .when(F.col("final_url").isNotNull(), False).alias("detected"),
        F.col("disposition_filename").alias("filename"), extension_of(F.col("disposition_filename")).alias("extension"))


def http_refresh(pages: DataFrame) -> DataFrame:
    v = F.col("refresh")
    delay = F.trim(F.regexp_extract(v, r"^([^;,]*)", 1)).try_cast("double")
    target = F.regexp_extract(v, r"(?i)^[^;,]*[;,]\s*url\s*=\s*(.*)$", 1)
    target = F.nullif(F.regexp_replace(F.trim(target), "^[\"']+|[\"']+$", ""), F.lit(""))
    d = pages.withColumns({"_t": target, "_b": F.coalesce("final_url", "original_url")})
    d = U.with_resolved(d, "_t", "_b", "target_url")
    return d.select("page_id", F.when(v.isNotNull(), True).when(F.col("final_url").isNotNull(), False).alias("detected"),
                    delay.alias("delay_seconds"), "target_url")


def tls_target(pages: DataFrame) -> DataFrame:
    """Host and port whose certificate matters: first https URL of final, current, original."""
    def pick(c):
        u = F.col(c)
        return F.when((U.scheme(u) == "https") & (U.raw_host(u) != ""), F.struct(U.raw_host(u).alias("host"), F.coalesce(U.port_text(u).try_cast("int"), F.lit(443)).alias("port")))
    cols = [c for c in ("final_url", "current_url", "original_url") if c in pages.columns]
    t = F.coalesce(*[pick(c) for c in cols])
    return pages.select("page_id", t.alias("_t")).select("page_id", F.col("_t.host").alias("host"), F.when(F.col("_t").isNotNull(), F.col("_t.port")).otherwise(443).alias("port"))


def error_code_class(errors: DataFrame) -> DataFrame:
    m, k = F.col("message"), F.col("error_type")
    return errors.withColumn("code", first_true([
        (m.contains("TLS target blocked:"), "tls_target_policy_blocked"),
        (k.isin("TimeoutError", "timeout"), "tls_timeout"),
        (k == "gaierror", "tls_dns_resolution_failed"),
        (k.startswith("SSL"), "tls_protocol_error"),
    ], "tls_connection_failed"))


def scan_status(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """failed without a response, partial with any error or a cut body, else completed."""
    has = errors.select("page_id").distinct().withColumn("has_error", F.lit(True))
    j = pages.join(has, "page_id", "left")
    return j.select("page_id", F.when(F.col("status_code").isNull(), "failed").when(F.col("has_error") | F.col("truncated"), "partial").otherwise("completed").alias("status"))


# ---- certificates --------------------------------------------------------------------------

def _days(at: Column, since: Column) -> Column:
    return F.floor((F.unix_micros(at.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / F.lit(86_400_000_000))


def cert_age_days(certs: DataFrame, at: Column) -> DataFrame:
    age = F.when(F.col("has_leaf"), _days(at, F.col("not_before")))
    return certs.select("cert_id", age.alias("age_days"), F.when(age.isNotNull(), "observed").otherwise("unavailable").alias("measurement_state"))


def cert_validity(certs: DataFrame, at: Column) -> DataFrame:
    known = F.col("has_leaf") & F.col("not_before").isNotNull() & F.col("not_after").isNotNull()
    status = F.when(known, F.when(at < F.col("not_before"), "not_valid").when(at > F.col("not_after"), "expired").otherwise("valid"))
    return certs.select("cert_id", status.alias("status"), (status != "valid").alias("detected"))


def cert_hostname_match(certs: DataFrame, sans: DataFrame) -> DataFrame:
    """Host against its names (cert_id, pos, name, kind): exact or one-label wildcard; the subject name only when there is no name list.

    An address is compared with the address names alone, whatever the spelling, and a host with the host names. Where a
    certificate's names have no kind (NULL), all stand for hosts, and an address cannot be told to be among them or not.
    """
    host = F.lower(F.regexp_replace("hostname", r"\.$", ""))
    c = certs.select("cert_id", host.alias("host"), "subject", "has_leaf", U.address_hex(host).alias("ip"))
    s = sans.select("cert_id", "pos", "name", "kind", F.lower(F.regexp_replace("name", r"\.$", "")).alias("n"))
    j = c.join(s, "cert_id", "left")
    base = F.expr("substring(n, 3)")
    wild = F.col("n").startswith("*.") & (F.col("host") == F.concat(F.substring_index("host", ".", 1), F.lit("."), base)) & (F.substring_index("host", ".", 1) != "")
    is_ip = F.col("ip").isNotNull()
    named = F.coalesce(F.col("kind"), F.lit("dns")) == "dns"
    hit = F.when(is_ip, (F.col("kind") == "ip") & (U.address_hex(F.col("n")) == F.col("ip"))).otherwise(named & (wild | (F.col("n") == F.col("host"))))
    j = j.withColumn("hit", F.coalesce(hit, F.lit(False)))
    agg = j.groupBy("cert_id", "host", "subject", "has_leaf", "ip").agg(
        F.count("n").alias("names"), F.count("kind").alias("typed"), F.bool_or("hit").alias("san_hit"), F.min_by(F.when(F.col("hit"), F.col("name")), F.when(F.col("hit"), F.col("pos"))).alias("san_name"))
    cn = F.nullif(F.regexp_extract("subject", r"(?:^|,)CN=([^,]+)", 1), F.lit(""))
    fallback = (F.col("names") == 0) & ~is_ip & cn.isNotNull()
    untyped = (F.col("names") > 0) & (F.col("typed") == 0)
    known = F.col("has_leaf") & (F.col("host") != "")
    matched = F.when(known & ~(untyped & is_ip), F.when(fallback, F.lower(cn) == F.col("host")).otherwise(F.col("san_hit")))
    return agg.select("cert_id", matched.alias("matched"), not3(matched).alias("detected"),
                      F.when(matched, F.when(fallback, cn).otherwise(F.col("san_name"))).alias("matched_name"),
                      first_true([(~F.coalesce(known, F.lit(False)), "unavailable"), (fallback, "subject_name_fallback"), (untyped, "untyped_names")], "typed_names").alias("scope"))


def self_signed(certs: DataFrame) -> DataFrame:
    return certs.select("cert_id", F.when(F.col("has_leaf"), F.col("self_signed")).alias("detected"), F.when(F.col("has_leaf"), F.col("subject")).alias("subject"))


def cert_chain(certs: DataFrame) -> DataFrame:
    return certs.select("cert_id", not3(F.col("chain_valid")).alias("detected"), F.when(F.col("chain_depth") > 0, F.col("chain_depth")).alias("depth"))


def tls_legacy(certs: DataFrame) -> DataFrame:
    return certs.select("cert_id", "tls_version", F.col("tls_version").isin(*LEGACY_TLS).alias("detected"))


def wildcard_cert(certs: DataFrame, sans: DataFrame) -> DataFrame:
    agg = sans.groupBy("cert_id").agg(F.count_if(F.col("name").startswith("*.")).alias("w"), F.count("*").alias("n"))
    j = certs.join(agg, "cert_id", "left")
    leaf = lambda c: F.when(F.col("has_leaf"), F.coalesce(c, F.lit(0)))
    return j.select("cert_id", (leaf("w") > 0).alias("detected"), leaf("w").alias("wildcards"), leaf("n").alias("san_count"))


def ct_first_seen(certs: DataFrame, scts: DataFrame, logs: DataFrame, at: Column) -> DataFrame:
    """Earliest embedded timestamp, else earliest log entry; zero entries differ from unknown."""
    s = scts.groupBy("cert_id").agg(F.min("ts").alias("sct_first"), F.count("*").alias("sct_n"))
    g = logs.groupBy("cert_id").agg(F.min("entry_timestamp").alias("log_first"), F.count("*").alias("log_n"))
    j = certs.join(s, "cert_id", "left").join(g, "cert_id", "left")
    leaf = F.col("has_leaf")
    first = F.when(leaf, F.coalesce("sct_first", "log_first"))
    return j.select("cert_id", first.alias("first_seen"),
                    F.when(leaf & F.col("sct_first").isNotNull(), "embedded_sct").when(leaf & F.col("log_first").isNotNull(), "log").alias("source"),
                    F.when(leaf, F.coalesce("sct_n", F.lit(0))).alias("sct_count"),
                    F.when(leaf & F.col("sct_first").isNull(), F.coalesce("log_n", F.lit(0))).alias("log_entries"), _days(at, first).alias("age_days"))


def tls_identity(certs: DataFrame, sans: DataFrame) -> DataFrame:
    """Inspected host, name match, subject and chain validity per target."""
    m = cert_hostname_match(certs, sans).select("cert_id", "matched")
    ch = cert_chain(certs).select("cert_id", not3(F.col("detected")).alias("chain_valid"))
    return certs.select("cert_id", F.col("hostname").alias("host"), F.when(F.col("has_leaf"), F.col("subject")).alias("subject")).join(m, "cert_id", "left").join(ch, "cert_id", "left")
