"""String-level checks over a table of URLs. Inputs are kept row by row: a bad URL becomes a status or error row."""
from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import url as U
from ..functions.logic import first_true, let
from ..functions.udfs import idn_decode_udf, strip_marks_udf
from ..session import materialise
from ..refdata import CONFUSABLES, DANGEROUS_EXTENSIONS, DECEPTIVE_EXTENSIONS, NON_GLOBAL_BLOCKS, SuffixIndex
from .domains import domain_split

PARSED = ["protocol", "username", "hostname", "port", "pathname", "search", "fragment", "host_type"]


def url_parse_status(urls: DataFrame) -> DataFrame:
    """EMPTY_INPUT / FAILURE / SUCCESS with components for every row."""
    return U.with_parts(urls).select("url_id", "url", "parse_status", *PARSED)


def url_host(urls: DataFrame) -> DataFrame:
    """Lookup host, or why there is none: ``parse_failed`` differs from ``empty_host``."""
    p = U.with_parts(urls)
    ok = F.col("parse_status") == "SUCCESS"
    return p.select(
        "url_id",
        F.when(ok & (F.col("hostname") != ""), F.col("hostname")).alias("host"),
        F.when(~ok, "parse_failed").when(F.col("hostname") == "", "empty_host").alias("error"),
    )


def with_domains(urls: DataFrame, index: SuffixIndex) -> DataFrame:
    """Successfully parsed URLs with their domain split."""
    if "registered_domain" in urls.columns:
        return urls
    return domain_split(U.with_parts(urls).where("parse_status = 'SUCCESS'"), index)


def url_query_params(urls: DataFrame) -> DataFrame:
    """One row per query component; undecodable ones carry an error, the rest stay.

    ``value_index`` counts the earlier values of the same name in the same URL; a URL's
    components travel together, so the window is bounded by one URL's length.
    """
    p = U.with_parts(urls).where("parse_status = 'SUCCESS' AND search <> ''")
    parts = p.select("url_id", F.posexplode(F.split(F.substring("search", 2, 1 << 30), "&")).alias("pos", "raw")).where("raw <> ''")
    name = F.try_url_decode(F.substring_index("raw", "=", 1))
    value = F.when(F.instr("raw", "=") > 0, F.try_url_decode(F.expr("substring(raw, instr(raw, '=') + 1)"))).otherwise("")
    d = parts.withColumns({"name": name, "value": value})
    bad = F.col("name").isNull() | F.col("value").isNull()
    w = Window.partitionBy("url_id", "name", bad).orderBy("pos")
    return d.select(
        "url_id", "pos",
        F.when(~bad, F.col("name")).alias("name"),
        F.when(~bad, F.row_number().over(w) - 1).alias("value_index"),
        F.when(~bad, F.col("value")).alias("value"),
        F.when(bad, F.col("raw")).alias("raw_component"),
        F.when(bad, "query_component_parse_failed").alias("error"),
    )


def url_ip_host(urls: DataFrame) -> DataFrame:
    p = U.with_parts(urls).where("host_type IN ('IPV4', 'IPV6')")
    return p.select("url_id", "hostname", F.when(F.col("host_type") == "IPV4", "IPv4").otherwise("IPv6").alias("ip_kind"))


def url_word_split(domains: DataFrame) -> DataFrame:
    """Labels of the subdomain and the registered name that hold two or more words."""
    d = domains.where("host_type = 'DEFAULT'")
    sub = F.transform(
        F.filter(F.transform(F.split("subdomain", r"\."), lambda x, i: F.struct(F.lit("subdomain").alias("location"), i.alias("pos"), x.alias("label"))),
                 lambda s: s["label"] != ""), lambda s: s)
    own = F.when(F.col("domain") != "", F.array(F.struct(F.lit("domain").alias("location"), F.lit(0).alias("pos"), F.col("domain").alias("label")))).otherwise(
        F.slice(sub, 1, 0))
    rows = d.select("url_id", "hostname", "registered_domain", F.explode(F.concat(sub, own)).alias("x")).select("url_id", "hostname", "registered_domain", "x.*")
    words = F.filter(F.split("label", "[-_]"), lambda w: w != "")
    return rows.withColumn("w", words).where(F.size("w") >= 2).select(
        "url_id", "hostname", "registered_domain", "location", "pos", "label", F.array_join("w", " ").alias("words"), F.size("w").alias("word_count"))


def url_double_extension(urls: DataFrame) -> DataFrame:
    """Last path segment or query value whose last two extensions are (deceptive, dangerous)."""
    p = U.with_parts(urls).where("parse_status = 'SUCCESS'")
    segment = U.percent_decode(F.regexp_extract("pathname", r"([^/]*)$", 1))
    paths = p.select("url_id", F.lit("path").alias("location"), F.lit(None).cast("string").alias("name"),
                     F.lit(None).cast("int").alias("value_index"), segment.alias("text"))
    values = url_query_params(urls).where("error IS NULL").select(
        "url_id", F.lit("query").alias("location"), "name", "value_index", F.col("value").alias("text"))
    both = paths.unionByName(values)
    pat = r"(?s)^.+\.([^.]*)\.([^.]*)$"
    ext = lambda i: F.lower(F.regexp_extract("text", pat, i))
    return both.withColumns({"first_extension": ext(1), "last_extension": ext(2)}).where(
        F.col("first_extension").isin(*DECEPTIVE_EXTENSIONS) & F.col("last_extension").isin(*DANGEROUS_EXTENSIONS))


def url_userinfo_host(urls: DataFrame) -> DataFrame:
    return U.with_parts(urls).where("username <> ''").select("url_id", "username", F.col("hostname").alias("real_host"))


def url_suffix_in_subdomain(domains: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Subdomain labels that are public suffixes themselves (``suffixes`` has one ``suffix_label`` column)."""
    labels = domains.where("subdomain <> ''").withColumn("labels", F.split(F.lower("subdomain"), r"\."))
    rows = labels.select("url_id", "hostname", "registered_domain", "labels", F.posexplode("labels").alias("pos", "label"))
    hit = rows.join(suffixes, F.col("label") == F.col("suffix_label"), "left_semi")
    lead = F.when(F.col("pos") > 0, F.concat_ws(".", F.get("labels", F.col("pos") - 1), "label")).otherwise(F.col("label"))
    return hit.select("url_id", "hostname", "registered_domain", "pos", "label", lead.alias("found_text"))


def skeletons(hosts: DataFrame, host: str = "hostname") -> DataFrame:
    """Decoded host and its comparison spelling; only distinct IDN hosts reach Python."""
    idn = hosts.where(F.col(host).rlike(r"(^|\.)xn--") | F.col(host).rlike(r"[^\x00-\x7f]")).select(F.col(host).alias("host")).distinct()
    labels = idn.select("host", F.posexplode(F.split("host", r"\.")).alias("pos", "label"))
    spelled = labels.withColumn("decoded", idn_decode_udf("label"))
    text = F.coalesce("decoded", "label")
    touched = (F.col("label").startswith("xn--") & F.col("decoded").isNotNull()) | F.col("label").rlike(r"[^\x00-\x7f]")
    plain = spelled.withColumn("stripped", strip_marks_udf(text))
    mapped = F.lower(F.translate("stripped", "".join(CONFUSABLES), "".join(CONFUSABLES.values())))
    folded = F.when(touched, mapped).otherwise(text)
    pair = F.sort_array(F.collect_list(F.struct("pos", text.alias("d"), folded.alias("f"))))
    return plain.groupBy("host").agg(pair.alias("x"), F.count_if(F.col("label").startswith("xn--") & F.col("decoded").isNull()).alias("undecodable")).select(
        "host", F.array_join("x.d", ".").alias("decoded_host"), F.array_join("x.f", ".").alias("skeleton"), "undecodable")


def url_idn_skeleton(urls: DataFrame) -> DataFrame:
    """URLs whose host reads differently once look-alike letters are folded."""
    p = U.with_parts(urls).where("host_type = 'DEFAULT'").select("url_id", "hostname")
    sk = skeletons(p).where("skeleton <> decoded_host OR undecodable > 0")
    return p.join(sk, F.col("hostname") == F.col("host")).select(
        "url_id", "decoded_host", F.when(F.col("skeleton") != F.col("decoded_host"), F.col("skeleton")).alias("skeleton"),
        F.when(F.col("undecodable") > 0, "idn_decode_failed").alias("error"))


def homograph_pairs(hosts: DataFrame, host: str = "hostname") -> DataFrame:
    """Hosts whose comparison spelling equals a different known host.

    Plain hosts are their own spelling. Each member is paired with its group's first host
    (one row per host, never all pairs), found by a partial-aggregating minimum.
    """
    known = hosts.select(F.col(host).alias("host")).distinct()
    sk = skeletons(known, "host").select("host", "skeleton")
    spelled = known.join(sk, "host", "left").select("host", F.coalesce("skeleton", "host").alias("skeleton"))
    groups = spelled.groupBy("skeleton").agg(F.min("host").alias("other_host"), F.count("*").alias("spellings")).where("spellings > 1")
    return spelled.join(groups, "skeleton").where("host <> other_host").select("host", "other_host", "skeleton", "spellings")


# Status words of the feeds.
ACTIVE_WORDS = ("active", "online", "yes")
INACTIVE_WORDS = ("inactive", "offline")


def feed_active_flag(col: str = "source_status"):
    words = F.transform(F.split(col, r"\|"), lambda x: F.lower(F.trim(x)))
    has = lambda ws: F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws]))
    return F.coalesce(has(ACTIVE_WORDS) & ~has(INACTIVE_WORDS), F.lit(False))


def url_feed_active(dataset: DataFrame) -> DataFrame:
    return dataset.withColumn("active", feed_active_flag())


def with_rejection(df: DataFrame, col: str = "url", out: str = "reason") -> DataFrame:
    """Add the first reason a dataset row cannot be scanned, NULL when it can."""
    u = F.col(col)
    d = df.withColumns({"_s": U.scheme(u), "_a": U.authority(u)})
    d = d.withColumns({"_h": F.regexp_replace("_a", r":[^:\]]*$", ""), "_p": F.regexp_extract("_a", r":([^:\]]*)$", 1)})
    port = F.col("_p")
    reason = first_true([
        (~F.coalesce(F.col("_s").isin("http", "https"), F.lit(False)), "unsupported_scheme"),
        (F.col("_h").isin("", "[]"), "missing_hostname"),
        (F.col("_a").contains("@"), "userinfo_not_allowed"),
        ((port != "") & ~(port.rlike(r"^[0-9]{1,5}$") & (F.coalesce(port.try_cast("int"), F.lit(99999)) <= 65535)), "malformed_url"),
    ])
    return U.settle(d.withColumn(out, reason).drop("_s", "_a", "_h", "_p"), out)


def url_rejection_reason(dataset: DataFrame) -> DataFrame:
    return with_rejection(dataset)


# IPv6 ranges that are not globally reachable, and parts of the first list that are.
NON_GLOBAL_V6 = ("::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8")
GLOBAL_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def _in_v6(digits: Column, blocks) -> Column:
    """Whether 32 hex digits lie in one of some networks; digits of one length compare like numbers."""
    hit = F.lit(False)
    for block in map(ipaddress.ip_network, blocks):
        hit = hit | digits.between(f"{int(block.network_address):032x}", f"{int(block.broadcast_address):032x}")
    return hit


def non_global_flag(ip: str, blocks=NON_GLOBAL_BLOCKS):
    """TRUE / FALSE for an address of either family against the reserved blocks, NULL when it is no address.

    An IPv4 address mapped into IPv6 is judged as IPv4.
    """
    def flag(six):
        mapped = F.conv(F.regexp_extract(six, "^0{20}ffff([0-9a-f]{8})$", 1), 16, 10).cast("bigint")
        return let(F.coalesce(U.ipv4_number(F.col(ip)), F.when(six.rlike("^0{20}ffff"), mapped)), lambda n: F.when(
            n.isNotNull(), in_v4(n)).when(six.isNotNull(), _in_v6(six, NON_GLOBAL_V6) & ~_in_v6(six, GLOBAL_V6)))

    def in_v4(n):
        hit = F.lit(False)
        for first, length in blocks:
            a = sum(int(x) << s for x, s in zip(first.split("."), (24, 16, 8, 0)))
            hit = hit | ((n >= a) & (n < a + 2 ** (32 - length)))
        return hit

    return let(U.ipv6_hex(F.col(ip)), flag)


def url_public_target(addresses: DataFrame, host: str = "host_id", ip: str = "ip") -> DataFrame:
    """A host is a public target only if every address it has is global."""
    flagged = addresses.withColumn("blocked", F.coalesce(non_global_flag(ip), F.lit(True)))
    return flagged.groupBy(host).agg(
        F.count("*").alias("addresses"), F.count_if("blocked").alias("non_public"), (~F.bool_or("blocked")).alias("all_public"))


# Intake limits. Shared address space is not refused at intake.
MAX_URL_CHARS = 2048
BLOCKED_PORTS = (22, 23, 25, 445, 3306, 3389, 5432, 6379, 9200, 11211, 27017)
INTAKE_BLOCKS = tuple(b for b in NON_GLOBAL_BLOCKS if b[0] != "100.64.0.0")


def admission_reason(urls: DataFrame, addresses: DataFrame, blocked_ports: tuple[int, ...] = BLOCKED_PORTS) -> DataFrame:
    """Intake rules in order; an unresolvable host is admitted (no address is not a reason)."""
    u = F.col("url")
    p = U.with_parts(urls.withColumn("url", F.trim("url"))).withColumn("_auth", U.authority(u))
    bad = addresses.withColumn("blocked", F.coalesce(non_global_flag("ip", INTAKE_BLOCKS), F.lit(False))).groupBy("host").agg(F.bool_or("blocked").alias("non_public"))
    j = p.join(bad, p.hostname == bad.host, "left")
    port = U.port_text(u)
    port_n = port.try_cast("int")
    literal = F.when(F.col("host_type").isin("IPV4", "IPV6"), non_global_flag("hostname", INTAKE_BLOCKS))
    reason = first_true([
        (F.coalesce(F.trim(u), F.lit("")) == "", "empty_url"),
        (F.length(u) > MAX_URL_CHARS, "url_too_long"),
        (~F.coalesce(U.scheme(u).isin("http", "https"), F.lit(False)), "scheme_not_allowed"),
        (F.col("_auth").contains("@"), "credentials_in_url"),
        (U.raw_host(u) == "", "host_missing"),
        ((port != "") & (port_n.isNull() | (port_n < 1) | (port_n > 65535)), "port_out_of_range"),
        (port_n.isin(*blocked_ports), "port_blocked"),
        (F.col("parse_status") == "FAILURE", "host_invalid"),
        (F.coalesce(literal, F.col("non_public"), F.lit(False)), "address_not_public"),
    ])
    return j.select("url_id", reason.alias("reason"))


def url_tld_list(domains: DataFrame, tlds: DataFrame) -> DataFrame:
    d = domains.where("suffix <> ''").withColumn("tld", F.substring_index(F.lower("suffix"), ".", -1))
    return d.join(tlds, "tld").select("url_id", "registered_domain", "tld", "list_version")


def url_free_hosting(domains: DataFrame, providers: DataFrame) -> DataFrame:
    d = domains.where("subdomain <> ''").withColumn("provider", F.regexp_replace(F.lower("registered_domain"), r"\.$", ""))
    return d.join(providers, "provider").select("url_id", "hostname", "provider", "subdomain", "category")


def url_shortener_list(domains: DataFrame, shorteners: DataFrame | None) -> DataFrame:
    """Host, else registered domain, on the list. Without a list every row is an error, not a miss."""
    d = domains.where("registered_domain <> ''")
    if shorteners is None:
        return d.select("url_id", F.lit(None).cast("string").alias("provider"), F.lit("shortener_list_unavailable").alias("error"))
    by_host = shorteners.select(F.col("domain").alias("_h"))
    by_domain = shorteners.select(F.col("domain").alias("_d"))
    j = d.join(by_host, F.col("hostname") == F.col("_h"), "left").join(by_domain, F.col("registered_domain") == F.col("_d"), "left")
    return j.select("url_id", F.coalesce("_h", "_d").alias("provider"), F.lit(None).cast("string").alias("error")).where("provider IS NOT NULL")


def url_external_query_target(urls: DataFrame, index: SuffixIndex) -> DataFrame:
    """Query values that address another registered domain or IP; unresolved ones are error rows."""
    src = with_domains(urls, index).select("url_id", "hostname", "registered_domain", "host_type", "protocol")
    params = url_query_params(urls).where("error IS NULL").where(F.trim("value").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:|[/\\]{2})"))
    v = F.trim("value")
    j = params.select("url_id", "name", "value_index", "value").join(src, "url_id")
    target = F.when(v.rlike(r"^[/\\]{2}"), F.concat("protocol", F.lit("//"), F.substring(v, 3, 1 << 30))).otherwise(v)
    parsed = U.with_parts(j.withColumn("target_url", target).drop("protocol").withColumnsRenamed({"hostname": "url_host", "host_type": "url_host_type"}), "target_url")
    t = domain_split(parsed, index, "hostname", "t_")
    src_ip = F.col("url_host_type").isin("IPV4", "IPV6")
    dst_ip = F.col("host_type").isin("IPV4", "IPV6")
    unresolved = (~src_ip & (F.col("registered_domain") == "")) | (~dst_ip & (F.col("t_registered_domain") == ""))
    failed = F.col("parse_status") != "SUCCESS"
    error = F.when(failed, "query_target_parse_failed").when(unresolved, "query_target_domain_unresolved")
    t = t.withColumn("error", error).where(failed | ((F.col("hostname") != "") & (F.col("hostname") != F.col("url_host"))))
    same = (F.col("registered_domain") != "") & (F.col("registered_domain") == F.col("t_registered_domain"))
    return t.where(F.col("error").isNotNull() | ~same).select(
        "url_id", "name", "value_index", "value",
        F.when(F.col("error").isNull(), F.col("hostname")).alias("target_host"),
        F.when(F.col("error").isNull() & (F.col("t_registered_domain") != ""), F.col("t_registered_domain")).alias("target_domain"),
        "error")


# Fixed order of the ten checks.
CHECKS = ("ip_host", "tld_list", "free_hosting", "word_split", "idn_skeleton", "double_extension",
          "shortener", "external_query_target", "userinfo_host", "suffix_in_subdomain")


def url_observations(urls: DataFrame, index: SuffixIndex, tlds: DataFrame, providers: DataFrame, shorteners: DataFrame, suffixes: DataFrame) -> DataFrame:
    """All ten checks as one positive-only long table: (url_id, check_name, facts).

    The URLs are taken apart once into a written table that every check reads, instead of
    once per check.
    """
    urls = materialise(with_domains(urls, index), "parsed-urls")
    dom = urls
    found = {
        "ip_host": url_ip_host(urls),
        "tld_list": url_tld_list(dom, tlds),
        "free_hosting": url_free_hosting(dom, providers),
        "word_split": url_word_split(dom),
        "idn_skeleton": url_idn_skeleton(urls).where("skeleton IS NOT NULL"),
        "double_extension": url_double_extension(urls),
        "shortener": url_shortener_list(dom, shorteners).where("error IS NULL"),
        "external_query_target": url_external_query_target(urls, index).where("error IS NULL"),
        "userinfo_host": url_userinfo_host(urls),
        "suffix_in_subdomain": url_suffix_in_subdomain(dom, suffixes),
    }
    out = None
    for name in CHECKS:
        df = found[name]
        facts = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c != "url_id"]))
        rows = df.select("url_id", F.lit(name).alias("check_name"), facts.alias("facts"))
        out = rows if out is None else out.unionByName(rows)
    return out


def observation_counts(observations: DataFrame) -> DataFrame:
    """Records per URL and check, and the number of checks that ran."""
    return observations.groupBy("url_id", "check_name").agg(F.count("*").alias("record_count")).withColumn("check_count", F.lit(len(CHECKS)))
