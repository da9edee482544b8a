"""Collected DNS, ASN and registration answers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import url as U
from ..functions.logic import first_true

PROBE_OF = {"dns_a": "dns", "dns_ns": "dns", "dns_ns_registrable": "dns", "ip_asn": "dns", "rdap": "http"}


def asn_most_specific(addresses: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Longest covering prefix per distinct address, of either family and in any spelling.

    Addresses and networks are hex digits. One equi-join key per prefix length that the table has (at most 33 and 129)
    instead of a range join; distinct addresses first, so a busy address costs one row.
    """
    family = lambda h: F.length(h)  # noqa: E731  8 or 32 digits
    ips = addresses.select("ip").distinct().withColumn("_h", U.address_hex(F.col("ip")))
    p = prefixes.select(U.address_hex(F.col("network")).alias("_h"), F.col("prefix_len").cast("int").alias("plen"), "network", "asn", "org")
    p = p.where(F.col("plen").between(0, 4 * family(F.col("_h"))))
    p = p.select(family(F.col("_h")).alias("family"), "plen", U.hex_prefix(F.col("_h"), F.col("plen")).alias("net"), "network", "asn", "org")
    present: dict[int, list[int]] = {8: [], 32: []}
    for r in p.select("family", "plen").distinct().collect():
        present[r["family"]].append(r["plen"])
    lengths = {f: F.array(*[F.lit(k) for k in sorted(v)]).cast("array<int>") for f, v in present.items()}
    own = F.when(family(F.col("_h")) == 8, lengths[8]).otherwise(lengths[32])
    x = ips.where("_h IS NOT NULL").select("ip", "_h", F.explode(own).alias("plen")).select("ip", family(F.col("_h")).alias("family"), "plen", U.hex_prefix(F.col("_h"), F.col("plen")).alias("net"))
    hit = x.join(p, ["family", "plen", "net"]).groupBy("ip").agg(F.max_by(F.struct("network", "plen", "asn", "org"), F.struct("plen", F.lit(0) - F.col("asn"))).alias("b"))
    return ips.select("ip").join(hit, "ip", "left").select(
        "ip", F.concat("b.network", F.lit("/"), F.col("b.plen").cast("string")).alias("prefix"), F.col("b.asn").alias("asn"), F.col("b.org").alias("org"))


def asn_org(origins: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First ASN's organisation; misses once per ASN with the number of affected addresses."""
    o = origins.withColumn("first_asn", F.split_part(F.trim("asn"), F.lit(" "), F.lit(1)))
    known = orgs.select(F.col("asn").alias("first_asn"), "org")
    rows = o.join(known, "first_asn", "left").select("ip", "first_asn", "org")
    misses = rows.where("org IS NULL").groupBy("first_asn").agg(F.count_distinct("ip").alias("affected"), F.min("ip").alias("first_ip"))
    return rows, misses


def rdap_servers(base: DataFrame, supplement: DataFrame) -> DataFrame:
    """First https URL per suffix; the supplement only fills gaps."""
    d = base.select("suffix", F.posexplode("urls").alias("pos", "u"))
    b = d.groupBy("suffix").agg(F.min_by("u", F.struct((~F.col("u").startswith("https://")).alias("p"), "pos")).alias("server"))
    return b.unionByName(supplement.select("suffix", "server").join(b, "suffix", "left_anti"))


def rdap_server_pick(units: DataFrame, base: DataFrame, supplement: DataFrame) -> DataFrame:
    servers = rdap_servers(base, supplement)
    u = units.select("unit").distinct()
    labels = F.split(F.regexp_replace("unit", r"\.$", ""), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(i.alias("start"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("suffix")))
    x = u.select("unit", F.explode(tails).alias("t")).select("unit", "t.*").join(servers, "suffix")
    return u.join(x.groupBy("unit").agg(F.min_by("server", "start").alias("server")), "unit", "left")


def _folded(df: DataFrame, side: str) -> DataFrame:
    return df.select("domain", F.lower(F.regexp_replace("name", r"\.$", "")).alias("name")).distinct().withColumn(side, F.lit(True))


def ns_sides(dns_ns: DataFrame, rdap_ns: DataFrame) -> DataFrame:
    return _folded(dns_ns, "in_dns").join(_folded(rdap_ns, "in_rdap"), ["domain", "name"], "full_outer")


def ns_set_compare(dns_ns: DataFrame, rdap_ns: DataFrame) -> DataFrame:
    """Name-server sets per domain; NULL where one side has none."""
    g = ns_sides(dns_ns, rdap_ns).groupBy("domain").agg(
        F.count_if(F.col("in_rdap").isNull()).alias("dns_only"), F.count_if(F.col("in_dns").isNull()).alias("rdap_only"),
        F.count("in_dns").alias("d"), F.count("in_rdap").alias("r"))
    return g.select("domain", F.when((F.col("d") > 0) & (F.col("r") > 0), (F.col("dns_only") == 0) & (F.col("rdap_only") == 0)).alias("same_set"), "dns_only", "rdap_only")


def ns_difference(dns_ns: DataFrame, rdap_ns: DataFrame) -> DataFrame:
    return ns_sides(dns_ns, rdap_ns).where("in_dns IS NULL OR in_rdap IS NULL").select(
        "domain", F.when(F.col("in_dns").isNull(), "rdap_only").otherwise("dns_only").alias("side"), "name")


def cname_terminal(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """End of an unambiguous alias chain in one reply; a loop, branch or unused alias gives NULL.

    A reply's aliases come from one DNS message, so they are folded in one row; a chain may be as long as there are aliases.
    """
    e = edges.select("reply_id", "name", "target").distinct()
    one = e.groupBy("reply_id", "name").agg(F.min("target").alias("next"), F.count("*").alias("targets"))
    folded = one.groupBy("reply_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "next"))).alias("next"), F.sum("targets").alias("aliases"))
    j = hosts.select("reply_id", "host").join(folded, "reply_id", "left")
    start = F.struct(F.col("host").alias("at"), F.lit(0).cast("bigint").alias("used"))

    def step(acc, _):
        to = F.col("next")[acc["at"]]
        return F.when(to.isNull(), acc).otherwise(F.struct(to.alias("at"), (acc["used"] + 1).alias("used")))

    end = F.aggregate(F.coalesce(F.sequence(F.lit(1).cast("bigint"), F.col("aliases")), F.array().cast("array<bigint>")), start, step)
    j = j.withColumn("end", end)
    fine = (F.col("end.used") == F.coalesce("aliases", F.lit(0))) & (F.col("next").isNull() | F.col("next")[F.col("end.at")].isNull())
    return j.select("reply_id", F.when(fine, F.col("end.at")).alias("terminal"))


def timeout_attribution(lookups: DataFrame, probes: DataFrame) -> DataFrame:
    """Whose fault a timeout is: the target's if the run's control probe of that kind answered."""
    kind = F.create_map(*[x for k, v in PROBE_OF.items() for x in (F.lit(k), F.lit(v))])[F.col("name")]
    p = probes.select("run_id", F.col("kind").alias("probe_kind"), "answered")
    j = lookups.withColumn("probe_kind", kind).join(p, ["run_id", "probe_kind"], "left")
    return j.select("run_id", "lookup_id", first_true([(F.col("status") != "timeout", "not_timeout"), (F.col("answered"), "target_fault")], "our_fault").alias("verdict"))


def lookup_coverage(hosts: DataFrame, lookups: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Expected lookups without a result; the expected names are a fixed short list per host."""
    want = hosts.select("host_id", "stop_reason", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    return want.join(lookups.select("host_id", "name").distinct(), ["host_id", "name"], "left_anti").select(
        "host_id", F.col("name").alias("missing_name"), F.coalesce("stop_reason", F.lit("not_started")).alias("reason"))


def ip_networks(addr_asn: DataFrame) -> DataFrame:
    """Addresses grouped by complete (asn, prefix, org); incomplete ones stay single."""
    full = F.col("asn").isNotNull() & F.col("prefix").isNotNull() & F.col("org").isNotNull()
    d = addr_asn.select("host_id", "ip", "asn", "prefix", "org").distinct().withColumn("single_ip", F.when(~full, F.col("ip")))
    return d.groupBy("host_id", "asn", "prefix", "org", "single_ip").agg(F.count("*").alias("addresses"), F.min("ip").alias("first_ip"))


def first_two_addresses(answers: DataFrame) -> DataFrame:
    d = answers.groupBy("host_id", "ip").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("host_id").orderBy("pos", "ip")
    return d.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("host_id", "rank", "ip")


def rdap_fields(responses: DataFrame, col: str = "body") -> DataFrame:
    """First date per event kind, status words, name-server count and the first registrar."""
    shape = ("struct<events:array<struct<eventAction:string,eventDate:string>>,status:array<string>,nameservers:array<struct<ldhName:string>>,"
             "entities:array<struct<roles:array<string>,handle:string,name:string,publicIds:array<struct<type:string,identifier:string>>>>>")
    r = responses.withColumn("r", F.from_json(col, shape))
    first = lambda action: F.get(F.filter("r.events", lambda e: (e["eventAction"] == action) & e["eventDate"].isNotNull()), F.lit(0))["eventDate"]
    reg = F.get(F.filter("r.entities", lambda e: F.array_contains(e["roles"], "registrar")), F.lit(0))
    iana = F.get(F.filter(F.col("reg.publicIds"), lambda p: p["type"] == "IANA Registrar ID"), F.lit(0))["identifier"]
    return r.withColumn("reg", reg).select(
        "domain", first("registration").alias("registration"), first("expiration").alias("expiration"), first("last changed").alias("last_changed"),
        F.array_join("r.status", ",").alias("status"), F.size(F.filter("r.nameservers", lambda n: n["ldhName"].isNotNull())).alias("nameservers"),
        F.coalesce("reg.name", "reg.handle").alias("registrar"), iana.alias("iana_id"))


def dns_result_class(replies: DataFrame) -> DataFrame:
    """Kind of answer to (status, result). ``rcodes`` is the list of distinct codes all servers gave."""
    k, n = F.col("kind"), F.size("rcodes")
    status = first_true([(k.isin("answer", "nxdomain", "nodata"), "received"), ((k == "no_nameservers") & (n > 0), "received"), (k == "timeout", "timeout")], "tool_error")
    result = first_true([(k == "answer", "records"), (k == "nxdomain", "NXDOMAIN"), (k == "nodata", "empty"),
                         ((k == "no_nameservers") & (n == 1), F.get("rcodes", F.lit(0))), ((k == "no_nameservers") & (n > 1), F.array_join(F.array_sort("rcodes"), ","))])
    return replies.withColumns({"status": status, "result": result})


def rdap_result_class(responses: DataFrame) -> DataFrame:
    v = F.try_parse_json("body")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    code = F.try_variant_get(v, "$.errorCode", "int")
    c = F.col("http_status")
    status = first_true([((c == 404) & is_object & (code == 404), "received"), (c == 404, "tool_error"), ((c == 200) & ~is_object, "tool_error")], "received")
    result = first_true([(status == "tool_error", F.lit(None).cast("string")), (c == 404, "not_registered"), (c == 200, "registered")], F.concat(F.lit("HTTP "), c.cast("string")))
    return responses.withColumns({"status": status, "result": result})


def asn_txt_parse(txt: DataFrame) -> DataFrame:
    p = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    ok = F.size(p) == 5
    return txt.select("txt_id", *[F.when(ok, F.get(p, F.lit(i))).alias(n) for i, n in enumerate(("asn", "prefix", "country"))],
                      F.when(~ok, F.concat(F.lit("pieces:"), F.size(p).cast("string"))).alias("error"), F.get(p, F.size(p) - 1).alias("org"))


def dns_negative_ttl(replies: DataFrame) -> DataFrame:
    """Usable negative answers with their expiry: one SOA that owns the name, positive lifetime."""
    ttl = F.least("soa_ttl", "soa_minimum")
    name, owner = F.lower(F.regexp_replace("terminal", r"\.$", "")), F.lower(F.regexp_replace("soa_owner", r"\.$", ""))
    owned = (name == owner) | name.endswith(F.concat(F.lit("."), owner))
    return replies.where((F.col("soa_count") == 1) & owned & (ttl > 0)).select(
        "reply_id", "host", ttl.alias("ttl_s"), (F.col("observed_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ttl.cast("decimal(18,6)"))).alias("valid_until"))


def url_activity(urls: DataFrame, dns: DataFrame, coverage: DataFrame, at: Column) -> DataFrame:
    """One activity state per URL from its DNS answer and what the page layers saw."""
    c = coverage.groupBy("url_id").agg(F.bool_or("positive").alias("seen"))
    j = urls.join(dns, "url_id", "left").join(c, "url_id", "left")
    seen = F.coalesce("seen", F.lit(False))
    live = F.coalesce(F.col("valid_until") > at, F.lit(False))
    negative = F.col("negative_kind").isNotNull()
    state = first_true([
        (F.col("host").isNull() & seen, "REACHABLE"), (F.col("host").isNull(), "UNKNOWN"),
        (F.col("host_kind").isin("IPv4", "IPv6"), "NOT_APPLICABLE"), (F.coalesce("verified_address", F.lit(False)), "ACTIVE"),
        (negative & live & seen, "CONFLICT"), (negative & live & (F.col("negative_kind") == "nxdomain"), "NAME_NONEXISTENT"),
        (negative & live, "UNREACHABLE"), (seen, "REACHABLE")], "UNKNOWN")
    reason = first_true([
        (state == "NOT_APPLICABLE", "ip_literal"), (state == "ACTIVE", "positive_address"), (state == "CONFLICT", "negative_dns_and_page_observed"),
        (state == "NAME_NONEXISTENT", "nxdomain_with_soa"), (state == "UNREACHABLE", "nodata_with_soa"), (state == "REACHABLE", "http_tls_or_document_observed"),
        (F.col("host").isNull(), "hostname_missing"), (negative, "negative_observation_expired_or_undated")], "address_evidence_incomplete")
    return j.select("url_id", state.alias("state"), reason.alias("reason"), (state.isin("NAME_NONEXISTENT", "UNREACHABLE") & F.coalesce("same_run", F.lit(False))).alias("can_skip"))
