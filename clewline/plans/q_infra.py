"""DNS, ASN, registration and activity queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import infra as I
from .registry import query, with_fixtures as W

NUM = lambda c: "(" + " + ".join(f"TRY_CAST(split_part({c}, '.', {k}) AS BIGINT) * {256 ** (4 - k)}" for k in range(1, 5)) + ")"
# The fixture spells its IPv6 networks in two ways; what tells the longer ones apart is the third group.
V6 = "(a.ip LIKE '%:%' AND p.network LIKE '%:%' AND (prefix_len = 32 OR split_part(a.ip, ':', 3) = split_part(p.network, ':', 3)))"
BEST = f"best AS (SELECT ip, network || '/' || prefix_len AS prefix, asn, org FROM (SELECT a.ip, p.*, row_number() OVER (PARTITION BY a.ip ORDER BY prefix_len DESC NULLS LAST, asn) AS rn FROM (SELECT DISTINCT ip FROM dns_answers) a LEFT JOIN prefixes p ON CASE WHEN a.ip LIKE '%:%' OR p.network LIKE '%:%' THEN {V6} ELSE {NUM('a.ip')} >> (32 - prefix_len) = {NUM('p.network')} >> (32 - prefix_len) END) WHERE rn = 1)"
D = "dns_answers prefixes"


def located(t):
    return I.asn_most_specific(t.dns_answers, t.prefixes)


@query("asn_most_specific", W("SELECT ip, prefix, asn, org FROM best", D, BEST))
def _(t):
    return located(t)


@query("asn_org", W("SELECT 'row' AS kind, ip, asn::VARCHAR AS first_asn, CASE WHEN n_regionkey = 1 THEN n_name END AS org, NULL AS affected FROM best LEFT JOIN nation ON n_nationkey + 64500 = asn UNION ALL SELECT 'miss', min(ip), asn::VARCHAR, NULL, count(*) FROM best LEFT JOIN nation ON n_nationkey + 64500 = asn WHERE coalesce(n_regionkey, 0) <> 1 GROUP BY asn", D, BEST))
def _(t):
    orgs = t.nation.where("n_regionkey = 1").select((F.col("n_nationkey") + 64500).cast("string").alias("asn"), F.col("n_name").alias("org"))
    rows, misses = I.asn_org(located(t).select("ip", F.concat(F.col("asn").cast("string"), F.lit(" 65000")).alias("asn")), orgs)
    return rows.select(F.lit("row").alias("kind"), "ip", "first_asn", "org", F.lit(None).cast("bigint").alias("affected")).unionByName(
        misses.select(F.lit("miss").alias("kind"), F.col("first_ip").alias("ip"), "first_asn", F.lit(None).cast("string").alias("org"), "affected"))


@query("ip_networks", W("""
SELECT host_id, asn, prefix, org, CASE WHEN org IS NULL THEN ip END AS single_ip, count(*) AS addresses, min(ip) AS first_ip FROM (SELECT DISTINCT host_id, ip, asn, prefix, org FROM dns_answers JOIN best USING (ip)) GROUP BY 1, 2, 3, 4, 5""", D, BEST))
def _(t):
    return I.ip_networks(t.dns_answers.join(located(t), "ip"))


@query("first_two_addresses", W("SELECT host_id, rank, ip FROM (SELECT host_id, ip, row_number() OVER (PARTITION BY host_id ORDER BY min(pos)) AS rank FROM dns_answers GROUP BY 1, 2) WHERE rank <= 2", "dns_answers"))
def _(t):
    return I.first_two_addresses(t.dns_answers)


UNITS = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('s', CAST(page_id AS STRING), '.co.uk') WHEN 1 THEN regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) ELSE concat('d', CAST(page_id AS STRING), '.zz') END AS unit FROM pages"


@query("rdap_server_pick", f"SELECT DISTINCT unit, CASE WHEN unit LIKE '%.co.uk' THEN 'https://supp.example/' WHEN unit LIKE '%.example.com' THEN 'https://b.example/' WHEN unit LIKE '%.com' OR unit LIKE '%.net' THEN 'https://b.example/' WHEN unit LIKE '%.org' THEN 'http://only.example/' END AS server FROM ({UNITS})")
def _(t):
    base = t.spark.sql("SELECT * FROM VALUES ('com', array('http://a.example/', 'https://b.example/')), ('net', array('https://b.example/')), ('org', array('http://only.example/')) AS v(suffix, urls)")
    supp = t.spark.sql("SELECT * FROM VALUES ('co.uk', 'https://supp.example/'), ('com', 'https://never.example/') AS v(suffix, server)")
    return I.rdap_server_pick(t.sql(UNITS), base, supp)


DNS_NS = "SELECT o_orderkey AS domain, concat('NS', CAST(l_suppkey % 3 AS STRING), '.Example.net.') AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber < 4"
RDAP_NS = "SELECT l_orderkey AS domain, concat('ns', CAST(l_suppkey % 3 AS STRING), '.example.net') AS name FROM lineitem WHERE l_linenumber > 1"
SIDES = f"""a AS (SELECT DISTINCT domain, lower(rtrim(name, '.')) AS name FROM ({DNS_NS})), b AS (SELECT DISTINCT domain, lower(rtrim(name, '.')) AS name FROM ({RDAP_NS})),
dd AS (SELECT *, 'dns_only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'rdap_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))"""


@query("ns_set_compare", W("""
SELECT domain, CASE WHEN domain IN (SELECT domain FROM a) AND domain IN (SELECT domain FROM b) THEN x = 0 AND y = 0 END AS same_set, x AS dns_only, y AS rdap_only FROM (
  SELECT domain, count(*) FILTER (side = 'dns_only') AS x, count(*) FILTER (side = 'rdap_only') AS y FROM (SELECT domain FROM a UNION SELECT domain FROM b) LEFT JOIN dd USING (domain) GROUP BY 1)""", "", SIDES))
def _(t):
    return I.ns_set_compare(t.sql(DNS_NS), t.sql(RDAP_NS))


@query("ns_difference", W("SELECT domain, side, name FROM dd", "", SIDES))
def _(t):
    return I.ns_difference(t.sql(DNS_NS), t.sql(RDAP_NS))


EDGES = "SELECT l_orderkey AS reply_id, concat('h', CAST(l_linenumber AS STRING)) AS name, CASE WHEN l_partkey % 7 = 0 THEN 'h1' ELSE concat('h', CAST(l_linenumber + 1 AS STRING)) END AS target FROM lineitem"
ASKED = "SELECT o_orderkey AS reply_id, 'h1' AS host FROM orders"


@query("cname_terminal", "WITH RECURSIVE e AS (SELECT DISTINCT * FROM (" + EDGES + f""")), o AS (SELECT reply_id, name, min(target) AS nxt, count(*) AS k FROM e GROUP BY 1, 2),
z AS (SELECT reply_id, count(*) AS n FROM e GROUP BY 1),
w AS (SELECT reply_id, host AS at_name, 0 AS used, true AS ok FROM ({ASKED}) UNION ALL SELECT w.reply_id, nxt, used + 1, ok AND k = 1 FROM w JOIN o ON o.reply_id = w.reply_id AND o.name = w.at_name JOIN z ON z.reply_id = w.reply_id WHERE used < z.n)
SELECT q.reply_id, CASE WHEN f.ok AND f.used = coalesce(s.n, 0) AND x.name IS NULL THEN f.at_name END AS terminal
FROM ({ASKED}) q LEFT JOIN (SELECT reply_id, count(*) AS n FROM e GROUP BY 1) s USING (reply_id) LEFT JOIN (SELECT reply_id, arg_max(at_name, used) AS at_name, max(used) AS used, arg_max(ok, used) AS ok FROM w GROUP BY 1) f USING (reply_id) LEFT JOIN o x ON x.reply_id = q.reply_id AND x.name = f.at_name""")
def _(t):
    return I.cname_terminal(t.sql(EDGES), t.sql(ASKED))


TIMED = "SELECT event_id AS lookup_id, user_id AS run_id, CASE event_type WHEN 'view' THEN 'rdap' WHEN 'click' THEN 'dns_a' ELSE 'ip_asn' END AS name, CASE WHEN value > 40 THEN 'timeout' ELSE 'received' END AS status FROM events"
PROBES = "SELECT c_custkey AS run_id, CASE WHEN c_nationkey % 2 = 0 THEN 'dns' ELSE 'http' END AS kind, c_acctbal > 0 AS answered FROM customer"


@query("timeout_attribution", f"""
SELECT l.run_id, lookup_id, CASE WHEN status <> 'timeout' THEN 'not_timeout' WHEN p.answered THEN 'target_fault' ELSE 'our_fault' END AS verdict
FROM ({TIMED}) l LEFT JOIN ({PROBES}) p ON p.run_id = l.run_id AND p.kind = CASE name WHEN 'rdap' THEN 'http' ELSE 'dns' END""")
def _(t):
    return I.timeout_attribution(t.sql(TIMED), t.sql(PROBES))


COVER_HOSTS = "SELECT page_id AS host_id, CASE page_id % 4 WHEN 0 THEN 'budget_exceeded' ELSE NULL END AS stop_reason FROM pages"
COVER = "SELECT user_id AS host_id, CASE event_type WHEN 'view' THEN 'rdap' WHEN 'click' THEN 'dns_a' WHEN 'error' THEN 'dns_ns' ELSE 'ip_asn' END AS name FROM events WHERE value > 120"


@query("lookup_coverage", f"""
SELECT host_id, n AS missing_name, coalesce(stop_reason, 'not_started') AS reason FROM ({COVER_HOSTS}), (SELECT unnest(['dns_a', 'dns_ns', 'dns_ns_registrable', 'ip_asn', 'rdap']) AS n) WHERE (host_id, n) NOT IN (SELECT host_id, name FROM ({COVER}))""")
def _(t):
    return I.lookup_coverage(t.sql(COVER_HOSTS), t.sql(COVER), tuple(I.PROBE_OF))


RDAP_DOCS = """SELECT s_suppkey AS domain, CASE s_suppkey % 5 WHEN 4 THEN 'not json' WHEN 3 THEN '{"errorCode":404}' ELSE concat('{"events":[{"eventAction":"registration","eventDate":"2020-01-0', CAST(s_suppkey % 9 + 1 AS STRING), '"},{"eventAction":"registration","eventDate":"x"},{"eventAction":"last changed","eventDate":"2021"}],"status":["active","ok"],"nameservers":[{"ldhName":"a"},{}],"entities":[{"roles":["abuse"]},{"roles":["registrar"],"handle":"H', CAST(s_suppkey AS STRING), '","publicIds":[{"type":"IANA Registrar ID","identifier":"', CAST(s_nationkey AS STRING), '"}]}]}') END AS body,
  CASE s_suppkey % 7 WHEN 0 THEN 404 WHEN 1 THEN 429 ELSE 200 END AS http_status FROM supplier"""


@query("rdap_fields", f"""
SELECT domain, CASE WHEN ok THEN '2020-01-0' || (domain % 9 + 1) END AS registration, NULL AS expiration, CASE WHEN ok THEN '2021' END AS last_changed, CASE WHEN ok THEN 'active,ok' END AS status,
  CASE WHEN ok THEN 1 END AS nameservers, CASE WHEN ok THEN 'H' || domain END AS registrar, CASE WHEN ok THEN s_nationkey::VARCHAR END AS iana_id FROM (SELECT s_suppkey AS domain, s_nationkey, s_suppkey % 5 < 3 AS ok FROM supplier)""")
def _(t):
    return I.rdap_fields(t.sql(RDAP_DOCS)).withColumn("nameservers", F.when(F.col("nameservers") >= 0, F.col("nameservers")))


@query("rdap_result_class", f"""
SELECT domain, CASE WHEN (http_status = 404 AND body <> '{{"errorCode":404}}') OR (http_status = 200 AND body = 'not json') THEN 'tool_error' ELSE 'received' END AS status,
  CASE WHEN http_status = 429 THEN 'HTTP 429' WHEN http_status = 404 AND body = '{{"errorCode":404}}' THEN 'not_registered' WHEN http_status = 200 AND body <> 'not json' THEN 'registered' END AS result FROM ({RDAP_DOCS})""")
def _(t):
    return I.rdap_result_class(t.sql(RDAP_DOCS)).select("domain", "status", "result")


REPLIES = "SELECT event_id AS reply_id, CASE event_type WHEN 'view' THEN 'answer' WHEN 'click' THEN 'nxdomain' WHEN 'signup' THEN 'nodata' WHEN 'error' THEN 'no_nameservers' ELSE CASE WHEN value > 50 THEN 'timeout' ELSE 'odd' END END AS kind, CASE user_id % 3 WHEN 0 THEN 'SERVFAIL' WHEN 1 THEN 'SERVFAIL,REFUSED' ELSE '' END AS codes FROM events"


@query("dns_result_class", f"""
SELECT reply_id, CASE WHEN kind IN ('answer', 'nxdomain', 'nodata') OR (kind = 'no_nameservers' AND codes <> '') THEN 'received' WHEN kind = 'timeout' THEN 'timeout' ELSE 'tool_error' END AS status,
  CASE kind WHEN 'answer' THEN 'records' WHEN 'nxdomain' THEN 'NXDOMAIN' WHEN 'nodata' THEN 'empty' WHEN 'no_nameservers' THEN CASE codes WHEN 'SERVFAIL' THEN codes WHEN '' THEN NULL ELSE 'REFUSED,SERVFAIL' END END AS result FROM ({REPLIES})""")
def _(t):
    r = t.sql(REPLIES).withColumn("rcodes", F.filter(F.split("codes", ","), lambda x: x != ""))
    return I.dns_result_class(r).select("reply_id", "status", "result")


TXT = "SELECT p_partkey AS txt_id, CASE p_size % 3 WHEN 0 THEN concat(CAST(p_partkey AS STRING), ' | 10.0.0.0/8 | ', p_brand, ' | arin | ') WHEN 1 THEN concat('AS | ', p_name) ELSE p_name END AS line FROM part"


@query("asn_txt_parse", f"SELECT txt_id, CASE WHEN k = 5 THEN trim(l[1]) END AS asn, CASE WHEN k = 5 THEN trim(l[2]) END AS prefix, CASE WHEN k = 5 THEN trim(l[3]) END AS country, CASE WHEN k <> 5 THEN 'pieces:' || k END AS error, trim(l[k]) AS org FROM (SELECT txt_id, string_split(line, '|') AS l, len(string_split(line, '|')) AS k FROM ({TXT}))")
def _(t):
    return I.asn_txt_parse(t.sql(TXT))


NEG = "SELECT event_id AS reply_id, concat('h', CAST(user_id AS STRING)) AS host, CASE user_id % 3 WHEN 0 THEN 'a.Example.com.' WHEN 1 THEN 'example.com' ELSE 'b.example.org' END AS terminal, 'example.com.' AS soa_owner, CAST(floor(value) AS BIGINT) AS soa_ttl, user_id AS soa_minimum, CASE event_type WHEN 'error' THEN 2 ELSE 1 END AS soa_count, ts AS observed_at FROM events"


@query("dns_negative_ttl", f"SELECT reply_id, host, least(soa_ttl, soa_minimum) AS ttl_s, observed_at + to_seconds(least(soa_ttl, soa_minimum)) AS valid_until FROM ({NEG}) WHERE soa_count = 1 AND terminal NOT LIKE '%org' AND least(soa_ttl, soa_minimum) > 0")
def _(t):
    return I.dns_negative_ttl(t.sql(NEG))


ACT_URLS = "SELECT page_id AS url_id, CASE page_id % 11 WHEN 10 THEN NULL ELSE url END AS host, CASE page_id % 7 WHEN 6 THEN 'IPv4' ELSE 'domain' END AS host_kind, page_id % 2 = 0 AS same_run FROM pages"
ACT_DNS = "SELECT p.page_id AS url_id, CASE p.page_id % 3 WHEN 0 THEN true ELSE NULL END AS verified_address, CASE p.page_id % 4 WHEN 1 THEN 'nxdomain' WHEN 2 THEN 'nodata' ELSE NULL END AS negative_kind, e.ts AS valid_until FROM pages p JOIN events e ON e.event_id = p.page_id * 30"
ACT_COV = "SELECT user_id AS url_id, event_type = 'purchase' AS positive FROM events WHERE value > 150"


@query("url_activity", f"""
WITH j AS (SELECT u.*, verified_address, negative_kind, coalesce(valid_until > TIMESTAMP '2024-01-10', false) AS live, coalesce(s.seen, false) AS seen FROM ({ACT_URLS}) u LEFT JOIN ({ACT_DNS}) d USING (url_id) LEFT JOIN (SELECT url_id, bool_or(positive) AS seen FROM ({ACT_COV}) GROUP BY 1) s USING (url_id)),
k AS (SELECT *, CASE WHEN host IS NULL THEN CASE WHEN seen THEN 'REACHABLE' ELSE 'UNKNOWN' END WHEN host_kind = 'IPv4' THEN 'NOT_APPLICABLE' WHEN verified_address THEN 'ACTIVE' WHEN negative_kind IS NOT NULL AND live THEN CASE WHEN seen THEN 'CONFLICT' WHEN negative_kind = 'nxdomain' THEN 'NAME_NONEXISTENT' ELSE 'UNREACHABLE' END WHEN seen THEN 'REACHABLE' ELSE 'UNKNOWN' END AS state FROM j)
SELECT url_id, state, CASE state WHEN 'NOT_APPLICABLE' THEN 'ip_literal' WHEN 'ACTIVE' THEN 'positive_address' WHEN 'CONFLICT' THEN 'negative_dns_and_page_observed' WHEN 'NAME_NONEXISTENT' THEN 'nxdomain_with_soa' WHEN 'UNREACHABLE' THEN 'nodata_with_soa' WHEN 'REACHABLE' THEN 'http_tls_or_document_observed'
  ELSE CASE WHEN host IS NULL THEN 'hostname_missing' WHEN negative_kind IS NOT NULL THEN 'negative_observation_expired_or_undated' ELSE 'address_evidence_incomplete' END END AS reason, state IN ('NAME_NONEXISTENT', 'UNREACHABLE') AND same_run AS can_skip FROM k""")
def _(t):
    return I.url_activity(t.sql(ACT_URLS), t.sql(ACT_DNS), t.sql(ACT_COV), F.lit("2024-01-10").cast("timestamp"))
