"""URL and domain queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..operators import domains as D, url_checks as C
from .registry import Tables, query, with_fixtures
from .sqlparts import QUERY_PARTS, URL_PARTS, dom, values

URLS = "SELECT host FROM p WHERE st = 'SUCCESS' AND host <> ''"
DOM = dom("d", URLS)


def O(select: str, *ctes: str, fx: str = "urls suffix_rules") -> str:
    return with_fixtures(select, fx, *ctes)


def index(t: Tables):
    return R.suffix_index(t.suffix_rules)


# Spellings of few hosts: backslashes, one slash, an octal number that is none, letters beyond ASCII, long addresses, a line break.
SPELLED = """SELECT page_id + 10000000 AS url_id, CASE page_id % 8 WHEN 0 THEN concat('https:', chr(92), chr(92), 'evil.example.net', chr(92), 'x') WHEN 1 THEN 'https:/evil.example.net/x' WHEN 2 THEN 'http://1.2.3.08/'
  WHEN 3 THEN 'http://münchen.example/' WHEN 4 THEN 'http://xn--mnchen-3ya.example/' WHEN 5 THEN 'http://[0:0:0:0:0:0:0:1]/' WHEN 6 THEN concat('ht', chr(10), 'tps://evil.example.net/x') ELSE 'http://[::1]/' END AS url FROM pages"""
SPELLED_HOSTS = f"sp AS (SELECT *, CASE url_id % 8 WHEN 2 THEN NULL WHEN 3 THEN 'xn--mnchen-3ya.example' WHEN 4 THEN 'xn--mnchen-3ya.example' WHEN 5 THEN '[::1]' WHEN 7 THEN '[::1]' ELSE 'evil.example.net' END AS h FROM ({SPELLED}))"


@query("url_parse_status", O("""
SELECT url_id, url, st AS parse_status, CASE WHEN ok THEN sch || ':' END AS protocol,
  CASE WHEN ok THEN split_part(ui, ':', 1) END AS username, CASE WHEN ok THEN host END AS hostname,
  CASE WHEN ok THEN port0 END AS port,
  CASE WHEN ok THEN CASE WHEN path0 = '' AND sch <> 'mailto' THEN '/' ELSE path0 END END AS pathname,
  CASE WHEN ok THEN CASE WHEN query0 <> '' THEN '?' || query0 ELSE '' END END AS search,
  CASE WHEN ok THEN CASE WHEN frag0 <> '' THEN '#' || frag0 ELSE '' END END AS fragment,
  CASE WHEN ok THEN ht END AS host_type FROM (SELECT *, st = 'SUCCESS' AS ok FROM p)
UNION ALL SELECT url_id, url, CASE WHEN h IS NULL THEN 'FAILURE' ELSE 'SUCCESS' END, CASE WHEN h LIKE 'evil%' THEN 'https:' WHEN h IS NOT NULL THEN 'http:' END, CASE WHEN h IS NOT NULL THEN '' END, h, CASE WHEN h IS NOT NULL THEN '' END,
  CASE WHEN h LIKE 'evil%' THEN '/x' WHEN h IS NOT NULL THEN '/' END, CASE WHEN h IS NOT NULL THEN '' END, CASE WHEN h IS NOT NULL THEN '' END, CASE WHEN h LIKE '[%' THEN 'IPV6' WHEN h IS NOT NULL THEN 'DEFAULT' END FROM sp""", URL_PARTS, SPELLED_HOSTS))
def _(t):
    return C.url_parse_status(t.urls.unionByName(t.sql(SPELLED)))


@query("url_host", O("""
SELECT url_id, CASE WHEN st = 'SUCCESS' AND host <> '' THEN host END AS host,
  CASE WHEN st <> 'SUCCESS' THEN 'parse_failed' WHEN host = '' THEN 'empty_host' END AS error FROM p
UNION ALL SELECT url_id, h, CASE WHEN h IS NULL THEN 'parse_failed' END FROM sp""", URL_PARTS, SPELLED_HOSTS))
def _(t):
    return C.url_host(t.urls.unionByName(t.sql(SPELLED)))


@query("url_query_params", O("""
SELECT url_id, pos, name, CASE WHEN NOT bad THEN row_number() OVER (PARTITION BY url_id, name, bad ORDER BY pos) - 1 END AS value_index,
  value, CASE WHEN bad THEN raw END AS raw_component, CASE WHEN bad THEN 'query_component_parse_failed' END AS error FROM qp""",
  URL_PARTS, QUERY_PARTS))
def _(t):
    return C.url_query_params(t.urls)


@query("url_ip_host", O("SELECT url_id, host AS hostname, CASE ht WHEN 'IPV4' THEN 'IPv4' ELSE 'IPv6' END AS ip_kind FROM p WHERE st = 'SUCCESS' AND ht <> 'DEFAULT'", URL_PARTS))
def _(t):
    return C.url_ip_host(t.urls)


WORDS = """
SELECT url_id, hostname, registered_domain, location, pos, label, array_to_string(w, ' ') AS words, len(w) AS word_count FROM (
  SELECT *, list_filter(string_split(replace(label, '_', '-'), '-'), lambda x: x <> '') AS w FROM (
    SELECT url_id, p.host AS hostname, reg AS registered_domain, 'subdomain' AS location, unnest(range(len(string_split(sub, '.')))) AS pos, unnest(string_split(sub, '.')) AS label
    FROM p JOIN d ON p.host = d.host WHERE st = 'SUCCESS' AND ht = 'DEFAULT'
    UNION ALL SELECT url_id, p.host, reg, 'domain', 0, dom FROM p JOIN d ON p.host = d.host WHERE st = 'SUCCESS' AND ht = 'DEFAULT'))
WHERE len(w) >= 2"""


@query("url_word_split", O(WORDS, URL_PARTS, DOM))
def _(t):
    return C.url_word_split(C.with_domains(t.urls, index(t)))


EXT = lambda role: ", ".join(f"'{e}'" for e in role)
DOUBLE_EXT = rf"""
SELECT * FROM (SELECT *, lower(list_extract(s, -2)) AS first_extension, lower(list_extract(s, -1)) AS last_extension FROM (
  SELECT *, string_split(text, '.') AS s FROM (
    SELECT url_id, 'path' AS location, NULL AS name, NULL AS value_index, url_decode(list_extract(string_split(path0, '/'), -1)) AS text FROM p WHERE st = 'SUCCESS'
    UNION ALL SELECT url_id, 'query', name, row_number() OVER (PARTITION BY url_id, name ORDER BY pos) - 1, value FROM qp WHERE NOT bad))
  WHERE len(s) >= 3 AND list_extract(s, 1) <> '')
WHERE first_extension IN ({EXT(R.DECEPTIVE_EXTENSIONS)}) AND last_extension IN ({EXT(R.DANGEROUS_EXTENSIONS)})"""


@query("url_double_extension", O(f"SELECT url_id, location, name, value_index, text, first_extension, last_extension FROM ({DOUBLE_EXT})", URL_PARTS, QUERY_PARTS))
def _(t):
    return C.url_double_extension(t.urls)


@query("url_userinfo_host", O("SELECT url_id, split_part(ui, ':', 1) AS username, host AS real_host FROM p WHERE st = 'SUCCESS' AND split_part(ui, ':', 1) <> ''", URL_PARTS))
def _(t):
    return C.url_userinfo_host(t.urls)


def suffix_labels(t: Tables):
    return t.suffix_rules.where("section = 'icann' AND NOT rule RLIKE '^(!|[*])'").select(F.col("rule").alias("suffix_label")).distinct()


SUFFIX_SUB = """
SELECT url_id, hostname, registered_domain, i - 1 AS pos, l[i] AS label, CASE WHEN i > 1 THEN l[i - 1] || '.' || l[i] ELSE l[i] END AS found_text
FROM (SELECT url_id, p.host AS hostname, reg AS registered_domain, string_split(lower(sub), '.') AS l, unnest(range(1, len(string_split(sub, '.')) + 1)) AS i
  FROM p JOIN d ON p.host = d.host WHERE st = 'SUCCESS' AND sub <> '')
WHERE l[i] IN (SELECT rule FROM suffix_rules WHERE section = 'icann')"""


@query("url_suffix_in_subdomain", O(SUFFIX_SUB, URL_PARTS, DOM))
def _(t):
    return C.url_suffix_in_subdomain(C.with_domains(t.urls, index(t)), suffix_labels(t))


# Hosts with look-alike letters, one spelling per page; the answers are known by construction.
IDN_URLS = """
SELECT page_id AS url_id, CASE page_id % 5 WHEN 0 THEN 'https://xn--pypal-4ve.com/' WHEN 1 THEN 'https://www.xn--mnchen-3ya.org/' WHEN 2 THEN 'https://paypal.com/x'
  WHEN 3 THEN 'https://xn--80ak6aa92e.com/login' ELSE url END AS url FROM pages"""


@query("url_idn_skeleton", f"""
SELECT url_id, CASE k WHEN 0 THEN 'pаypal.com' WHEN 1 THEN 'www.münchen.org' ELSE 'аррӏе.com' END AS decoded_host,
  CASE k WHEN 0 THEN 'paypal.com' WHEN 1 THEN 'www.munchen.org' ELSE 'apple.com' END AS skeleton, NULL AS error
FROM (SELECT url_id, url_id % 5 AS k FROM ({IDN_URLS}) WHERE url LIKE '%xn--%')""")
def _(t):
    return C.url_idn_skeleton(t.sql(IDN_URLS))


@query("homograph_pairs", f"""
WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM ({IDN_URLS})),
s AS (SELECT host, CASE host WHEN 'xn--pypal-4ve.com' THEN 'paypal.com' WHEN 'www.xn--mnchen-3ya.org' THEN 'www.munchen.org' WHEN 'xn--80ak6aa92e.com' THEN 'apple.com' ELSE host END AS skeleton FROM h)
SELECT s.host, g.other_host, s.skeleton, g.n AS spellings FROM s JOIN (SELECT skeleton, min(host) AS other_host, count(*) AS n FROM s GROUP BY skeleton) g
ON s.skeleton = g.skeleton WHERE g.n > 1 AND s.host <> g.other_host""")
def _(t):
    return C.homograph_pairs(C.url_host(t.sql(IDN_URLS)).where("host IS NOT NULL"), "host")


@query("url_feed_active", O("""
SELECT row_number, source_status, len(list_intersect(w, ['active', 'online', 'yes'])) > 0 AND len(list_intersect(w, ['inactive', 'offline'])) = 0 AS active
FROM (SELECT row_number, source_status, list_transform(string_split(source_status, '|'), lambda x: lower(trim(x))) AS w FROM feed)""", fx="feed"))
def _(t):
    return C.url_feed_active(t.feed).select("row_number", "source_status", "active")


REJECTED = r"""
SELECT *, CASE WHEN NOT regexp_matches(url, '^https?:') THEN 'unsupported_scheme'
  WHEN regexp_matches(url, '^https?:///') THEN 'missing_hostname'
  WHEN regexp_matches(url, '^https?://[^/?#]*@') THEN 'userinfo_not_allowed'
  WHEN regexp_matches(url, '^https?://[^/?#:]*:[^/?#]*[^0-9/?#]') THEN 'malformed_url' END AS reason FROM feed"""


@query("url_rejection_reason", O(f"SELECT row_number, url, reason FROM ({REJECTED})", fx="feed"))
def _(t):
    return C.url_rejection_reason(t.feed).select("row_number", "url", "reason")


HOST_ADDRESSES = "SELECT concat('h', CAST(host_id AS STRING), '.example.net') AS host, ip FROM dns_answers"
ADMIT_URLS = """
SELECT page_id AS url_id, CASE page_id % 9 WHEN 0 THEN '  ' WHEN 1 THEN concat('http://h', CAST(page_id AS STRING), '.example.net:6379/') WHEN 2 THEN 'http://127.0.0.1/'
  WHEN 3 THEN 'https://a:b@example.net/' WHEN 4 THEN 'gopher://x/' WHEN 5 THEN concat('https://example.net/', repeat('x', 2100)) WHEN 6 THEN 'https://example.net:70000/'
  WHEN 7 THEN 'http://8.8.8.8/' ELSE concat('http://h', CAST(page_id AS STRING), '.example.net/') END AS url FROM pages"""
PRIVATE = r"(ip LIKE '10.%' OR ip LIKE '127.%' OR ip LIKE '2001:db8:%')"


@query("admission_reason", with_fixtures(f"""
SELECT url_id, CASE WHEN trim(url) = '' THEN 'empty_url' WHEN length(trim(url)) > 2048 THEN 'url_too_long'
  WHEN NOT regexp_matches(url, '^https?:') THEN 'scheme_not_allowed' WHEN url LIKE '%@%' THEN 'credentials_in_url'
  WHEN url LIKE '%:70000/' THEN 'port_out_of_range' WHEN url LIKE '%:6379/' THEN 'port_blocked'
  WHEN url LIKE 'http://127.%' OR b.host IS NOT NULL THEN 'address_not_public' END AS reason
FROM ({ADMIT_URLS}) u LEFT JOIN (SELECT DISTINCT host FROM ({HOST_ADDRESSES}) WHERE {PRIVATE}) b ON b.host = regexp_extract(u.url, '^http://([^/:]+)', 1)""", "dns_answers"))
def _(t):
    return C.admission_reason(t.sql(ADMIT_URLS), t.sql(HOST_ADDRESSES, "dns_answers"))


@query("url_public_target", with_fixtures(f"""
SELECT host_id, count(*) AS addresses, count(*) FILTER ({PRIVATE}) AS non_public, NOT bool_or({PRIVATE}) AS all_public FROM dns_answers GROUP BY host_id""", "dns_answers"))
def _(t):
    return C.url_public_target(t.dns_answers)


@query("domain_split", O("""
SELECT url_id, p.host AS hostname, sub AS subdomain, dom AS domain, suf AS suffix, reg AS registered_domain FROM p JOIN d ON p.host = d.host WHERE st = 'SUCCESS'""", URL_PARTS, DOM))
def _(t):
    return C.with_domains(t.urls, index(t)).where("hostname <> ''").select("url_id", "hostname", "subdomain", "domain", "suffix", "registered_domain")


@query("site_scope", O("""
SELECT url_id, p.host AS hostname, CASE WHEN reg <> '' THEN reg ELSE p.host END AS site_scope FROM p JOIN s ON p.host = s.host WHERE st = 'SUCCESS'""",
  URL_PARTS, dom("s", URLS, "'icann', 'private'")))
def _(t):
    hosts = C.url_host(t.urls).where("host IS NOT NULL").select("url_id", F.col("host").alias("hostname"))
    return D.site_scope(hosts, t.suffix_rules)


@query("responsibility_boundary", O("""
SELECT url_id, p.host AS hostname, CASE WHEN ht = 'DEFAULT' THEN 'DOMAIN' ELSE ht END AS host_kind,
  CASE WHEN ht <> 'DEFAULT' THEN '' WHEN a.reg <> '' THEN a.reg ELSE p.host END AS registrable_unit,
  CASE WHEN ht <> 'DEFAULT' THEN '' WHEN m.reg <> '' THEN m.reg ELSE p.host END AS responsibility_boundary,
  CASE WHEN ht <> 'DEFAULT' THEN 'not_applicable' WHEN m.suf <> f.suf THEN 'supplement' WHEN f.suf <> a.suf THEN 'private' ELSE 'none' END AS platform_match
FROM p JOIN a ON p.host = a.host JOIN f ON p.host = f.host JOIN m ON p.host = m.host WHERE st = 'SUCCESS'""",
  URL_PARTS, dom("a", URLS, default=1), dom("f", URLS, "'icann', 'private'", 1), dom("m", URLS, "'icann', 'private', 'supplement'", 1)))
def _(t):
    hosts = C.url_host(t.urls).where("host IS NOT NULL").select("url_id", F.col("host").alias("hostname"))
    return D.responsibility_boundary(hosts, t.suffix_rules)


TLDS = values([(x,) for x in R.HIGH_PHISHING_TLDS], "tld")
TLD_HITS = f"""
SELECT url_id, reg AS registered_domain, x.tld, '{R.TLD_LIST_VERSION}' AS list_version FROM p JOIN d ON p.host = d.host
JOIN {TLDS} x ON x.tld = list_extract(string_split(suf, '.'), -1) WHERE st = 'SUCCESS' AND suf <> ''"""


@query("url_tld_list", O(TLD_HITS, URL_PARTS, DOM))
def _(t):
    return C.url_tld_list(C.with_domains(t.urls, index(t)), R.tlds(t.spark))


PROVIDERS = values([(d, c) for c, ds in R.FREE_HOSTING.items() for d in ds], "provider, category")
FREE_HITS = f"""
SELECT url_id, p.host AS hostname, provider, sub AS subdomain, category FROM p JOIN d ON p.host = d.host JOIN {PROVIDERS} x ON x.provider = reg WHERE st = 'SUCCESS' AND sub <> ''"""


@query("url_free_hosting", O(FREE_HITS, URL_PARTS, DOM))
def _(t):
    return C.url_free_hosting(C.with_domains(t.urls, index(t)), R.free_hosting(t.spark))


SHORT = values([(x,) for x in R.JOURNEY_SHORTENERS], "domain")
SHORT_HITS = f"""
SELECT url_id, CASE WHEN p.host IN (SELECT domain FROM {SHORT}) THEN p.host ELSE reg END AS provider, NULL AS error
FROM p JOIN d ON p.host = d.host WHERE st = 'SUCCESS' AND reg <> '' AND (p.host IN (SELECT domain FROM {SHORT}) OR reg IN (SELECT domain FROM {SHORT}))"""


@query("url_shortener_list", O(SHORT_HITS, URL_PARTS, DOM))
def _(t):
    return C.url_shortener_list(C.with_domains(t.urls, index(t)), R.shorteners(t.spark))


EXTERNAL = r"""
e0 AS (SELECT qp.url_id, name, value, pos, p.host AS sh, p.ht AS sht, d.reg AS sreg,
    row_number() OVER (PARTITION BY qp.url_id, name ORDER BY pos) - 1 AS value_index,
    lower(regexp_extract(trim(value), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:]+)', 1)) AS host
  FROM qp JOIN p USING (url_id) JOIN d ON d.host = p.host WHERE NOT bad),
""" + dom("x", "SELECT host FROM e0 WHERE host <> ''").strip() + r""",
e1 AS (SELECT e0.*, x.reg AS treg, regexp_matches(e0.host, '^[0-9.]+$') AS tip FROM e0 JOIN x ON x.host = e0.host WHERE e0.host <> sh)"""
EXTERNAL_HITS = """
SELECT url_id, name, value_index, value, CASE WHEN error IS NULL THEN host END AS target_host, CASE WHEN error IS NULL AND treg <> '' THEN treg END AS target_domain, error
FROM (SELECT *, CASE WHEN (sht = 'DEFAULT' AND sreg = '') OR (NOT tip AND treg = '') THEN 'query_target_domain_unresolved' END AS error FROM e1)
WHERE error IS NOT NULL OR sreg = '' OR sreg <> treg"""


@query("url_external_query_target", O(EXTERNAL_HITS, URL_PARTS, QUERY_PARTS, DOM, EXTERNAL))
def _(t):
    return C.url_external_query_target(t.urls, index(t))


PAIRS = """
SELECT s.page_id AS pair_id, s.url AS source_url, CASE s.page_id % 7 WHEN 0 THEN 'mailto:x@example.net' WHEN 1 THEN concat('https://a', CAST(s.page_id % 3 AS STRING), '.pages.dev/') WHEN 2 THEN 'http://192.0.2.9/' WHEN 3 THEN s.url WHEN 4 THEN NULL
  ELSE d.url END AS destination_url
FROM pages s JOIN events e ON e.event_id = s.page_id JOIN pages d ON d.page_id = e.user_id"""


@query("url_relations", with_fixtures(r"""
SELECT pair_id, CASE WHEN ok THEN so = dor END AS same_origin, CASE WHEN ok THEN sh = dh END AS same_host,
  CASE WHEN ok AND a.reg <> '' AND b.reg <> '' THEN a.reg = b.reg END AS same_icann_domain,
  CASE WHEN ok THEN coalesce(nullif(sa.reg, ''), sh) = coalesce(nullif(sb.reg, ''), dh) END AS same_site_scope
FROM x LEFT JOIN a ON a.host = sh LEFT JOIN a b ON b.host = dh LEFT JOIN z sa ON sa.host = sh LEFT JOIN z sb ON sb.host = dh""", "suffix_rules",
  rf"""x AS (SELECT pair_id, regexp_extract(source_url, '^[a-z]+://([^/?#]+)', 1) AS sh, regexp_extract(destination_url, '^[a-z]+://([^/?#]+)', 1) AS dh,
  regexp_extract(source_url, '^[a-z]+://[^/?#]+') AS so, regexp_extract(destination_url, '^[a-z]+://[^/?#]+') AS dor, coalesce(destination_url LIKE 'http%', false) AS ok FROM ({PAIRS}))""",
  dom("a", "SELECT sh AS host FROM x UNION SELECT dh FROM x"), dom("z", "SELECT sh AS host FROM x UNION SELECT dh FROM x", "'icann', 'private'")))
def _(t):
    return D.url_relations(t.sql(PAIRS), t.suffix_rules, "source_url", "destination_url").select(
        "pair_id", "same_origin", "same_host", "same_icann_domain", "same_site_scope")


OBS = f"""
SELECT url_id, check_name, count(*) AS record_count, 10 AS check_count FROM (
  SELECT url_id, 'ip_host' AS check_name FROM p WHERE st = 'SUCCESS' AND ht <> 'DEFAULT'
  UNION ALL SELECT url_id, 'tld_list' FROM ({TLD_HITS}) UNION ALL SELECT url_id, 'free_hosting' FROM ({FREE_HITS})
  UNION ALL SELECT url_id, 'word_split' FROM ({WORDS}) UNION ALL SELECT url_id, 'double_extension' FROM ({DOUBLE_EXT})
  UNION ALL SELECT url_id, 'shortener' FROM ({SHORT_HITS}) UNION ALL SELECT url_id, 'external_query_target' FROM ({EXTERNAL_HITS}) WHERE error IS NULL
  UNION ALL SELECT url_id, 'userinfo_host' FROM p WHERE st = 'SUCCESS' AND split_part(ui, ':', 1) <> ''
  UNION ALL SELECT url_id, 'suffix_in_subdomain' FROM ({SUFFIX_SUB})) GROUP BY url_id, check_name"""


@query("url_observations", O(OBS, URL_PARTS, QUERY_PARTS, DOM, EXTERNAL))
def _(t):
    obs = C.url_observations(t.urls, index(t), R.tlds(t.spark), R.free_hosting(t.spark), R.shorteners(t.spark), suffix_labels(t))
    return C.observation_counts(obs)
