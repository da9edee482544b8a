"""Journey, header and certificate queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..operators import transport as T
from .registry import query, with_fixtures as W
from .sqlparts import dom, values

AT = "2024-01-20 12:00:00"
at = lambda: F.lit(AT).cast("timestamp")
J = "journeys hops"
AGG = "hc AS (SELECT journey_id, count(*) AS n, arg_max(destination_url, hop_no) AS last_destination FROM hops GROUP BY 1)"
SEEN = "(n IS NOT NULL OR final_url IS NOT NULL)"
ALL = """al AS (SELECT journey_id, 0 AS hop_no, original_url AS u FROM journeys UNION ALL SELECT journey_id, hop_no, destination_url FROM hops),
ah AS (SELECT *, regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1) AS host FROM al)"""
DOMS = dom("d", "SELECT host FROM ah")
NAMED = "nm AS (SELECT journey_id, hop_no, CASE WHEN suf = '' THEN dom ELSE dom || '.' || suf END AS dn FROM ah JOIN d USING (host))"


@query("redirect_chain", W(f"SELECT journey_id, CASE WHEN {SEEN} THEN n IS NOT NULL END AS detected, coalesce(n, 0) AS redirect_count, last_destination, final_url FROM journeys LEFT JOIN hc USING (journey_id)", J, AGG))
def _(t):
    return T.redirect_chain(t.journeys, t.hops)


@query("redirect_domain_change", W(f"""
SELECT journey_id, CASE WHEN {SEEN} THEN changes > 0 END AS detected, changes, unique_domains, original_domain, final_domain, original_domain <> final_domain AS final_changed
FROM journeys LEFT JOIN hc USING (journey_id) JOIN (SELECT journey_id, count(*) FILTER (hop_no > 0 AND dn IS DISTINCT FROM pd) AS changes, count(DISTINCT dn) AS unique_domains,
  arg_min(dn, hop_no) AS original_domain, arg_max(dn, hop_no) AS final_domain FROM (SELECT *, lag(dn) OVER (PARTITION BY journey_id ORDER BY hop_no) AS pd FROM nm) GROUP BY 1) USING (journey_id)""",
  J + " suffix_rules", AGG, ALL, DOMS, NAMED))
def _(t):
    return T.redirect_domain_change(t.journeys, t.hops, R.suffix_index(t.suffix_rules))


@query("redirect_to_ip", W(f"""
SELECT journey_id, CASE WHEN {SEEN} THEN coalesce(k > 0, false) END AS detected, destination_url, regexp_extract(destination_url, '//([0-9.]+)', 1) AS destination_ip
FROM journeys LEFT JOIN hc USING (journey_id) LEFT JOIN (SELECT journey_id, count(*) AS k, arg_min(destination_url, hop_no) AS destination_url FROM hops WHERE regexp_matches(destination_url, '//[0-9.]+(/|$)') GROUP BY 1) USING (journey_id)""", J, AGG))
def _(t):
    return T.redirect_to_ip(t.journeys, t.hops)


@query("shortener_journey", W(f"""
SELECT journey_id, CASE WHEN k > 0 THEN true WHEN {SEEN} THEN false END AS detected, shortener, CASE WHEN k > 0 AND n IS NOT NULL THEN final_url END AS resolved, coalesce(k, 0) AS matches
FROM journeys LEFT JOIN hc USING (journey_id) LEFT JOIN (SELECT journey_id, count(*) AS k, arg_min(dn, hop_no) AS shortener FROM nm WHERE dn IN (SELECT x FROM {values([(s,) for s in R.JOURNEY_SHORTENERS], 'x')}) GROUP BY 1) USING (journey_id)""",
  J + " suffix_rules", AGG, ALL, DOMS, NAMED))
def _(t):
    return T.shortener_journey(t.journeys, t.hops, R.suffix_index(t.suffix_rules), R.shorteners(t.spark))


@query("protocol_downgrade", W(f"""
SELECT journey_id, CASE WHEN {SEEN} THEN coalesce(downgrades, 0) > 0 END AS detected, coalesce(downgrades, 0) AS downgrades, coalesce(upgrades, 0) AS upgrades, source_url, destination_url
FROM journeys LEFT JOIN hc USING (journey_id) LEFT JOIN (SELECT journey_id, count(*) FILTER (dg) AS downgrades, count(*) FILTER (source_url LIKE 'http:%' AND destination_url LIKE 'https:%') AS upgrades,
  arg_min(source_url, hop_no) FILTER (dg) AS source_url, arg_min(destination_url, hop_no) FILTER (dg) AS destination_url
  FROM (SELECT *, source_url LIKE 'https:%' AND destination_url LIKE 'http:%' AS dg FROM hops) GROUP BY 1) USING (journey_id)""", J, AGG))
def _(t):
    return T.protocol_downgrade(t.journeys, t.hops)


BROKEN = "SELECT journey_id, hop_no, CASE WHEN length(source_url) % 5 = 0 THEN concat(source_url, '!') ELSE source_url END AS source_url, destination_url FROM hops"


@query("journey_connected", W(f"SELECT journey_id, hop_no, pd AS previous_destination, source_url FROM (SELECT *, lag(destination_url) OVER (PARTITION BY journey_id ORDER BY hop_no) AS pd FROM ({BROKEN})) WHERE source_url <> pd", "hops"))
def _(t):
    return T.journey_connected(t.sql(BROKEN, "hops"))


R_ = "responses"


@query("header_first", W("SELECT page_id, content_type AS value FROM responses", R_))
def _(t):
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), c.alias("value"))
    h = F.array(pair("X-A", F.lit("1")), pair("Content-TYPE", F.col("content_type")), pair("content-type", F.lit("late/dup")))
    return T.header_first(t.responses.select("page_id", h.alias("headers")), "content-type").select("page_id", "value")


MIME = "nullif(lower(trim(split_part(content_type, ';', 1))), '')"


@query("mime_type", W(f"SELECT page_id, {MIME} AS mime FROM responses", R_))
def _(t):
    return T.mime_type(t.responses).select("page_id", "mime")


# The four header spellings of the fixture and what they mean.
CD = "cd AS (SELECT *, CASE WHEN disposition IS NULL THEN NULL WHEN lower(disposition) LIKE 'attachment%' THEN 'attachment' ELSE 'inline' END AS dt, CASE WHEN disposition LIKE '%a;b%' THEN 'a;b.EXE' WHEN disposition LIKE '%r\\%20s%' ESCAPE '\\' THEN 'r s.js' END AS fn FROM responses)"
SEG = "CASE WHEN regexp_extract(final_url, '^[a-z]+://[^/]*[^?#]*?/([^/?#]*)(?:[?#].*)?$', 1) LIKE '%.%' THEN regexp_extract(final_url, '^[a-z]+://[^/]*[^?#]*?/([^/?#]*)(?:[?#].*)?$', 1) END"
FILE = f"fl AS (SELECT *, coalesce(fn, {SEG}) AS filename FROM cd), fx AS (SELECT *, CASE WHEN filename LIKE '%.%' THEN nullif(lower(list_extract(string_split(filename, '.'), -1)), '') END AS extension FROM fl)"


@query("content_disposition", W("SELECT page_id, dt AS disposition_type, fn AS disposition_filename FROM cd", R_, CD))
def _(t):
    return T.content_disposition(t.responses).select("page_id", "disposition_type", "disposition_filename")


@query("download_fields", W(f"SELECT page_id, filename, extension, {MIME} AS mime, CASE WHEN body <> '' THEN lower(hex(encode(body)[1:8])) END AS magic_hex FROM fx", R_, CD, FILE))
def _(t):
    return T.download_fields(t.responses).select("page_id", "filename", "extension", "mime", "magic_hex")


@query("body_identity", W("SELECT page_id, CASE WHEN body = '' THEN NULL WHEN truncated THEN try_cast(content_length AS BIGINT) ELSE strlen(body) END AS size, CASE WHEN body <> '' AND NOT truncated THEN sha256(body) END AS sha256 FROM responses", R_))
def _(t):
    return T.body_identity(t.responses).select("page_id", "size", "sha256")


@query("content_type_mismatch", W(f"""
SELECT page_id, m AS declared_type, detected_type, CASE WHEN m IS NOT NULL AND detected_type IS NOT NULL THEN NOT (m = detected_type OR (m, detected_type) IN (SELECT a, b FROM x) OR (detected_type, m) IN (SELECT a, b FROM x)) END AS detected
FROM (SELECT *, {MIME} AS m FROM responses)""", R_, f"x AS {values(R.MIME_ALIASES, 'a, b')}"))
def _(t):
    return T.content_type_mismatch(t.responses)


@query("dangerous_download", W(f"""
SELECT page_id, filename, extension, CASE WHEN NOT e AND detected_type IS NULL THEN NULL ELSE e OR detected_type LIKE '%dosexec' END AS detected
FROM (SELECT *, coalesce(extension IN (SELECT x FROM {values([(e,) for e in R.DOWNLOAD_EXTENSIONS], 'x')}), false) AS e FROM fx)""", R_, CD, FILE))
def _(t):
    return T.dangerous_download(t.responses)


@query("forced_download", W("SELECT page_id, CASE WHEN disposition IS NOT NULL THEN dt = 'attachment' WHEN final_url IS NOT NULL THEN false END AS detected, fn AS filename, CASE WHEN fn LIKE '%EXE' THEN 'exe' WHEN fn LIKE '%js' THEN 'js' END AS extension FROM cd", R_, CD))
def _(t):
    return T.forced_download(t.responses)


@query("http_refresh", W("""
SELECT page_id, CASE WHEN refresh IS NOT NULL THEN true WHEN final_url IS NOT NULL THEN false END AS detected,
  CASE WHEN refresh LIKE '5;%' THEN 5.0 WHEN refresh LIKE '0.5%' THEN 0.5 END AS delay_seconds,
  CASE WHEN refresh LIKE '5;%' THEN regexp_extract(coalesce(final_url, original_url), '^[a-z]+://[^/?#]+') || '/next' WHEN refresh LIKE '0.5%' THEN 'https://x.example.edu/' END AS target_url FROM responses""", R_))
def _(t):
    return T.http_refresh(t.responses)


@query("tls_target", W("""
SELECT page_id, CASE WHEN final_url LIKE 'https:%' OR original_url LIKE 'https:%' THEN regexp_extract(coalesce(CASE WHEN final_url LIKE 'https:%' THEN final_url END, original_url), '://([^/?#:]+)', 1) END AS host, 443 AS port FROM responses""", R_))
def _(t):
    return T.tls_target(t.responses)


TLS_ERRORS = "SELECT event_id AS error_id, CASE event_type WHEN 'view' THEN 'TimeoutError' WHEN 'click' THEN 'gaierror' WHEN 'signup' THEN 'SSLError' ELSE 'OSError' END AS error_type, CASE WHEN event_type = 'error' THEN concat('TLS target blocked: ', props) ELSE props END AS message FROM events"


@query("error_code_class", f"""
SELECT error_id, CASE WHEN message LIKE 'TLS target blocked:%' THEN 'tls_target_policy_blocked' ELSE coalesce(map {{'TimeoutError': 'tls_timeout', 'gaierror': 'tls_dns_resolution_failed', 'SSLError': 'tls_protocol_error'}}[error_type], 'tls_connection_failed') END AS code FROM ({TLS_ERRORS})""")
def _(t):
    return T.error_code_class(t.sql(TLS_ERRORS)).select("error_id", "code")


@query("scan_status", W("SELECT page_id, CASE WHEN status_code IS NULL THEN 'failed' WHEN error_code IS NOT NULL OR truncated THEN 'partial' ELSE 'completed' END AS status FROM responses", R_))
def _(t):
    return T.scan_status(t.responses, t.responses.where("error_code IS NOT NULL"))


DAYS = lambda since: f"CAST(floor((epoch_us(TIMESTAMP '{AT}') - epoch_us({since})) / 86400000000) AS BIGINT)"


@query("cert_age_days", W(f"SELECT cert_id, CASE WHEN has_leaf THEN {DAYS('not_before')} END AS age_days, CASE WHEN has_leaf THEN 'observed' ELSE 'unavailable' END AS measurement_state FROM certs", "certs"))
def _(t):
    return T.cert_age_days(t.certs, at())


@query("cert_validity", W(f"SELECT cert_id, status, status IN ('not_valid', 'expired') AS detected FROM (SELECT cert_id, CASE WHEN NOT has_leaf THEN NULL WHEN not_before > TIMESTAMP '{AT}' THEN 'not_valid' WHEN not_after < TIMESTAMP '{AT}' THEN 'expired' ELSE 'valid' END AS status FROM certs)", "certs"))
def _(t):
    return T.cert_validity(t.certs, at())


SOME_SANS = "SELECT s.* FROM cert_san s JOIN certs c ON c.cert_id = s.cert_id WHERE c.chain_depth > 0"
MATCH = f"""mt AS (SELECT c.cert_id, has_leaf, hostname, subject, chain_valid, regexp_extract(subject, 'CN=([^,]+)', 1) AS cn, hostname LIKE '[%' AS ip, count(s.name) AS k, count(s.kind) AS typed,
  arg_min(s.name, s.pos) FILTER (CASE WHEN hostname LIKE '[%' THEN s.kind = 'ip' ELSE s.name = hostname OR s.name = '*.' || substr(hostname, instr(hostname, '.') + 1) END) AS hit
  FROM certs c LEFT JOIN ({SOME_SANS}) s USING (cert_id) GROUP BY c.cert_id, has_leaf, hostname, subject, chain_valid),
mm AS (SELECT *, CASE WHEN has_leaf AND NOT (ip AND k > 0 AND typed = 0) THEN (k = 0 AND NOT ip) OR hit IS NOT NULL END AS matched FROM mt)"""


@query("cert_hostname_match", W("SELECT cert_id, matched, NOT matched AS detected, CASE WHEN matched THEN coalesce(hit, cn) END AS matched_name, CASE WHEN NOT has_leaf THEN 'unavailable' WHEN k = 0 AND NOT ip THEN 'subject_name_fallback' WHEN k > 0 AND typed = 0 THEN 'untyped_names' ELSE 'typed_names' END AS scope FROM mm", "certs cert_san", MATCH))
def _(t):
    return T.cert_hostname_match(t.certs, t.sql(SOME_SANS, "certs cert_san"))


@query("self_signed", W("SELECT cert_id, CASE WHEN has_leaf THEN self_signed END AS detected, CASE WHEN has_leaf THEN subject END AS subject FROM certs", "certs"))
def _(t):
    return T.self_signed(t.certs)


@query("cert_chain", W("SELECT cert_id, NOT chain_valid AS detected, nullif(chain_depth, 0) AS depth FROM certs", "certs"))
def _(t):
    return T.cert_chain(t.certs)


@query("tls_legacy", W("SELECT cert_id, tls_version, tls_version = 'TLSv1.1' AS detected FROM certs", "certs"))
def _(t):
    return T.tls_legacy(t.certs)


@query("wildcard_cert", W("SELECT cert_id, CASE WHEN has_leaf THEN w > 0 END AS detected, CASE WHEN has_leaf THEN w END AS wildcards, CASE WHEN has_leaf THEN n END AS san_count FROM certs JOIN (SELECT cert_id, count(*) FILTER (name LIKE '*.%') AS w, count(*) AS n FROM cert_san GROUP BY 1) USING (cert_id)", "certs cert_san"))
def _(t):
    return T.wildcard_cert(t.certs, t.cert_san)


@query("ct_first_seen", W(f"""
SELECT cert_id, first_seen, CASE WHEN has_leaf THEN CASE WHEN s IS NOT NULL THEN 'embedded_sct' WHEN g IS NOT NULL THEN 'log' END END AS source, CASE WHEN has_leaf THEN coalesce(sn, 0) END AS sct_count,
  CASE WHEN has_leaf AND s IS NULL THEN coalesce(gn, 0) END AS log_entries, {DAYS('first_seen')} AS age_days
FROM (SELECT *, CASE WHEN has_leaf THEN coalesce(s, g) END AS first_seen FROM certs LEFT JOIN (SELECT cert_id, min(ts) AS s, count(*) AS sn FROM scts GROUP BY 1) USING (cert_id)
  LEFT JOIN (SELECT cert_id, min(entry_timestamp) AS g, count(*) AS gn FROM ct_logs GROUP BY 1) USING (cert_id))""", "certs scts ct_logs"))
def _(t):
    return T.ct_first_seen(t.certs, t.scts, t.ct_logs, at())


@query("tls_identity", W("SELECT cert_id, hostname AS host, CASE WHEN has_leaf THEN subject END AS subject, matched, chain_valid FROM mm", "certs cert_san", MATCH))
def _(t):
    return T.tls_identity(t.certs, t.sql(SOME_SANS, "certs cert_san"))
