"""Derived input relations as SQL text that Spark and DuckDB both run unchanged.

The given tables hold no redirects, certificates, DNS answers, forms, feeds or network
log. Each is derived from whole given tables, so its size grows with them. Keys that need
an order use one that the source already has, so no derivation sorts a whole user's rows.
"""
from __future__ import annotations

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"

# Hidden elements inside hidden elements, and a quoted sign that ends no tag.
NESTED = '<div hidden>n1<div>n2</div>n3</div><template>t1<template>t2</template>t3</template><p title="a > b">plain</p>'
QUOTED_LINKS = '<a title="a>b" href="/q1">one</a><a class="k"href="/q2">two</a>'

FIXTURES: dict[str, tuple[str, str]] = {
    # name: (other fixtures it reads, SQL)
    "urls": ("", """
SELECT page_id AS url_id, CASE page_id % 24
  WHEN 0 THEN concat('http://192.0.2.', CAST(page_id % 250 AS STRING), '/a')
  WHEN 1 THEN concat('https://shop', CAST(page_id AS STRING), '.top/login')
  WHEN 2 THEN concat('https://u', CAST(page_id AS STRING), '.pages.dev/')
  WHEN 3 THEN concat('https://bit.ly/x', CAST(page_id AS STRING))
  WHEN 4 THEN 'https://example.org@login.example.net/'
  WHEN 5 THEN 'https://pay.com.example.net/'
  WHEN 6 THEN 'https://example.net/get/invoice.pdf.exe'
  WHEN 7 THEN 'https://example.net/?next=https%3A%2F%2Fexample.org%2F&next=%2Fhome&&v=%E0%A4%A'
  WHEN 8 THEN ''
  WHEN 9 THEN 'http://300.300.1.1/'
  WHEN 10 THEN 'ftp://files.example.net/x'
  WHEN 11 THEN 'https://brand-login.a_b.example.co.uk/'
  WHEN 12 THEN 'mailto:someone@example.net'
  WHEN 13 THEN 'http://0x7f.1/x'
  WHEN 14 THEN 'https://user:pw@example.com:8443/a?f=photo.jpg.scr'
  WHEN 15 THEN 'http://[2001:db8::1]:8080/'
  WHEN 16 THEN 'https://example.net:99999/'
  WHEN 17 THEN 'https://www.ck/?to=http://10.1.2.3/&u=//evil.example.org/p'
  WHEN 18 THEN 'http://shop.city.ck:22/'
  WHEN 19 THEN 'no scheme here'
  WHEN 20 THEN 'https://a.b.weebly.com/x?r=https://t.example.invalid/'
  ELSE url END AS url
FROM pages"""),
    "suffix_rules": ("", """
SELECT * FROM (VALUES ('com','icann'),('net','icann'),('org','icann'),('edu','icann'),('uk','icann'),('co.uk','icann'),
  ('top','icann'),('dev','icann'),('ly','icann'),('ck','icann'),('*.ck','icann'),('!www.ck','icann'),
  ('pages.dev','private'),('github.io','private'),('weebly.com','supplement')) AS t(rule, section)"""),
    "feed": ("", """
SELECT p.page_id AS row_number, CASE p.page_id % 11 WHEN 3 THEN concat('hxxp:', p.url) WHEN 5 THEN 'https://u:p@h.example.net/' WHEN 7 THEN 'https://h.example.net:port/' WHEN 9 THEN 'https:///nohost' ELSE p.url END AS url,
  CASE p.page_id % 4 WHEN 0 THEN 'feed-a' WHEN 1 THEN 'feed-b' WHEN 2 THEN 'feed-c' ELSE 'feed-d' END AS source,
  CASE p.page_id % 5 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'INACTIVE|yes' WHEN 2 THEN ' online |x' WHEN 3 THEN 'offline' ELSE '' END AS source_status,
  e.ts AS first_seen
FROM pages p JOIN events e ON e.event_id = p.page_id"""),
    "sightings": ("", """
SELECT e.event_id AS sighting_id, p.url, concat('feed-', e.event_type) AS source, e.ts AS seen_at
FROM events e JOIN pages p ON p.page_id = e.user_id"""),
    "responses": ("", """
SELECT page_id, url AS original_url, CASE page_id % 12 WHEN 11 THEN NULL ELSE url END AS final_url,
  CASE page_id % 12 WHEN 11 THEN NULL WHEN 5 THEN 500 ELSE 200 END AS status_code,
  CASE page_id % 5 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'application/json' WHEN 2 THEN NULL WHEN 3 THEN ' ; x' ELSE 'image/png' END AS content_type,
  CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/x-dosexec' ELSE NULL END AS detected_type,
  CASE page_id % 7 WHEN 0 THEN 'attachment; filename="a;b.EXE"' WHEN 1 THEN 'inline' WHEN 2 THEN 'ATTACHMENT; filename=x.txt; filename*=UTF-8''en''r%20s.js' WHEN 3 THEN 'attachment' ELSE NULL END AS disposition,
  CASE page_id % 6 WHEN 0 THEN '5; url=/next' WHEN 1 THEN '0.5, URL = "https://x.example.edu/"' WHEN 2 THEN 'soon' ELSE NULL END AS refresh,
  CASE page_id % 9 WHEN 4 THEN '' ELSE html END AS body, page_id % 10 = 3 AS truncated, CASE page_id % 3 WHEN 0 THEN '12345' WHEN 1 THEN 'x' ELSE NULL END AS content_length,
  CASE page_id % 13 WHEN 2 THEN 'body_interrupted' ELSE NULL END AS error_code
FROM pages"""),
    "hops": ("", """
SELECT journey_id, hop_no, source_url, destination_url FROM (
  SELECT journey_id, hop_no, url AS source_url, lead(url) OVER (PARTITION BY journey_id ORDER BY hop_no) AS destination_url
  FROM (SELECT l.l_orderkey AS journey_id,
      row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_shipdate) AS hop_no,
      CASE WHEN l.l_partkey % 29 = 0 THEN 'http://198.51.100.7/x' WHEN l.l_partkey % 31 = 0 THEN 'https://bit.ly/q' ELSE p.url END AS url
    FROM lineitem l JOIN pages p ON p.page_id = l.l_suppkey) j) h
WHERE destination_url IS NOT NULL"""),
    "journeys": ("", """
SELECT o.o_orderkey AS journey_id, p.url AS original_url,
  CASE o.o_orderstatus WHEN 'F' THEN NULL ELSE concat('https://final', CAST(o.o_custkey % 9 AS STRING), '.example.net/') END AS final_url
FROM orders o JOIN pages p ON p.page_id = o.o_orderkey % 50"""),
    "certs": ("", """
SELECT p.page_id AS cert_id, CASE WHEN p.page_id % 14 = 0 THEN '[2001:db8::1]' ELSE regexp_extract(p.url, '^[a-z]+://([^/?#:]+)', 1) END AS hostname,
  a.ts AS not_before, b.ts AS not_after,
  CASE p.page_id % 5 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS chain_valid,
  CASE p.page_id % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS self_signed,
  CASE p.page_id % 4 WHEN 0 THEN 'TLSv1.1' WHEN 1 THEN NULL WHEN 2 THEN 'TLSv1.2' ELSE 'TLSv1.3' END AS tls_version,
  CASE p.page_id % 6 WHEN 0 THEN 0 ELSE 1 + p.page_id % 3 END AS chain_depth,
  concat('O=Shop,CN=', regexp_extract(p.url, '^[a-z]+://([^/?#:]+)', 1)) AS subject,
  a.event_type <> 'error' AS has_leaf
FROM pages p JOIN events a ON a.event_id = p.page_id JOIN events b ON b.event_id = p.page_id + 300"""),
    "cert_san": ("", """
SELECT page_id AS cert_id, pos, name, CASE WHEN page_id % 5 = 0 THEN NULL WHEN name LIKE '%:%' THEN 'ip' ELSE 'dns' END AS kind FROM (
  SELECT page_id, 1 AS pos, CASE page_id % 3
    WHEN 0 THEN regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)
    WHEN 1 THEN concat('*.', regexp_extract(url, '^[a-z]+://[^.]+[.]([^/?#:]+)', 1))
    ELSE 'other.example.edu' END AS name FROM pages
  UNION ALL SELECT page_id, 2 AS pos, CASE page_id % 2 WHEN 0 THEN 'example.edu' ELSE '*.example.edu' END AS name FROM pages
  UNION ALL SELECT page_id, 3 AS pos, '2001:0DB8:0:0:0:0:0:1' AS name FROM pages WHERE page_id % 28 = 0) s"""),
    "scts": ("", "SELECT l_orderkey % 400 AS cert_id, l_shipdate AS ts FROM lineitem"),
    "ct_logs": ("", "SELECT o_orderkey % 500 AS cert_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS entry_timestamp FROM orders"),
    "dns_answers": ("", """
SELECT p.page_id AS host_id, e.event_id AS pos,
  CASE WHEN e.event_type = 'click' THEN concat('2001:db8:', CAST(p.page_id % 30 AS STRING), '::', CAST(CAST(floor(e.value) AS BIGINT) % 3 AS STRING))
  ELSE concat(CASE WHEN e.event_type = 'signup' THEN '8.' ELSE '10.' END, CAST(p.page_id % 25 AS STRING), '.', CAST(CAST(floor(e.value) AS BIGINT) % 4 AS STRING), '.9') END AS ip
FROM events e JOIN pages p ON p.page_id = e.user_id"""),
    "prefixes": ("", """
SELECT concat('10.', CAST(n_nationkey AS STRING), '.0.0') AS network, 16 AS prefix_len, 64500 + n_nationkey AS asn, n_name AS org FROM nation
UNION ALL SELECT '10.0.0.0', 8, 64499, 'BACKBONE' FROM region WHERE r_regionkey = 0
UNION ALL SELECT '2001:db8::', 32, 64498, 'BACKBONE6' FROM region WHERE r_regionkey = 0
UNION ALL SELECT concat('2001:0DB8:', CAST(n_nationkey AS STRING), ':0:0:0:0:0'), 48, 64700 + n_nationkey, n_name FROM nation
UNION ALL SELECT concat('10.', CAST(n_nationkey AS STRING), '.2.0'), 24, 64600 + n_nationkey, CAST(NULL AS STRING) FROM nation WHERE n_regionkey < 2"""),
    "pages_plus": ("", f"""
SELECT page_id, url, concat(replace(replace(html, '</article>', concat(CASE page_id % 8
  WHEN 0 THEN '<form id="f1" method="POST" action="https://collect.example.edu/in"><input type="password" name="pw"><input type="email" name="em" disabled><button type="submit">Go</button></form><input form="f1" name="card" autocomplete="username">'
  WHEN 1 THEN '<form action="/search"><input type="search" name="q"><button formmethod="post" formaction="https://other.example.edu/s">S</button></form>'
  WHEN 2 THEN '<form id="d"><input name="a"></form><form id="d" method="post"><input name="b"><input type="submit" value="ok"></form><input form="d" name="c">'
  WHEN 3 THEN '<img src="/logo.png" alt="x"><img src="https://cdn.example.edu/i.png"><iframe src="https://w.example.edu/f"></iframe><meta property="og:image" content="https://cdn.example.org/o.png">{NESTED}'
  WHEN 4 THEN concat('<script>fetch("https://collect.example.edu/x");eval(atob("eA=="));location.replace("/next");var r=/["`]/;/*fetch("https://no.example.edu/")*/x=`t $', '{{unescape("%41")}} u`;navigator.sendBeacon(`https://beacon.example.edu/b`)</script><textarea name="msg"></textarea>')
  WHEN 5 THEN '<script src="https://cdn.example.edu/a.js#v1" async></script><script src="https://cdn.example.edu/a.js#v2"></script><script src="//cdn.example.net/b.js" defer></script>{QUOTED_LINKS}'
  WHEN 6 THEN '<script type="application/json">{{"items":[{{"type":"button","text":"Pay","url":"https://pay.example.edu/"}},{{"name":"Home","href":"/"}}],"logo":{{"src":"/l.png","alt":"Logo"}},"nav_menu":[{{"title":"Home","url":"/"}}]}}</script>'
  ELSE '<a href="https://out.example.edu/p" onclick="go()" download target="_blank">out <b>there</b></a><div style="color:red; display:none">secret</div><p hidden>gone</p>' END, '</article>')),
  '<title>', concat(CASE page_id % 9 WHEN 0 THEN '<base href="https://base.example.edu/">' WHEN 1 THEN '<meta http-equiv="refresh" content="5; url=/moved">'
     WHEN 2 THEN '<meta http-equiv="Refresh" content="soon"><link rel="shortcut icon" href="/fav.ico">' WHEN 3 THEN '<base href="javascript:x">' ELSE '' END, '<title>')), '') AS html,
  page_id % 10 <> 3 AS source_complete
FROM pages"""),
    "js_events": ("", """
SELECT l_orderkey AS page_id, l_orderkey * 100 + n AS event_id, n AS pos, CASE l_partkey % 6 WHEN 0 THEN 'dynamic_execution' WHEN 1 THEN 'decode' WHEN 2 THEN 'network' WHEN 3 THEN 'redirect' WHEN 4 THEN 'environment' ELSE 'credential_read' END AS kind,
  concat('api', CAST(l_suppkey % 4 AS STRING)) AS api, CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS external,
  CASE WHEN l_quantity > 25 AND n > 1 THEN l_orderkey * 100 + n - 1 ELSE NULL END AS source_id
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem) x"""),
    "net_events": ("", """
SELECT user_id AS capture_id, concat(CAST(user_id AS STRING), '-', CAST(CAST(floor(event_id / 400) AS BIGINT) AS STRING)) AS request_id,
  event_id AS sequence, ts, CASE event_type WHEN 'view' THEN 'request' WHEN 'signup' THEN 'request' WHEN 'click' THEN 'response_received' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS state,
  CAST(floor(value) AS BIGINT) AS body_bytes
FROM events"""),
    "spans": ("", """
SELECT user_id AS run_id, event_type AS name, event_id * 2 AS start_ms, event_id * 2 + CAST(floor(value * 20) AS BIGINT) AS end_ms, event_type <> 'error' AS success
FROM events"""),
    "record_signals": ("", """
SELECT l_orderkey AS request_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS signal_no,
  concat('L', CAST(l_linenumber % 4 AS STRING)) AS layer,
  CASE WHEN l_returnflag = 'R' THEN true WHEN l_returnflag = 'A' THEN false ELSE NULL END AS detected,
  CASE WHEN l_linestatus = 'F' AND l_returnflag NOT IN ('A', 'R') THEN 'not_applicable' WHEN l_partkey % 17 = 0 THEN 'error' ELSE 'evaluated' END AS status,
  CASE l_partkey % 5 WHEN 0 THEN 'tls_timeout' WHEN 1 THEN 'html_source_truncated' WHEN 2 THEN 'target_policy_blocked' ELSE NULL END AS error_code
FROM lineitem"""),
    "reputation": ("", """
SELECT user_id AS url_id, concat('engine-', CAST(event_id % 40 AS STRING)) AS engine,
  CASE event_type WHEN 'error' THEN 'malicious' WHEN 'purchase' THEN 'suspicious' WHEN 'view' THEN 'harmless' ELSE 'undetected' END AS category
FROM events"""),
    "jobs": ("", """
SELECT o_orderkey AS job_id, o_custkey AS owner, o_orderdate AS created_at,
  CASE o_orderkey % 7 WHEN 0 THEN 'JUDGED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'GATE_BLOCKED' WHEN 3 THEN 'L1_DONE' WHEN 4 THEN 'PENDING' WHEN 5 THEN 'ODD' ELSE 'DNS_NAME_NONEXISTENT_AT_SCAN' END AS ledger_status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'MALICIOUS' WHEN '2-HIGH' THEN 'LIKELY_BENIGN' WHEN '3-MEDIUM' THEN 'PENDING' ELSE NULL END AS final_verdict
FROM orders"""),
    "judgments": ("", """
SELECT d.doc_id AS job_id, CASE WHEN l.toxic = 1 THEN 'MALICIOUS' WHEN l.quality = 1 THEN 'LIKELY_BENIGN' WHEN l.quality = 0 THEN 'UNKNOWN' ELSE 'MAYBE' END AS verdict,
  CASE WHEN d.doc_id % 9 = 0 THEN '' WHEN d.doc_id % 4 = 0 THEN 'the password is sent to an external host' ELSE d.text END AS interpretation
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""),
}


def closure(names: str) -> list[str]:
    """Fixture names with what they depend on, dependencies first."""
    out: list[str] = []

    def add(name: str) -> None:
        for dep in FIXTURES[name][0].split():
            add(dep)
        if name not in out:
            out.append(name)

    for name in names.split():
        add(name)
    return out
