"""Rules of URLs, addresses, names, scripts, claims and pointers, and orders and quantiles against plain Python."""
import ipaddress
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from clewline import refdata as R
from clewline.functions import lexer, url as U
from clewline.operators import brand as B, infra as I, netlog as N, pages as P, scripts as S, transport as T, verdict as V, view as W
from clewline.session import scratch_path
from clewline.sources import feeds


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


SPELLINGS = {
    "https:\\\\evil.com\\x": "evil.com", "https:/evil.com/": "evil.com", "https:evil.com": "evil.com", "HTTPS://EVIL.com\\y?a\\b": "evil.com", "ht\ntps://evil.com/": "evil.com", " \x01https://evil.com ": "evil.com",
    "http://1.2.3.08/": None, "http://1.2.3.8/": "1.2.3.8", "http://0/": "0.0.0.0", "http://münchen.de/": "xn--mnchen-3ya.de", "http://MÜNCHEN.de/": "xn--mnchen-3ya.de", "http://m%C3%BCnchen.de/": "xn--mnchen-3ya.de",
    "http://[0:0:0:0:0:0:0:1]/": "[::1]", "http://[::1]:80/": "[::1]", "http://[2001:DB8:0:0:1::1]/": "[2001:db8::1:0:0:1]", "http://ｅｘ.com/": "ex.com", "https:///x.com": "x.com", "https://": None, "mailto:a@b": ""}


def test_spellings_of_a_host(spark):
    got = {r.url: r.hostname for r in U.with_parts(R.table(spark, [(u,) for u in SPELLINGS], "url")).collect()}
    assert got == SPELLINGS


def test_query_keeps_its_backslashes(spark):
    got = U.with_parts(R.table(spark, [("https://a.com\\b?c\\d#e\\f",)], "url")).first()
    assert (got.pathname, got.search, got.fragment) == ("/b", "?c\\d", "#e\\f")


def test_bootstring_against_the_codec(spark):
    draw = random.Random(3)
    labels = ["".join(draw.choice("abcz-09éüñßж日本語한글😀ÿ") for _ in range(draw.randint(1, 20))) for _ in range(150)] + ["ü", "aü", "üa", "-ü-", "日" * 20]
    got = {r.h: r.a for r in spark.createDataFrame([(x,) for x in labels], "h string").select("h", U.ascii_host(F.col("h")).alias("a")).collect()}
    for x in labels:
        low = x.lower()
        assert got[x] == (low if low.isascii() else "xn--" + low.encode("punycode").decode("ascii"))


def test_ipv6_spellings(spark):
    draw = random.Random(9)
    cases = [":".join(draw.choice(["0", "0", "0000", "1", "0a", "ffff"]) for _ in range(8)) for _ in range(120)] + ["::", "::1", "1::", "1::2", "fe80::1%eth0"]
    got = {r.x: r.y for r in R.table(spark, [(c,) for c in cases], "x").select("x", U.ipv6_text(U.ipv6_hex(F.col("x"))).alias("y")).collect()}
    for c in cases:
        plain = ipaddress.IPv6Address(c.partition("%")[0])
        assert got[c] == f"[{plain.compressed}]"


def test_longest_prefix_of_both_families(spark):
    draw = random.Random(1)
    nets = [ipaddress.ip_network(f"{draw.randrange(8, 12)}.{draw.randrange(4)}.{draw.randrange(256)}.0/{draw.choice([0, 8, 15, 16, 23, 24])}", strict=False) for _ in range(40)]
    nets += [ipaddress.ip_network((int(ipaddress.IPv6Address("2001:db8::")) + (draw.randrange(4) << 80) + (draw.randrange(16) << 60), draw.choice([32, 33, 45, 48, 64, 70, 128])), strict=False) for _ in range(40)]
    nets = sorted(set(nets), key=str)
    ips = [f"{draw.randrange(8, 13)}.{draw.randrange(4)}.{draw.randrange(256)}.9" for _ in range(60)] + [str(ipaddress.IPv6Address(int(ipaddress.IPv6Address("2001:db8::")) + (draw.randrange(5) << 80) + (draw.randrange(16) << 60))) for _ in range(60)]
    ips += ["2001:db8::1", "2001:0DB8:0:0:0:0:0:1", "nonsense", "1.2.3"]
    p = spark.createDataFrame([(n.network_address.exploded, n.prefixlen, k, str(n)) for k, n in enumerate(nets)], "network string, prefix_len int, asn int, org string")
    got = dict(rows(I.asn_most_specific(R.table(spark, [(i,) for i in ips], "ip"), p), "ip", "org"))
    for ip in set(ips):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            assert got[ip] is None
            continue
        inside = [n for n in nets if n.version == a.version and a in n]
        assert got[ip] == (str(max(inside, key=lambda n: n.prefixlen)) if inside else None), ip


def test_names_of_certificates(spark):
    certs = spark.createDataFrame([(1, "[2001:db8::1]"), (2, "[2001:db8::1]"), (3, "[2001:db8::1]"), (4, "a.b.com"), (5, "10.0.0.1"), (6, "a.b.com"), (7, "a.b.com"), (8, "[::1]")], "cert_id int, hostname string")
    certs = certs.withColumns({"subject": F.lit("O=x,CN=A.b.com"), "has_leaf": F.lit(True)})
    sans = spark.createDataFrame([(1, 1, "2001:0db8:0:0:0:0:0:1", "ip"), (2, 1, "2001:db8::1", None), (3, 1, "2001:db8::1", "dns"), (4, 1, "*.b.com", None), (5, 1, "10.0.0.1", "dns"), (5, 2, "10.0.0.1", "ip"), (6, 1, "a.b.com", "ip")],
                                 "cert_id int, pos int, name string, kind string")
    got = rows(T.cert_hostname_match(certs, sans), "cert_id", "matched", "scope")
    assert got == [(1, True, "typed_names"), (2, None, "untyped_names"), (3, False, "typed_names"), (4, True, "untyped_names"), (5, True, "typed_names"), (6, False, "typed_names"), (7, True, "subject_name_fallback"), (8, False, "typed_names")]


@pytest.mark.parametrize("source,code,texts", [
    ('var r=/["]/;eval(atob("q"))', 'var r=/r/;eval(atob("0"))', ["q"]), ("`a${eval(1)}b`+f", '"0"+(eval(1))+f', ["ab"]), ("a/b/c;eval(1)", "a/b/c;eval(1)", []), ("i++/2;eval(x);y/3", "i++/2;eval(x);y/3", []),
    ("if(x)/['\"]/.test(y);eval(1)", "if(x)/r/.test(y);eval(1)", []), ("(a)/2;g/1", "(a)/2;g/1", []), ('return/"/;eval(2)', "return/r/;eval(2)", []), ("`a${b?`c${eval(1)}`:{}}d`+e", '"0"+(b?"1"+(eval(1)):{})+e', ["ad", "c"]),
    ("x=/[/]'/.test('y')//'\nz", "x=/r/.test(\"0\") \nz", ["y"]), ("'it\\'s';`\\${x}`", '"0";"1"', ["it\\'s", "\\${x}"]), ('"open', '"0"', ["open"]), ("/* ' */a", " a", []), ("`${", '"0"+(', [""]), ("", "", [])])
def test_lexer(source, code, texts):
    assert lexer.read(source) == (code, texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 /\\\"'`${}()[]*\n;=+", max_size=60))
def test_lexer_ends_on_any_text(source):
    code, texts = lexer.read(source)
    assert code.count('"') == 2 * len(texts)


def test_lexer_is_linear():
    for source in ("/" * 200_000, "`${" * 60_000, "(" * 200_000, "'" + "\\a" * 200_000, "x=" + "/[" * 100_000):
        lexer.read(source)


def page(spark, html):
    return R.table(spark, [(1, "https://www.example.com/d/p", html, True)], "page_id url html source_complete")


def test_calls_in_comments_and_literals_are_none(spark):
    rules = R.table(spark, [("com", "icann"), ("org", "icann")], "rule section")
    s = S.page_scripts(page(spark, """<script>// fetch("https://evil.org/a")\n/*location.replace("/x")*/x="fetch('/y')";fetch(`/z`);r.open("GET","/w");location.href='/v'</script>"""))
    assert rows(S.script_literal_destinations(s, rules), "kind", "destination") == [("network", "https://www.example.com/w"), ("network", "https://www.example.com/z"), ("redirect", "https://www.example.com/v")]
    assert rows(S.script_api_screen(s), "api", "n") == [("XMLHttpRequest.open", 1), ("fetch", 1), ("location.href", 1)]


@pytest.mark.parametrize("many", [1, 9])
def test_quantiles_are_exact(spark, many):
    draw = np.random.default_rng(many)
    data = [(int(k % many), "n", 0, int(d), True) for k, d in enumerate(draw.integers(-5, 10**7, 3000))] + [(77, "one", 5, 6, False), (78, None, 3, 3, True), (79, "none", 1, None, True)]
    got = {(r.run_id, r.name): r for r in N.span_stats(spark.createDataFrame(data, "run_id bigint, name string, start_ms bigint, end_ms bigint, success boolean")).collect()}
    assert len(got) == many + 3 and got[79, "none"].p50 is None and got[78, None].p50 == 0 and got[77, "one"].failures == 1
    for k in range(many):
        own = [e for r, _, _, e, _ in data if r == k]
        assert abs(got[k, "n"].p50 - np.quantile(own, 0.5)) < 1e-6 and abs(got[k, "n"].p95 - np.quantile(own, 0.95)) < 1e-6 and got[k, "n"].n == len(own)


def test_a_capture_of_many_bodies(spark):
    b = spark.range(200_000).select(F.lit(1).cast("bigint").alias("capture_id"), F.format_string("r%06d", "id").alias("request_id"), F.col("id").alias("sequence"), (F.col("id") % 7).alias("body_bytes"))
    got = {r[0]: r[1] for r in N.body_budget(b, 5, 300_000).groupBy("status").count().collect()}
    used = expect = 0
    over = sum(k % 7 > 5 for k in range(200_000))
    for k in range(200_000):
        if k % 7 <= 5 and used + k % 7 <= 300_000:
            used, expect = used + k % 7, expect + 1
    assert got == {"captured": expect, "body_limit": over, "total_limit": 200_000 - expect - over}


def test_tokens_are_found_by_their_rarest_piece(spark):
    draw = random.Random(6)
    word = lambda n: "".join(draw.choice("abc ") for _ in range(n))
    titles = [(k, word(30), None, "x.y") for k in range(200)] + [(999, None, "Ab", "h.z")]
    tokens = [(f"b{k}", "title", t) for k, t in enumerate({word(n).strip() or "a" for n in (1, 2, 2, 3, 4, 5, 6, 7, 8, 9)})] + [("s", "site_name", "ab")]
    docs = spark.createDataFrame(titles, "page_id bigint, title string, site_name string, hostname string")
    got = rows(B._contains(docs, R.table(spark, tokens, "brand token_kind token"), "title", "title"), "page_id", "brand")
    assert got == sorted(((p, b) for p, t, _, _ in titles if t for b, kind, tok in tokens if kind == "title" and tok in t.lower()), key=repr)
    assert rows(B._contains(docs, R.table(spark, tokens, "brand token_kind token"), "site_name", "site_name"), "page_id", "brand") == [(999, "s")]


def test_claims(spark):
    said = {"the password is sent": (True, False), "no evidence that the password was sent": (False, False), "the credential has never been sent": (False, False), "Password was sent": (True, True),
            "암호가 흘러 나간다": (True, False), "비밀번호가 전송되었다": (True, True), "비밀번호를 보내지 않는다": (False, False), "password field; data sent": (False, False), "the configured form, where the password was sent": (True, True),
            "the form is configured so the password was sent": (True, False), "we could not load it but the password was sent": (True, True)}
    df = R.table(spark, [(t,) for t in said], "t").select("t", V.claims_transfer(F.col("t")).alias("a"), V.claims_transfer(F.col("t"), True).alias("b"))
    assert {r.t: (r.a, r.b) for r in df.collect()} == said


def test_verdicts_by_contract(spark):
    j = spark.createDataFrame([(1, "SUSPICIOUS", "t", "2"), (2, "SUSPICIOUS", "t", "1"), (3, "BENIGN", "t", "2"), (4, "BENIGN", "t", None), (5, "UNKNOWN", "t", "9"), (6, None, "t", "2")], "job_id bigint, verdict string, interpretation string, contract string")
    empty = spark.createDataFrame([], "job_id bigint, fact_id bigint")
    assert [r[0] for r in rows(V.verdict_contract(j, empty, empty).where("problem = 'invalid_verdict'"), "job_id")] == [2, 3, 5, 6]


def test_labels_in_compatibility_form(spark):
    items = R.table(spark, [("d", "Ｓｅｃ １", "Ⅳ — Straße", 7)], "doc section item fact_id")
    cited = R.table(spark, [(1, "d", "sec1", "iv-strasse")], "reason_id doc section item")
    assert rows(V.judgment_item_link(cited, items), "method", "status") == [("normalized", "resolved")]


def test_pointers(spark):
    cases = [('{"7":{"a":null}}', "/7/a", True, None, None), ('{"7":{"a":null}}', "/7/b", False, None, None), ('["x","y"]', "/1", True, "y", None), ('["x","y"]', "/01", False, None, None), ('["x"]', "/-", False, None, None),
             ('{"a/b":{"m~n":[{"q\'\\\\":5}]}}', "/a~1b/m~0n/0/q'\\", True, "5", None), ('{"a":1}', "/a~", None, None, "invalid_pointer"), ('{"a":1}', "a", None, None, "invalid_pointer"), ('"s"', "", True, "s", None),
             ("{", "/a", None, None, "invalid_json"), ('{"":{"":2}}', "//", True, "2", None), ('{"a":"t"}', "/a/0", False, None, None)]
    df = spark.createDataFrame([(k, c[0], c[1]) for k, c in enumerate(cases)], "k int, body string, pointer string")
    got = W.json_pointer(df, F.col("pointer")).orderBy("k").collect()
    assert [(r.exists, r.value, r.problem) for r in got] == [c[2:] for c in cases]


def test_files_are_numbered_by_name(spark, tmp_path):
    head = "url,sources,source_status,first_seen\n"
    for name, n in (("b.csv", 400), ("a.csv", 3), ("c.csv", 1)):
        (tmp_path / name).write_text(head + "".join(f"{name}{k},s,x,t\n" for k in range(n)))
    got = rows(feeds.read_url_dataset(spark, str(tmp_path)), "row_number", "url")
    want = [f"a.csv{k}" for k in range(3)] + [f"b.csv{k}" for k in range(400)] + ["c.csv0"]
    assert sorted(got) == list(zip(range(2, 406), want))


def test_attempts_are_written_once(spark):
    base = scratch_path(spark, "attempts")
    write = lambda ids, day: rows(feeds.write_attempt_immutable(*[spark.createDataFrame([(i, 1, x) for i in ids], "job_id int, attempt int, body string") for x in ("raw", "rec")], base, day), "job_id")
    assert write([1, 2], "2024-01-01") == [] and write([2, 3], "2024-01-01") == [(2,)] and write([1, 4], "2024-01-02") == [(1,)]
    assert rows(spark.read.parquet(f"{base}/records"), "job_id") == [(1,), (2,), (3,), (4,)] and spark.read.parquet(f"{base}/raw").count() == 4
