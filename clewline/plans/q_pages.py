"""Page and script queries. Pages carry known added parts (see fixtures), so many answers are known by construction."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..operators import pages as P, scripts as S
from ..session import materialise
from ..fixtures import NESTED
from .registry import query, with_fixtures as W

PP = "pages_plus"
HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"
BASE = "CASE WHEN page_id % 9 = 0 THEN 'https://base.example.edu/' ELSE url END"
ORIGIN = "CASE WHEN page_id % 9 = 0 THEN 'https://base.example.edu' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+') END"
REG = "regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '([^.]+[.][^.]+)$', 1)"
B = f"b AS (SELECT *, page_id % 8 AS k, {BASE} AS eb, {ORIGIN} AS org, {REG} AS reg FROM pages_plus)"


def index(t):
    return R.suffix_index(t.suffix_rules)


@query("html_cap", "SELECT page_id, CASE WHEN strlen(html) > 3000 THEN NULL ELSE html END AS html, strlen(html) <= 3000 AS source_complete, CASE WHEN strlen(html) > 3000 THEN 'html_source_truncated' END AS error FROM pages")
def _(t):
    c = P.html_cap(t.pages, 3000)
    return c.select("page_id", F.when(F.col("source_complete"), F.col("html")).alias("html"), "source_complete", "error")


@query("html_type_filter", W("""SELECT page_id, e IS NULL AS analysed, e AS error FROM (SELECT page_id, CASE WHEN m IS NULL AND error_code IS NOT NULL THEN 'content_type_missing' WHEN m NOT IN ('text/html', 'application/xhtml+xml') THEN 'unsupported_content_type' END AS e
  FROM (SELECT *, nullif(lower(trim(split_part(content_type, ';', 1))), '') AS m FROM responses))""", "responses"))
def _(t):
    return P.html_type_filter(t.responses)


CLEAN = lambda x: f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query("page_document", W(f"""SELECT page_id, {CLEAN("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, strlen(html) AS size, sha256(html) AS sha256, reg AS etld1, source_complete FROM b""", PP, B))
def _(t):
    return P.page_document(t.pages_plus, index(t))


@query("page_visible_text", W(f"""
SELECT page_id, {CLEAN("regexp_replace(regexp_replace(regexp_replace(replace(replace(html, 'title=\"a>b\" ', ''), '" + NESTED + "', '<p>plain</p>'), '(?is)<head>.*?</head>|<script.*?</script>|<!--.*?-->', ' ', 'g'), '(?is)<div style[^>]*>.*?</div>|<p hidden>.*?</p>', ' ', 'g'), '(?is)<!doctype[^>]*>', ' ', 'g')")} AS text FROM b""", PP, B))
def _(t):
    return P.page_visible_text(t.pages_plus)


REFS = "SELECT e.event_id AS ref_id, p.url AS base, CASE e.event_id % 10 WHEN 0 THEN '/abs/x' WHEN 1 THEN 'rel' WHEN 2 THEN '../up' WHEN 3 THEN '?q=1' WHEN 4 THEN '#f' WHEN 5 THEN '//h.example.org/z' WHEN 6 THEN 'mailto:a@b' WHEN 7 THEN ' https://o.example.net/a/./b/../c ' WHEN 8 THEN '' ELSE './s/?y#z' END AS ref FROM events e JOIN pages p ON p.page_id = e.user_id"


@query("resolve_url", f"""
WITH r AS (SELECT ref_id, ref, base, regexp_extract(base, '^[a-z]+:', 0) AS sch, regexp_extract(base, '^[a-z]+://[^/?#]+') AS org, regexp_extract(base, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(base, '^[^?#]*([?][^#]*)?', 0) AS noq FROM ({REFS}))
SELECT ref_id, CASE ref_id % 10 WHEN 0 THEN org || '/abs/x' WHEN 1 THEN org || regexp_replace(path, '[^/]*$', '') || 'rel' WHEN 2 THEN org || regexp_replace(path, '[^/]*/[^/]*$', '') || 'up' WHEN 3 THEN org || path || '?q=1' WHEN 4 THEN noq || '#f'
  WHEN 5 THEN sch || '//h.example.org/z' WHEN 7 THEN 'https://o.example.net/a/c' WHEN 8 THEN base WHEN 9 THEN org || regexp_replace(path, '[^/]*$', '') || 's/?y#z' END AS resolved FROM r""")
def _(t):
    from ..functions.url import with_resolved
    return with_resolved(t.sql(REFS), "ref", "base", "resolved").select("ref_id", "resolved")


@query("page_base", W("SELECT page_id, url, CASE page_id % 9 WHEN 0 THEN 'https://base.example.edu/' WHEN 3 THEN 'javascript:x' END AS raw_href, CASE page_id % 9 WHEN 0 THEN 'https://base.example.edu/' END AS base_url, eb AS effective_base, CASE page_id % 9 WHEN 0 THEN true WHEN 3 THEN false END AS valid FROM b", PP, B))
def _(t):
    return P.page_base(t.pages_plus)


@query("base_url_change", W("""SELECT page_id, CASE WHEN cut THEN 'error' ELSE 'evaluated' END AS status, CASE page_id % 9 WHEN 0 THEN true WHEN 3 THEN NULL ELSE CASE WHEN NOT cut THEN false END END AS detected, CASE WHEN cut THEN 'html_analysis_incomplete' END AS error,
  CASE page_id % 9 WHEN 0 THEN 'https://base.example.edu/' END AS base_url FROM (SELECT *, NOT source_complete AND page_id % 9 NOT IN (0, 3) AS cut FROM b)""", PP, B))
def _(t):
    return P.base_url_change(t.pages_plus, P.page_base(t.pages_plus), index(t))


@query("meta_refresh", W("SELECT page_id, CASE page_id % 9 WHEN 1 THEN '5; url=/moved' ELSE 'soon' END AS raw_content, page_id % 9 = 1 AS valid, CASE page_id % 9 WHEN 1 THEN 5.0 END AS delay_seconds, CASE page_id % 9 WHEN 1 THEN org || '/moved' END AS target_url FROM b WHERE page_id % 9 IN (1, 2)", PP, B))
def _(t):
    return P.meta_refresh(t.pages_plus)


@query("html_redirect", W("SELECT page_id, CASE WHEN page_id % 9 = 1 THEN true WHEN source_complete THEN false END AS detected, CASE page_id % 9 WHEN 1 THEN 5.0 END AS delay_seconds, CASE page_id % 9 WHEN 1 THEN org || '/moved' END AS target_url FROM b", PP, B))
def _(t):
    return P.html_redirect(t.pages_plus, P.meta_refresh(t.pages_plus))


FORMS = """fm AS (SELECT page_id, url, 'f1' AS form_id, 'f1' AS html_id, 'post' AS method, 'https://collect.example.edu/in' AS action_url, 'resolved' AS resolution FROM b WHERE k = 0
UNION ALL SELECT page_id, url, 'form-1', NULL, 'get', org || '/search', 'resolved' FROM b WHERE k = 1
UNION ALL SELECT page_id, url, 'form-1', 'd', 'get', url, 'implicit_document' FROM b WHERE k = 2 UNION ALL SELECT page_id, url, 'form-2', 'd', 'post', url, 'implicit_document' FROM b WHERE k = 2)"""


@query("page_forms", W("SELECT * FROM fm", PP, B, FORMS))
def _(t):
    return P.page_forms(P.form_tokens(t.pages_plus)).drop("form_no")


def form_parts(t):
    """Forms and controls over one written token table, so page text is read once."""
    tokens = materialise(P.form_tokens(t.pages_plus), "form-tokens")
    forms = P.page_forms(tokens)
    return forms, P.form_controls(tokens, forms)


def rows(*items):
    return " UNION ALL ".join(f"SELECT page_id, {', '.join(v)} FROM b WHERE k = {k}" for k, *v in items)


@query("form_controls", W(rows(
    (0, "1 AS pos", "'input' AS tag", "'f1' AS form_id", "'enclosing' AS association"), (0, "2", "'input'", "'f1'", "'enclosing'"), (0, "3", "'button'", "'f1'", "'enclosing'"), (0, "5", "'input'", "'f1'", "'explicit'"),
    (1, "1", "'input'", "'form-1'", "'enclosing'"), (1, "2", "'button'", "'form-1'", "'enclosing'"), (2, "1", "'input'", "'form-1'", "'enclosing'"), (2, "4", "'input'", "'form-2'", "'enclosing'"),
    (2, "5", "'input'", "'form-2'", "'enclosing'"), (2, "7", "'input'", "NULL", "'ambiguous'"), (4, "0", "'textarea'", "NULL", "'none'")), PP, B))
def _(t):
    return form_parts(t)[1].drop("attrs", "url", "effective_base")


INPUTS = "i AS (" + rows(
    (0, "'input-1' AS field_id", "'f1' AS form_id", "'input' AS tag", "'password' AS type", "'pw' AS name", "NULL AS autocomplete", "false AS disabled"), (0, "'input-2'", "'f1'", "'input'", "'email'", "'em'", "NULL", "true"),
    (0, "'input-3'", "'f1'", "'input'", "'text'", "'card'", "'username'", "false"), (1, "'input-1'", "'form-1'", "'input'", "'search'", "'q'", "NULL", "false"),
    (2, "'input-1'", "'form-1'", "'input'", "'text'", "'a'", "NULL", "false"), (2, "'input-2'", "'form-2'", "'input'", "'text'", "'b'", "NULL", "false"), (2, "'input-3'", "'form-2'", "'input'", "'submit'", "NULL", "NULL", "false"),
    (2, "'input-4'", "NULL", "'input'", "'text'", "'c'", "NULL", "false"), (4, "'input-1'", "NULL", "'textarea'", "'text'", "'msg'", "NULL", "false")) + ")"


def fields(t):
    return P.page_inputs(form_parts(t)[1])


@query("page_inputs", W("SELECT * FROM i", PP, B, INPUTS))
def _(t):
    return fields(t).select("page_id", "field_id", "form_id", "tag", "type", "name", "autocomplete", "disabled")


@query("page_buttons", W(rows(
    (0, "'button-1' AS button_id", "'f1' AS form_id", "'submit' AS type", "'https://collect.example.edu/in' AS effective_action", "'post' AS effective_method", "false AS disabled"),
    (1, "'button-1'", "'form-1'", "'submit'", "'https://other.example.edu/s'", "'post'", "false"), (2, "'button-1'", "'form-2'", "'submit'", "url", "'post'", "false")), PP, B))
def _(t):
    forms, controls = form_parts(t)
    return P.page_buttons(controls, forms).drop("url")


@query("credential_classify", W("SELECT page_id, field_id, CASE WHEN type IN ('password', 'email') THEN type WHEN autocomplete = 'username' THEN 'username' END AS credential_type FROM i", PP, B, INPUTS))
def _(t):
    return P.credential_classify(fields(t)).select("page_id", "field_id", "credential_type")


@query("credential_form", W("SELECT page_id, CASE WHEN k = 0 THEN true WHEN source_complete THEN false END AS detected, CASE WHEN k = 0 THEN 1 ELSE 0 END AS form_count, CASE WHEN k = 0 THEN 'f1' END AS form_ids FROM b", PP, B))
def _(t):
    return P.credential_form(t.pages_plus, P.credential_classify(fields(t)))


@query("credential_field", W("SELECT page_id, CASE WHEN k = 0 THEN true WHEN source_complete THEN false END AS detected, CASE WHEN k = 0 THEN 'email,password,username' END AS field_types FROM b", PP, B))
def _(t):
    return P.credential_field(t.pages_plus, P.credential_classify(fields(t)))


@query("native_submission", W("SELECT page_id, field_id, CASE WHEN disabled THEN 'excluded_disabled' WHEN name IS NULL THEN 'excluded_missing_name' ELSE 'candidate_under_recorded_attributes_only' END AS state FROM i", PP, B, INPUTS))
def _(t):
    return P.native_submission(fields(t))


@query("form_action_domain", W("SELECT page_id, form_id, CASE WHEN k = 0 THEN false WHEN k = 1 THEN page_id % 9 <> 0 ELSE true END AS domain_match, NULL::BOOLEAN AS detected FROM fm JOIN b USING (page_id)", PP, B, FORMS))
def _(t):
    return P.form_action_domain(P.page_forms(P.form_tokens(t.pages_plus)), index(t))


@query("external_post", W("""SELECT page_id, CASE WHEN k > 2 THEN 'not_applicable' WHEN cut THEN 'error' ELSE 'evaluated' END AS status, CASE WHEN k < 2 THEN true WHEN k = 2 AND NOT cut THEN false END AS detected, CASE WHEN cut THEN 'html_analysis_incomplete' END AS error,
  CASE k WHEN 0 THEN 'https://collect.example.edu/in' WHEN 1 THEN 'https://other.example.edu/s' END AS destination, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS posts FROM (SELECT *, k = 2 AND NOT source_complete AS cut FROM b)""", PP, B))
def _(t):
    forms, controls = form_parts(t)
    return P.external_post(t.pages_plus, forms, P.page_buttons(controls, forms), t.suffix_rules)


IDS = "SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos, CASE l_partkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN concat('item-', CAST(l_linenumber AS STRING)) WHEN 2 THEN '' ELSE concat('u', CAST(l_partkey AS STRING)) END AS html_id FROM lineitem"


@query("stable_element_ids", f"""
WITH e AS (SELECT *, nullif(html_id, '') AS h, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM ({IDS})), c AS (SELECT page_id, h, count(*) AS n FROM e WHERE h IS NOT NULL GROUP BY 1, 2)
SELECT e.page_id, pos, CASE WHEN c.n = 1 THEN e.h WHEN (e.page_id, 'item-' || rn) IN (SELECT page_id, h FROM c) THEN 'generated:item-' || rn ELSE 'item-' || rn END AS element_id FROM e LEFT JOIN c ON c.page_id = e.page_id AND c.h = e.h""")
def _(t):
    return P.stable_element_ids(t.sql(IDS), "item").select("page_id", "pos", "element_id")


@query("page_images", W("SELECT page_id, 'image-1' AS image_id, org || '/logo.png' AS resource_url, CASE WHEN page_id % 9 = 0 THEN 'example.edu' ELSE reg END AS domain FROM b WHERE k = 3 UNION ALL SELECT page_id, 'image-2', 'https://cdn.example.edu/i.png', 'example.edu' FROM b WHERE k = 3", PP, B))
def _(t):
    return P.page_images(t.pages_plus, index(t))


@query("page_favicon", W("SELECT page_id, org || '/fav.ico' AS resource_url, reg AS domain FROM b WHERE page_id % 9 = 2", PP, B))
def _(t):
    return P.page_favicon(t.pages_plus, index(t))


@query("page_open_graph", W("SELECT page_id, 'og:image' AS property, 'https://cdn.example.org/o.png' AS content, 'https://cdn.example.org/o.png' AS resource_url FROM b WHERE k = 3", PP, B))
def _(t):
    return P.page_open_graph(t.pages_plus)


# The odd spellings of the fixture written plainly, so that a simple pattern finds all anchors.
LINKS = f"""lk AS (SELECT page_id, url, org, i, x, regexp_extract(x, 'href="([^"]*)"', 1) AS href FROM (SELECT *, unnest(regexp_extract_all(html, '(?is)<a [^>]*href[^>]*>.*?</a>')) AS x, unnest(range(1, len(regexp_extract_all(html, '(?is)<a [^>]*href[^>]*>.*?</a>')) + 1)) AS i
  FROM (SELECT * REPLACE (replace(replace(html, 'title="a>b" ', ''), 'class="k"href', 'href') AS html) FROM b)))"""


@query("page_links", W(f"""SELECT page_id, 'link-' || i AS link_id, i - 1 AS pos, {CLEAN('x')} AS text, href, CASE WHEN href LIKE 'http%' THEN href ELSE org || href END AS destination, CASE WHEN href LIKE '%out.example%' THEN '' END AS download, CASE WHEN href LIKE '%out.example%' THEN '_blank' END AS target FROM lk""", PP, B, LINKS))
def _(t):
    return P.page_links(t.pages_plus).drop("url")


@query("page_frames", W("SELECT page_id, 'frame-1' AS frame_id, 'https://w.example.edu/f' AS src, NULL AS srcdoc FROM b WHERE k = 3", PP, B))
def _(t):
    return P.page_frames(t.pages_plus)


@query("page_inline_handlers", W("SELECT page_id, 'a' AS tag, 'onclick' AS event, 'go()' AS source FROM b WHERE k = 7", PP, B))
def _(t):
    return P.page_inline_handlers(t.pages_plus)


@query("link_cap", W("SELECT page_id, CASE WHEN k = 7 THEN least(n, 4) ELSE n END AS kept, CASE WHEN k = 7 THEN greatest(n - 4, 0) ELSE 0 END AS omitted_n FROM (SELECT page_id, page_id % 8 AS k, count(*) AS n FROM lk GROUP BY 1)", PP, B, LINKS))
def _(t):
    return P.link_cap(P.page_links(t.pages_plus), t.pages_plus.where("page_id % 8 = 7"), 4)


@query("host_profile", W(f"""
SELECT {HOST} AS hostname, count(*) AS pages, sum(coalesce(links, 0))::BIGINT AS links, sum(coalesce(external, 0))::BIGINT AS external_links, bool_or(regexp_matches({HOST}, '[-_]')) AS word_split FROM b LEFT JOIN hl USING (page_id) GROUP BY 1""",
  PP, B, LINKS, "hl AS (SELECT page_id, count(*) AS links, count(*) FILTER (href LIKE 'http%' OR page_id % 9 = 0) AS external FROM lk GROUP BY 1)"))
def _(t):
    return P.host_profile(t.pages_plus, t.suffix_rules)


SCRIPTS = """sx AS (SELECT page_id, url, k, org, i, x, regexp_extract(x, '(?is)^<script[^>]*>(.*)</script>$', 1) AS body, regexp_extract(x, 'src="([^"]*)"', 1) AS src FROM (
  SELECT *, unnest(regexp_extract_all(html, '(?is)<script.*?</script>')) AS x, unnest(range(1, len(regexp_extract_all(html, '(?is)<script.*?</script>')) + 1)) AS i FROM b)),
sc AS (SELECT *, 'script-' || i AS script_id, CASE WHEN src = '' THEN 'inline' ELSE 'external' END AS type, CASE WHEN src LIKE '//%' THEN regexp_extract(org, '^[a-z]+:') || src WHEN src <> '' THEN src END AS source_url, CASE WHEN src = '' THEN body END AS source FROM sx)"""


@query("page_scripts", W("SELECT page_id, script_id, type, source_url, sha256(source) AS sha256, strlen(source) AS size, CASE WHEN x LIKE '%application/json%' THEN 'application/json' END AS media_type, contains(x, ' async>') AS is_async, contains(x, ' defer>') AS is_defer FROM sc", PP, B, SCRIPTS))
def _(t):
    return S.page_scripts(t.pages_plus).select("page_id", "script_id", "type", "source_url", "sha256", "size", "media_type", "is_async", "is_defer")


@query("script_status", W("SELECT page_id, script_id, CASE WHEN x LIKE '%application/json%' THEN 'data_block' WHEN source IS NULL THEN 'missing_source' WHEN strlen(source) > 400 THEN 'source_limit_exceeded' ELSE 'parsed' END AS status FROM sc", PP, B, SCRIPTS))
def _(t):
    return S.script_status(S.page_scripts(t.pages_plus), 400)


@query("script_reuse", W(f"SELECT sha256(source) AS sha256, count(DISTINCT page_id) AS pages, count(DISTINCT {HOST}) AS hosts FROM sc WHERE source IS NOT NULL GROUP BY 1", PP, B, SCRIPTS))
def _(t):
    return S.script_reuse(S.page_scripts(t.pages_plus))


@query("script_api_screen", W("""SELECT page_id, 'script-2' AS script_id, kind, api, 1 AS n, o AS first_offset FROM b, (VALUES ('dynamic_execution', 'eval', 11), ('decode', 'atob', 16), ('network', 'fetch', 1), ('redirect', 'location.replace', 26), ('decode', 'unescape', 64), ('network', 'navigator.sendBeacon', 78)) v(kind, api, o) WHERE k = 4""", PP, B))
def _(t):
    return S.script_api_screen(S.page_scripts(t.pages_plus))


@query("script_literal_destinations", W("SELECT page_id, 'script-2' AS script_id, 'network' AS kind, d AS destination, true AS external FROM b, (VALUES ('https://collect.example.edu/x'), ('https://beacon.example.edu/b')) v(d) WHERE k = 4 UNION ALL SELECT page_id, 'script-2', 'redirect', org || '/next', page_id % 9 = 0 FROM b WHERE k = 4", PP, B))
def _(t):
    return S.script_literal_destinations(S.page_scripts(t.pages_plus), t.suffix_rules)


@query("script_fetch_plan", W("SELECT page_id, script_id, CASE i WHEN 2 THEN 'fetch' WHEN 3 THEN 'shared' ELSE 'over_limit' END AS action FROM sc WHERE type = 'external'", PP, B, SCRIPTS))
def _(t):
    return S.script_fetch_plan(S.page_scripts(t.pages_plus), 1)


SRC = "SELECT conv_id AS page_id, concat('s', CAST(turn AS STRING)) AS script_id, turn AS pos, text AS source FROM conversations"


@query("script_text_budget", f"SELECT page_id, script_id, inc AS included, length(source) - inc AS omitted FROM (SELECT *, greatest(0, least(w, 900 - coalesce(sum(w) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS inc FROM (SELECT *, least(length(source), 400) AS w FROM ({SRC})))")
def _(t):
    return S.script_text_budget(t.sql(SRC), 400, 900)


JE = "js_events"
PGS = "SELECT o_orderkey AS page_id FROM orders"


@query("event_limit", W("""
SELECT e.event_id, e.kept, CASE WHEN e.kept THEN coalesce(NOT s.kept, false) END AS source_dropped FROM z e LEFT JOIN z s ON s.event_id = e.source_id""", JE,
  f"z AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY list_position({list(S.KIND_ORDER)}, kind), pos) <= 4 AS kept FROM js_events)"))
def _(t):
    return S.event_limit(t.js_events, 4)


@query("script_signal_counts", W(f"""
SELECT p.page_id, s AS signal_id, count(e.event_id) > 0 AS detected, count(e.event_id) AS n, string_agg(DISTINCT api, ',' ORDER BY api) AS apis, count(*) FILTER (external) AS external_n
FROM ({PGS}) p, (VALUES ('dynamic_execution', 'L3-J-01'), ('injection', 'L3-J-03'), ('network', 'L3-J-04'), ('redirect', 'L3-J-07'), ('environment', 'L3-J-08')) v(kind, s) LEFT JOIN js_events e ON e.page_id = p.page_id AND e.kind = v.kind GROUP BY 1, 2""", JE))
def _(t):
    return S.script_signal_counts(t.sql(PGS), t.js_events)


@query("decode_exec_chain", W(f"SELECT page_id, n > 0 AS detected, n, methods FROM (SELECT p.page_id, count(d.event_id) AS n, string_agg(DISTINCT d.api, ',' ORDER BY d.api) AS methods FROM ({PGS}) p LEFT JOIN js_events e ON e.page_id = p.page_id AND e.kind = 'dynamic_execution' LEFT JOIN js_events d ON d.event_id = e.source_id AND d.kind = 'decode' GROUP BY 1)", JE))
def _(t):
    return S.decode_exec_chain(t.sql(PGS), t.js_events)


@query("credential_access_exfil", W("""
SELECT page_id, 'L3-J-05' AS signal_id, r AS detected FROM c UNION ALL SELECT page_id, 'L3-J-06', CASE WHEN x > 0 THEN true WHEN r AND u > 0 THEN NULL ELSE false END FROM c""", JE,
  f"""c AS (SELECT p.page_id, coalesce(bool_or(e.kind = 'credential_read'), false) AS r, count(*) FILTER (e.kind = 'network' AND s.kind = 'credential_read' AND e.external) AS x,
  count(*) FILTER (e.kind = 'network' AND (s.kind IS NULL OR s.kind <> 'credential_read' OR e.external IS NULL)) AS u FROM ({PGS}) p LEFT JOIN js_events e USING (page_id) LEFT JOIN js_events s ON s.event_id = e.source_id GROUP BY 1)"""))
def _(t):
    return S.credential_access_exfil(t.sql(PGS), t.js_events)


ARMS = "SELECT l_orderkey AS page_id, l_linenumber AS branch_id, CASE WHEN l_returnflag = 'R' THEN 'a' ELSE 'b' END AS arm, l_linestatus AS behaviour, CAST(l_suppkey % 2 AS STRING) AS target FROM lineitem"


@query("env_branching", f"""
SELECT page_id, coalesce(d, false) AS detected, coalesce(n, 0) AS branches FROM ({PGS}) LEFT JOIN (SELECT page_id, bool_or(a <> b) AS d, count(*) AS n FROM (
  SELECT page_id, branch_id, coalesce(string_agg(behaviour || '|' || target, ',' ORDER BY behaviour, target) FILTER (arm = 'a'), '') AS a, coalesce(string_agg(behaviour || '|' || target, ',' ORDER BY behaviour, target) FILTER (arm = 'b'), '') AS b FROM ({ARMS}) GROUP BY 1, 2) GROUP BY 1) USING (page_id)""")
def _(t):
    return S.env_branching(t.sql(PGS), t.sql(ARMS))


COMPLETE = """SELECT request_id * 100 + signal_no AS target_id, layer AS signal_id, detected, signal_no % 3 <> 1 AS policy_set, CASE WHEN error_code = 'tls_timeout' THEN 'callback_parameters_unresolved' ELSE NULL END AS semantic_error,
  CASE WHEN error_code = 'target_policy_blocked' THEN 0 ELSE 2 END AS parsed_count, request_id % 4 <> 2 AS source_complete, CASE layer WHEN 'L3' THEN 0 ELSE 2 END AS script_count FROM record_signals"""


@query("signal_completeness", W(f"""
SELECT target_id, signal_id, CASE WHEN script_count = 0 THEN 'not_applicable' WHEN e IS NULL OR e LIKE 'detection%' THEN 'evaluated' ELSE 'error' END AS status, CASE WHEN e IS NULL AND script_count > 0 THEN detected END AS detected, e AS error
FROM (SELECT *, CASE WHEN script_count = 0 OR detected THEN NULL WHEN NOT policy_set THEN 'detection_policy_unresolved' WHEN parsed_count = 0 THEN 'javascript_analysis_unavailable'
  WHEN NOT source_complete THEN 'javascript_analysis_incomplete' WHEN semantic_error IS NOT NULL AND NOT detected THEN 'javascript_relationship_unresolved' END AS e FROM ({COMPLETE}))""", "record_signals"))
def _(t):
    return S.signal_completeness(t.sql(COMPLETE, "record_signals"))


ROOT = "regexp_extract(url, '^[a-z]+://[^/?#]+') || '/'"
JF = f"""SELECT page_id, 'script-2' AS script_id, path, kind, value, CASE value WHEN '/' THEN {ROOT} WHEN '/l.png' THEN {ROOT} || 'l.png' WHEN 'https://pay.example.edu/' THEN value END AS resolved_url, dt AS declared_type
FROM b, (VALUES ('/items/0/text', 'text', 'Pay', 'button'), ('/items/0/url', 'address', 'https://pay.example.edu/', 'button'), ('/items/1/href', 'address', '/', NULL), ('/logo/src', 'resource', '/l.png', NULL),
  ('/nav_menu/0/title', 'text', 'Home', NULL), ('/nav_menu/0/url', 'address', '/', NULL)) v(path, kind, value, dt) WHERE k = 6"""


@query("json_content_fields", W(JF, PP, B))
def _(t):
    return S.json_content_fields(S.page_scripts(t.pages_plus))


@query("content_groups", W(f"SELECT page_id, script_id, path, kind, value FROM ({JF}) WHERE path LIKE '/items/0%' OR (path LIKE '/nav%' AND page_id % 9 = 0)", PP, B))
def _(t):
    host = lambda c: F.regexp_extract(c, "^[a-z]+://([^/?#:]+)", 1)
    nav = P.page_links(t.pages_plus).groupBy("page_id").agg(F.bool_or(host("destination") == host("url")).alias("known_navigation"), F.min(host("url")).alias("page_host"))
    return S.content_groups(materialise(S.json_content_fields(S.page_scripts(t.pages_plus)), "json-fields"), nav)
