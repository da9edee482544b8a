"""Brand, policy and verdict queries, the joined signal table, and the two Python functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..functions.udfs import decode_html_udf, idn_decode_udf
from ..operators import brand as B, pages as P, scripts as S, signals as G, transport as T, verdict as V
from ..session import materialise
from . import q_pages as Q
from .q_transport import SOME_SANS, at
from .registry import ORACLES, query, with_fixtures as W

BRANDS = "SELECT r_name AS requested_name, concat('Q', CAST(r_regionkey AS STRING)) AS entity_id, r_name AS label, concat(lower(r_name), ' Inc.') AS alias FROM region"
TOKENS = f"""tk AS (SELECT DISTINCT label AS brand, token_kind, token FROM (SELECT label, 'title' AS token_kind, lower(n) AS token FROM nm UNION ALL SELECT label, 'site_name', lower(n) FROM nm UNION ALL SELECT label, 'hostname', lower(regexp_replace(n, '[^A-Za-z0-9]', '', 'g')) FROM nm))"""
NM = f"nm AS (SELECT label, requested_name AS n FROM ({BRANDS}) UNION SELECT label, alias FROM ({BRANDS}))"


def brands(t):
    return t.sql(BRANDS).withColumn("aliases", F.array("alias"))


@query("brand_policy_from_table", W("SELECT * FROM tk", "", NM, TOKENS))
def _(t):
    return B.brand_policy_from_table(brands(t))


DOCS = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN CONCAT('Welcome to Asia shop ', url) WHEN 1 THEN 'Europe and AFRICA news' WHEN 2 THEN NULL ELSE url END AS title, CASE page_id % 5 WHEN 0 THEN 'Middle East portal' ELSE NULL END AS site_name,
  CASE page_id % 4 WHEN 0 THEN 'login-america-pay.example.com' WHEN 1 THEN 'america1.example.com' ELSE regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) END AS hostname FROM pages"""
IDENT = f"""hit AS (SELECT page_id, brand, token_kind AS source FROM ({DOCS}) JOIN tk ON (token_kind = 'title' AND contains(lower(title), token)) OR (token_kind = 'site_name' AND contains(lower(site_name), token))
  OR (token_kind = 'hostname' AND regexp_matches(hostname, '(^|[.-])' || token || '([.-]|$)'))),
idn AS (SELECT d.page_id, CASE WHEN count(DISTINCT brand) = 1 THEN min(brand) END AS brand, CASE WHEN count(DISTINCT brand) = 1 THEN string_agg(DISTINCT source, ',' ORDER BY source) END AS sources,
  CASE WHEN count(DISTINCT brand) = 1 THEN CASE WHEN bool_or(source <> 'hostname') THEN 'high' ELSE 'low' END END AS confidence FROM ({DOCS}) d LEFT JOIN hit USING (page_id) GROUP BY 1)"""
CURRENT = "SELECT page_id, CASE page_id % 7 WHEN 0 THEN NULL ELSE regexp_extract(url, '([a-z]+[.](?:com|net|org))', 1) END AS current_domain FROM pages"
OWN = "SELECT r_name AS brand, CASE r_regionkey WHEN 0 THEN NULL WHEN 1 THEN 'example.com' ELSE 'example.org' END AS domain FROM region WHERE r_regionkey < 4"


def identified(t):
    return B.brand_identify(t.sql(DOCS), B.brand_policy_from_table(brands(t)))


@query("brand_identify", W("SELECT * FROM idn", "", NM, TOKENS, IDENT))
def _(t):
    return identified(t)


@query("brand_domain_mismatch", W(f"""
SELECT page_id, CASE WHEN l IS NULL THEN current_domain <> domain END AS detected, l AS limitation FROM (SELECT *, CASE WHEN i.brand IS NULL THEN 'brand_not_identified' WHEN o.brand IS NULL THEN 'brand_absent_from_domain_reference'
  WHEN current_domain IS NULL THEN 'brand_comparison_domain_unresolved' WHEN domain IS NULL THEN 'brand_domain_reference_empty' END AS l FROM idn i JOIN ({CURRENT}) USING (page_id) LEFT JOIN ({OWN}) o ON o.brand = i.brand)""", "", NM, TOKENS, IDENT))
def _(t):
    return B.brand_domain_mismatch(identified(t), t.sql(CURRENT), t.sql(OWN))


RES = "SELECT e.event_id AS res_id, p.page_id, CASE e.event_type WHEN 'view' THEN 'example.com' WHEN 'click' THEN 'shared.net' WHEN 'error' THEN NULL ELSE 'example.org' END AS domain FROM events e JOIN pages p ON p.page_id = e.user_id"
POL = "SELECT r_name AS brand, r_regionkey < 3 AS resource_policy FROM region WHERE r_regionkey < 4"


@query("brand_resource_mismatch", W(f"""
SELECT i.page_id, CASE WHEN resource_policy IS NULL OR current_domain IS NULL THEN NULL WHEN NOT coalesce(odd, false) THEN false WHEN resource_policy THEN true END AS detected
FROM idn i JOIN ({CURRENT}) c USING (page_id) LEFT JOIN ({POL}) USING (brand) LEFT JOIN (SELECT r.page_id, bool_or(r.domain <> c.current_domain AND r.domain <> 'shared.net' AND o.brand IS NULL) AS odd
  FROM ({RES}) r JOIN idn USING (page_id) JOIN ({CURRENT}) c USING (page_id) LEFT JOIN ({OWN}) o ON o.brand = idn.brand AND o.domain = r.domain WHERE r.domain IS NOT NULL GROUP BY 1) x ON x.page_id = i.page_id""", "", NM, TOKENS, IDENT))
def _(t):
    return B.brand_resource_mismatch(t.sql(RES), identified(t), t.sql(CURRENT), t.sql(OWN), t.spark.sql("SELECT 'shared.net' AS domain"), t.sql(POL))


RANKED = "SELECT c_custkey AS rank, concat('d', CAST(c_custkey AS STRING), '.com') AS domain FROM customer"
ENT = "SELECT concat('Q', CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN concat('x', CAST(o_orderkey AS STRING)) ELSE CAST(o_custkey AS STRING) END) AS entity_id, concat('d', CAST(o_custkey AS STRING), '.com') AS domain FROM orders"


@query("brand_resolve", f"SELECT rank, domain, CASE WHEN n = 1 THEN e END AS entity_id, CASE WHEN n IS NULL THEN 'no_entity' WHEN n > 1 THEN 'several_entities' END AS unresolved FROM ({RANKED}) LEFT JOIN (SELECT domain, count(DISTINCT entity_id) AS n, min(entity_id) AS e FROM ({ENT}) GROUP BY 1) USING (domain)")
def _(t):
    return B.brand_resolve(t.sql(RANKED), t.sql(ENT))


CLAIMS = "SELECT o_custkey AS entity_id, concat('https://www.s', CAST(o_orderkey % 40 AS STRING), '.example.com/x') AS url0, concat('https://www.s', CAST(o_orderkey % 40 AS STRING), '.com/x') AS url, CASE o_orderstatus WHEN 'F' THEN 'deprecated' WHEN 'O' THEN 'normal' ELSE 'preferred' END AS claim_rank, CASE WHEN o_totalprice > 250000 THEN o_orderdate ELSE NULL END AS end_time FROM orders"


@query("official_domains", W(f"""
SELECT DISTINCT entity_id, regexp_extract(url, 'www[.]([^/]+)', 1) AS domain FROM c WHERE claim_rank = 'preferred' OR entity_id NOT IN (SELECT entity_id FROM c WHERE claim_rank = 'preferred')""", "",
  f"c AS (SELECT * FROM ({CLAIMS}) WHERE claim_rank <> 'deprecated' AND (end_time IS NULL OR end_time > TIMESTAMP '1996-01-01'))"))
def _(t):
    return B.official_domains(t.sql(CLAIMS), F.lit("1996-01-01").cast("timestamp"), R.suffix_index(t.suffix_rules))


NAMES = "SELECT l_orderkey AS entity_id, CASE l_linenumber % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ko' ELSE 'de' END AS lang, CASE WHEN l_returnflag = 'R' THEN 'label' ELSE 'alias' END AS kind, concat(CASE WHEN l_linestatus = 'F' THEN 'N' ELSE 'n' END, CAST(l_suppkey % 9 AS STRING)) AS value FROM lineitem"
ASKED = "SELECT o_orderkey AS entity_id, concat('N', CAST(o_custkey % 9 AS STRING)) AS requested_name FROM orders"


@query("entity_labels", W("""
SELECT a.entity_id, label, alias, coalesce(bool_or(lower(requested_name) IN (SELECT folded FROM al z WHERE z.entity_id = a.entity_id)), false) AS requested_found
FROM al a JOIN lb USING (entity_id) LEFT JOIN rq USING (entity_id) WHERE folded <> lower(label) GROUP BY 1, 2, 3""", "",
  f"n AS (SELECT *, CASE lang WHEN 'ko' THEN 1 ELSE 2 END AS r FROM ({NAMES}) WHERE lang IN ('ko', 'en'))",
  "al AS (SELECT entity_id, lower(value) AS folded, min(value) AS alias FROM n GROUP BY 1, 2)", "lb AS (SELECT entity_id, arg_min(value, (r, value)) AS label FROM n WHERE kind = 'label' GROUP BY 1)", f"rq AS ({ASKED})"))
def _(t):
    return B.entity_labels(t.sql(NAMES), t.sql(ASKED), ("ko", "en"))


POLICY = """SELECT s_suppkey AS policy_id, concat('{"schema_version":"1.0","policy_name":"', s_name, '","credential_fields":', CASE s_suppkey % 5 WHEN 4 THEN '7' ELSE concat('{"type_mapping":{"password":"password","email":"email"},"autocomplete_mapping":{"username":"username"},"identifier_tokens":{"password":["passwd"],"username":["login"', CASE s_suppkey % 5 WHEN 3 THEN ',"Passwd"' ELSE '' END, ']}}') END,
  ',"brands":{},"javascript":{}', CASE s_suppkey % 5 WHEN 2 THEN ',"extra":1' ELSE '' END, '}') AS body FROM supplier"""


@query("policy_tables", """
SELECT policy_id, map, key, kind, NULL AS problem FROM (SELECT s_suppkey AS policy_id, s_suppkey % 5 AS k FROM supplier) , (VALUES ('type', 'password', 'password', 9), ('type', 'email', 'email', 9), ('autocomplete', 'username', 'username', 9), ('token', 'passwd', 'password', 9), ('token', 'login', 'username', 9), ('token', 'Passwd', 'username', 3)) v(map, key, kind, o)
WHERE k <> 4 AND (o = 9 OR k = 3)
UNION ALL SELECT s_suppkey, NULL, CASE s_suppkey % 5 WHEN 2 THEN 'extra' WHEN 3 THEN 'passwd' ELSE 'credential_fields' END, NULL, CASE s_suppkey % 5 WHEN 2 THEN 'unknown_field' WHEN 3 THEN 'token_with_two_kinds' ELSE 'wrong_type' END FROM supplier WHERE s_suppkey % 5 IN (2, 3, 4)""")
def _(t):
    rules, problems = B.policy_tables(t.sql(POLICY))
    return rules.unionByName(problems.withColumnRenamed("subject", "key"), allowMissingColumns=True)


JD = "judgments"
REASONS = "SELECT l_orderkey AS job_id, l_partkey AS fact_id FROM lineitem"
FACTS = "SELECT p_partkey AS fact_id, p_size % 3 = 0 AS transfer_relation, p_size % 2 = 0 AS execution_observed FROM part WHERE p_size < 45"


VERSIONED = "SELECT *, CASE job_id % 3 WHEN 0 THEN '2' WHEN 1 THEN '1' ELSE NULL END AS contract FROM (SELECT job_id, interpretation, CASE WHEN job_id % 10 = 7 THEN 'SUSPICIOUS' WHEN job_id % 10 = 5 THEN 'BENIGN' ELSE verdict END AS verdict FROM judgments) v"


@query("verdict_contract", W(f"""
SELECT job_id, 'invalid_verdict' AS problem FROM vj WHERE verdict IS NULL OR NOT CASE WHEN contract = '2' THEN verdict IN {V.VERDICTS['2']} ELSE verdict IN {V.VERDICTS['1']} END UNION ALL SELECT job_id, 'empty_text' FROM vj WHERE trim(interpretation) = ''
UNION ALL SELECT job_id, 'missing_reasons' FROM vj WHERE verdict IS DISTINCT FROM 'UNKNOWN' AND job_id NOT IN (SELECT job_id FROM ({REASONS})) UNION ALL SELECT DISTINCT job_id, 'duplicate_fact_id' FROM (SELECT job_id FROM ({REASONS}) GROUP BY job_id, fact_id HAVING count(*) > 1)
UNION ALL SELECT DISTINCT job_id, 'unknown_fact_id' FROM ({REASONS}) WHERE fact_id NOT IN (SELECT fact_id FROM ({FACTS}))""", JD, f"vj AS ({VERSIONED})"))
def _(t):
    return V.verdict_contract(t.sql(VERSIONED, JD), t.sql(REASONS), t.sql(FACTS))


# Claims and denials whose answers are known by construction, and the documents' own texts, which hold none.
CLAIMS_SAID = """SELECT job_id, CASE job_id % 9 WHEN 1 THEN 'the password is sent to an external host' WHEN 2 THEN 'There is no evidence that the password was sent' WHEN 3 THEN 'The credential has never been sent, however the page loads'
  WHEN 4 THEN 'the password was sent. Nothing else' WHEN 5 THEN '암호가 외부로 흘러 나간다' WHEN 6 THEN '비밀번호가 전송되었다' WHEN 7 THEN '비밀번호가 전송되지 않았다' WHEN 8 THEN 'the form is configured so that the password was sent' ELSE interpretation END AS interpretation FROM judgments"""


@query("verdict_basis_support", W(f"""
SELECT job_id, code AS finding_code FROM (SELECT job_id, CASE WHEN NOT coalesce(linked, false) THEN 'credential_transfer_without_linked_basis' WHEN job_id % 9 IN (4, 6) AND NOT coalesce(seen, false) THEN 'observed_transfer_without_observed_basis' END AS code
  FROM (SELECT job_id FROM judgments WHERE job_id % 9 IN (1, 4, 5, 6, 8)) LEFT JOIN (SELECT job_id, bool_or(transfer_relation) AS linked, bool_or(transfer_relation AND execution_observed) AS seen FROM ({REASONS}) JOIN ({FACTS}) USING (fact_id) GROUP BY 1) USING (job_id)) WHERE code IS NOT NULL""", JD))
def _(t):
    return V.verdict_basis_support(t.sql(CLAIMS_SAID, JD), t.sql(REASONS), t.sql(FACTS))


ITEMS = "SELECT l_suppkey AS doc, concat('Sec ', CAST(l_linenumber % 3 AS STRING)) AS section, concat('Item ', CAST(l_partkey % 500 AS STRING), '인증서') AS item, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_orderkey END AS fact_id FROM lineitem"
CITED = """SELECT event_id AS reason_id, user_id AS doc, concat(CASE event_type WHEN 'view' THEN 'SEC' WHEN 'click' THEN 'Other' ELSE 'Sec' END, ' ', CAST(event_id % 3 AS STRING)) AS section, concat(CASE event_id % 7 WHEN 3 THEN 'Ｉtem ' ELSE 'Item ' END, CAST(event_id % 500 AS STRING), CASE event_type WHEN 'error' THEN '인정서' ELSE '인증서' END) AS item FROM events"""
FOLD = lambda c: f"regexp_replace(lower(replace({c}, 'Ｉ', 'I')), '\\s+', '', 'g')"


@query("judgment_item_link", W("""
SELECT reason_id, CASE WHEN n = 1 THEN f END AS fact_id, method, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' WHEN f IS NOT NULL THEN 'resolved' ELSE 'model_only' END AS status
FROM c LEFT JOIN (SELECT reason_id, arg_min(method, s) AS method, arg_min(n, s) AS n, arg_min(coalesce(f, -1), s) AS f0 FROM m GROUP BY 1) USING (reason_id) LEFT JOIN LATERAL (SELECT nullif(f0, -1) AS f) ON true""", "",
  f"i AS (SELECT *, {FOLD('section')} AS ns, {FOLD('item')} AS ni FROM ({ITEMS}))", f"c AS (SELECT *, {FOLD('section')} AS ns, {FOLD('item')} AS ni FROM ({CITED}))",
  """m AS (SELECT reason_id, 0 AS s, 'exact' AS method, count(*) AS n, min(fact_id) AS f FROM c JOIN i USING (doc, section, item) GROUP BY 1 UNION ALL SELECT reason_id, 1, 'normalized', count(*), min(fact_id) FROM c JOIN i USING (doc, ns, ni) GROUP BY 1
  UNION ALL SELECT reason_id, 2, 'item_label', count(*), min(fact_id) FROM c JOIN i USING (doc, ni) GROUP BY 1 UNION ALL SELECT reason_id, 3, 'spelling', count(*), min(fact_id) FROM c JOIN i ON c.doc = i.doc AND c.ns = i.ns AND c.ni <> i.ni AND replace(c.ni, '인정서', '인증서') = i.ni GROUP BY 1)"""))
def _(t):
    return V.judgment_item_link(t.sql(CITED), t.sql(ITEMS))


# What each signal is compared with: the SQL of its own query, and its key there.
HEADER_SQL = ("redirect_chain", "redirect_domain_change", "redirect_to_ip", "shortener_journey", "content_type_mismatch", "dangerous_download", "forced_download", "http_refresh", "protocol_downgrade")
CERT_SQL = ("cert_age_days", "cert_validity", "cert_hostname_match", "self_signed", "cert_chain", "ct_first_seen", "tls_legacy", "wildcard_cert")
JOURNEY = ("redirect_chain", "redirect_domain_change", "redirect_to_ip", "shortener_journey", "protocol_downgrade")


def _collected_sql(position: int, signal: str, name: str) -> str:
    key = "journey_id" if name in JOURNEY else "cert_id" if name in CERT_SQL else "page_id"
    lack = f"CASE WHEN x.{key} IS NULL THEN 'not_collected'{' WHEN x.age_days IS NULL THEN ' + repr('measurement_unavailable') if signal in G.MEASURED else ''} END"
    detected = "NULL::BOOLEAN" if signal in G.MEASURED else "x.detected"
    return f"SELECT p.page_id AS target_id, {position} AS position, '{signal}' AS signal_id, CASE WHEN {lack} IS NULL THEN 'evaluated' ELSE 'error' END AS status, {detected} AS detected, {lack} AS error FROM pages p LEFT JOIN ({ORACLES[name]}) x ON x.{key} = p.page_id"


def _html_sql() -> str:
    raw = {1: "k = 0", 2: "k = 0", 3: "NULL::BOOLEAN", 4: "CASE WHEN k < 3 THEN k < 2 END", 5: "h5.detected", 6: "h6.detected", 7: "b.page_id % 9 = 1", 8: "CASE b.page_id % 9 WHEN 0 THEN true WHEN 3 THEN NULL ELSE false END"}
    idle = {3: "k > 2", 4: "k > 2"}
    parts = []
    for n, value in raw.items():
        cut, none = f"(NOT source_complete AND ({value}) IS NOT DISTINCT FROM false)", idle.get(n, "false")
        parts.append(f"SELECT b.page_id, {len(G.HEADER + G.CERTIFICATE) + n}, 'L3-H-0{n}', CASE WHEN {none} THEN 'not_applicable' WHEN {cut} THEN 'error' ELSE 'evaluated' END, CASE WHEN NOT ({none}) AND NOT {cut} THEN {value} END, CASE WHEN NOT ({none}) AND {cut} THEN 'html_analysis_incomplete' END "
                     f"FROM b LEFT JOIN h5 USING (page_id) LEFT JOIN h6 USING (page_id)")
    return " UNION ALL ".join(parts)


def _script_sql() -> str:
    first = len(G.HEADER + G.CERTIFICATE + G.HTML)
    names = {"L3-J-02": "decode_exec_chain", "L3-J-09": "env_branching"}
    rows = [f"SELECT page_id, signal_id, detected FROM ({ORACLES[n]})" for n in ("script_signal_counts", "credential_access_exfil")] + [f"SELECT page_id, '{s}', detected FROM ({ORACLES[n]})" for s, n in names.items()]
    return f"""SELECT target_id, position, signal_id, CASE WHEN script_count = 0 THEN 'not_applicable' WHEN e IS NULL THEN 'evaluated' ELSE 'error' END, CASE WHEN e IS NULL AND script_count > 0 THEN detected END, e
FROM (SELECT *, CASE WHEN script_count = 0 OR detected THEN NULL WHEN parsed_count = 0 THEN 'javascript_analysis_unavailable' WHEN NOT complete THEN 'javascript_analysis_incomplete' END AS e
  FROM (SELECT b.page_id AS target_id, {first} + v.n AS position, 'L3-J-0' || v.n AS signal_id, CASE WHEN j.page_id IS NULL THEN false ELSE j.detected END AS detected, coalesce(c.n, 0) AS script_count, coalesce(c.m, 0) AS parsed_count, source_complete AND coalesce(c.n = c.m, true) AS complete
    FROM b CROSS JOIN (SELECT unnest(range(1, 10)) AS n) v LEFT JOIN ({" UNION ALL ".join(rows)}) j ON j.page_id = b.page_id AND j.signal_id = 'L3-J-0' || v.n
    LEFT JOIN (SELECT page_id, count(*) FILTER (x NOT LIKE '%application/json%') AS n, count(*) FILTER (x NOT LIKE '%application/json%' AND source IS NOT NULL) AS m FROM sc GROUP BY 1) c ON c.page_id = b.page_id))"""


SIGNALS_SQL = " UNION ALL ".join(
    [_collected_sql(k + 1, s, n) for k, (s, n) in enumerate(zip(G.HEADER + G.CERTIFICATE, HEADER_SQL + CERT_SQL))] + [f"SELECT * FROM ({_html_sql()})", f"SELECT * FROM ({_script_sql()})"])


@query("page_signals", W(SIGNALS_SQL, Q.PP, Q.B, Q.SCRIPTS, f"h5 AS ({ORACLES['brand_domain_mismatch']})", f"h6 AS ({ORACLES['brand_resource_mismatch']})"))
def _(t):
    pp, index = t.pages_plus, R.suffix_index(t.suffix_rules)
    tags = materialise(P.page_tags(pp), "tags")  # the one reading of page text
    forms = P.page_forms(P.form_tokens(tags))
    controls = P.form_controls(P.form_tokens(tags), forms)
    fields = materialise(P.credential_classify(P.page_inputs(controls)), "fields")
    bases = P.page_base(pp)
    known = lambda df: df.withColumn("detected", F.coalesce("detected", F.lit(False)))  # noqa: E731  only a cut page leaves these unknown
    posts = P.external_post(pp.withColumn("source_complete", F.lit(True)), forms, P.page_buttons(controls, forms), index).where("posts > 0")
    at_ = at()
    # What several checks read is worked out once: journeys, hops and their split URLs, certificates, script events.
    journeys, hops, responses, certs, sans = materialise(t.journeys, "journeys"), materialise(t.hops, "hops"), t.responses, materialise(t.certs, "certs"), t.cert_san
    urls = materialise(T.journey_urls(journeys, hops, index), "journey-urls")
    some = t.sql(SOME_SANS, "certs cert_san")
    header = [T.redirect_chain(journeys, hops), T.redirect_domain_change(journeys, urls, index), T.redirect_to_ip(journeys, urls), T.shortener_journey(journeys, urls, index, R.shorteners(t.spark)),
              T.content_type_mismatch(responses), T.dangerous_download(responses), T.forced_download(responses), T.http_refresh(responses), T.protocol_downgrade(journeys, hops)]
    cert = [T.cert_age_days(certs, at_), T.cert_validity(certs, at_), T.cert_hostname_match(certs, some), T.self_signed(certs), T.cert_chain(certs), T.ct_first_seen(certs, t.scts, t.ct_logs, at_), T.tls_legacy(certs), T.wildcard_cert(certs, sans)]
    brand, current = materialise(identified(t), "brands"), t.sql(CURRENT)
    html = [known(P.credential_form(pp, fields)), known(P.credential_field(pp, fields)), forms.select("page_id").distinct().withColumn("detected", F.lit(None)), posts,
            B.brand_domain_mismatch(brand, current, t.sql(OWN)), B.brand_resource_mismatch(t.sql(RES), brand, current, t.sql(OWN), t.spark.sql("SELECT 'shared.net' AS domain"), t.sql(POL)),
            known(P.html_redirect(pp, P.meta_refresh(tags))), P.base_url_change(pp.withColumn("source_complete", F.lit(True)), bases, index)]
    events, owners = materialise(t.js_events, "events"), pp.select("page_id")
    script = [(None, S.script_signal_counts(owners, events)), (None, S.credential_access_exfil(owners, events)), ("L3-J-02", S.decode_exec_chain(owners, events)), ("L3-J-09", S.env_branching(owners, t.sql(Q.ARMS)))]
    findings = [G.finding(df, s, "journey_id" if "journey_id" in df.columns else "page_id") for s, df in zip(G.HEADER, header)]
    findings += [G.finding(df, s, "cert_id", "NULL" if s in G.MEASURED else "detected", "age_days" if s in G.MEASURED else None) for s, df in zip(G.CERTIFICATE, cert)]
    findings += [G.finding(df, s) for s, df in zip(G.HTML, html)] + [G.finding(df, s) for s, df in script]
    return G.page_signals(pp, findings, S.script_status(S.page_scripts(tags)))


@query("decode_html_udf", "SELECT page_id, html AS text FROM pages")
def _(t):
    return t.pages.select("page_id", decode_html_udf(F.encode("html", "UTF-8"), F.lit("utf-8")).alias("text"))


@query("idn_decode_udf", "SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'pаypal' ELSE url END AS label FROM pages")
def _(t):
    return t.pages.select("page_id", idn_decode_udf(F.when(F.col("page_id") % 2 == 0, "xn--pypal-4ve").otherwise(F.col("url"))).alias("label"))
