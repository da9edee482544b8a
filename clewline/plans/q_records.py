"""Record, cause, view and verdict-side queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as K, view as V
from .registry import query, with_fixtures as W

RS = "record_signals"
STATE = """CASE WHEN detected THEN 'observed' WHEN NOT detected THEN 'not_observed_in_analyzed_scope' WHEN status = 'not_applicable' THEN 'not_applicable' ELSE 'unresolved' END"""
ERRS = "SELECT request_id, layer, error_code AS code, concat('/signals/', CAST(signal_no AS STRING)) AS hint, CASE WHEN error_code = 'html_source_truncated' THEN 'analysis' ELSE 'acquisition' END AS impact_scope FROM record_signals WHERE error_code IS NOT NULL"
CODES = """SELECT event_id AS error_id, concat(CASE user_id % 19 WHEN 0 THEN 'brand_identifier_not_configured' WHEN 1 THEN 'brand_not_identified' WHEN 2 THEN 'brand_domain_reference_empty' WHEN 3 THEN 'brand_resource_evaluator_abstained'
  WHEN 4 THEN 'analysis_unresolved_reason_not_recorded' WHEN 5 THEN 'brand_identifier_invalid_result' WHEN 6 THEN 'policy_unresolved' WHEN 7 THEN 'tls_target_policy_blocked' WHEN 8 THEN 'tls_timeout' WHEN 9 THEN 'certificate_parse_failed'
  WHEN 10 THEN 'unknown_encoding' WHEN 11 THEN 'html_source_truncated' WHEN 12 THEN 'callback_target' WHEN 13 THEN 'script_source_unavailable' WHEN 14 THEN 'unsupported_content_type' WHEN 15 THEN 'tls_not_attempted' WHEN 16 THEN 'historical_reuse' WHEN 17 THEN 'event_order' ELSE 'odd' END, '') AS code FROM events"""
KINDS = ["capability_not_configured", "identification_unresolved", "reference_coverage_gap", "evaluation_abstained", "reason_not_recorded", "invalid_policy_result_or_configuration", "policy_unconfigured",
         "collection_blocked", "collection_timeout", "parse_unsupported_or_invalid", "decoding_incomplete", "partial_observation", "relationship_unresolved", "source_unavailable", "content_outside_analyzer_scope",
         "not_attempted", "historical_observation_limit", "relationship_unresolved", "tool_or_collection_error"]


@query("cause_kind", f"SELECT error_id, code, CASE user_id % 19 {' '.join(f'WHEN {i} THEN {chr(39)}{k}{chr(39)}' for i, k in enumerate(KINDS))} END AS kind FROM ({CODES}) JOIN events ON event_id = error_id")
def _(t):
    return K.cause_kind(t.sql(CODES))


@query("signal_state", W(f"SELECT request_id, signal_no, {STATE} AS state FROM record_signals", RS))
def _(t):
    return K.signal_state(t.record_signals).select("request_id", "signal_no", "state")


@query("signal_contract", W("SELECT request_id, signal_no, layer, status, detected FROM record_signals WHERE status <> 'evaluated' AND detected IS NOT NULL", RS))
def _(t):
    return K.signal_contract(t.record_signals).select("request_id", "signal_no", "layer", "status", "detected")


@query("result_counts", W(f"SELECT request_id, layer, {', '.join(f'count(*) FILTER (st = {chr(39)}{n}{chr(39)}) AS {n}' for n in K.SIGNAL_STATES)} FROM (SELECT *, {STATE} AS st FROM record_signals) GROUP BY 1, 2", RS))
def _(t):
    return K.result_counts(t.record_signals)


LOOKUPS = """SELECT request_id, layer, concat('n', CAST(signal_no AS STRING)) AS name, CASE WHEN error_code = 'target_policy_blocked' THEN 'not_queried' WHEN error_code = 'tls_timeout' THEN 'timeout' WHEN status = 'error' THEN NULL ELSE 'received' END AS status,
  CASE WHEN error_code = 'html_source_truncated' THEN 1 ELSE 0 END AS dropped FROM record_signals"""
OBS = "CASE WHEN status = 'not_queried' THEN 'not_attempted' WHEN status = 'timeout' THEN 'unavailable' WHEN dropped > 0 THEN 'partial' WHEN status IS NOT NULL THEN 'observed' ELSE 'unrecorded' END"


@query("observation_state", W(f"SELECT request_id, name, {OBS} AS state FROM ({LOOKUPS})", RS))
def _(t):
    return K.observation_state(t.sql(LOOKUPS, RS)).select("request_id", "name", "state")


@query("acquisition_state", W(f"""
SELECT request_id, layer, CASE WHEN u AND g THEN 'partial' WHEN u THEN 'observed' WHEN na THEN 'not_attempted' WHEN f OR c > 0 THEN 'unavailable' ELSE 'unrecorded' END AS state FROM (
  SELECT request_id, layer, bool_or(s IN ('observed', 'partial')) AS u, bool_or(s <> 'observed') AS g, bool_and(s = 'not_attempted') AS na, bool_or(s = 'unavailable') AS f FROM (SELECT *, {OBS} AS s FROM ({LOOKUPS})) GROUP BY 1, 2)
FULL JOIN (SELECT request_id, layer, count(*) AS c FROM ({ERRS}) GROUP BY 1, 2) USING (request_id, layer)""", RS))
def _(t):
    return K.acquisition_state(t.sql(LOOKUPS, RS), t.sql(ERRS, RS))


@query("analysis_state", W(f"""
SELECT request_id, layer, CASE WHEN u AND (o OR c > 0) THEN 'partial' WHEN o OR c > 0 THEN 'unavailable' ELSE 'completed' END AS state FROM (
  SELECT request_id, layer, bool_or(s LIKE '%observed%') AS u, bool_or(s = 'unresolved') AS o FROM (SELECT *, {STATE} AS s FROM record_signals) GROUP BY 1, 2)
FULL JOIN (SELECT request_id, layer, count(*) AS c FROM ({ERRS}) WHERE impact_scope = 'analysis' GROUP BY 1, 2) USING (request_id, layer)""", RS))
def _(t):
    return K.analysis_state(t.record_signals, t.sql(ERRS, RS))


RECORDS = """SELECT request_id, layer, CASE max(signal_no) % 5 WHEN 0 THEN 'blocked' ELSE NULL END AS preflight, CASE max(signal_no) % 7 WHEN 3 THEN 'budget_exceeded' ELSE NULL END AS stop_reason,
  CASE min(signal_no) % 4 WHEN 2 THEN NULL ELSE 'done' END AS producer_status FROM record_signals GROUP BY request_id, layer"""
FAILS = "SELECT request_id, layer, CASE WHEN error_code = 'tls_timeout' THEN 'layer_execution_failed' ELSE error_code END AS code FROM record_signals WHERE error_code IS NOT NULL"


@query("execution_state", W(f"""
SELECT request_id, layer, CASE WHEN preflight IS NOT NULL THEN 'not_performed' WHEN stop_reason IS NOT NULL THEN 'interrupted'
  WHEN (request_id, layer) IN (SELECT request_id, layer FROM record_signals WHERE error_code = 'tls_timeout') THEN 'failed' WHEN producer_status IS NULL THEN 'unrecorded' ELSE 'completed' END AS state FROM ({RECORDS})""", RS))
def _(t):
    return K.execution_state(t.sql(RECORDS, RS), t.sql(FAILS, RS))


K3 = "CASE code WHEN 'tls_timeout' THEN 'collection_timeout' WHEN 'html_source_truncated' THEN 'partial_observation' ELSE 'collection_blocked' END"


@query("cause_dedupe", W(f"""
SELECT DISTINCT request_id, layer || ':cause:' || left(sha256('{{"code":"' || code || '","layer":"' || layer || '","request_id":' || request_id || '}}'), 16) AS cause_id, code, {K3} AS kind, hint FROM ({ERRS})""", RS))
def _(t):
    return K.cause_dedupe(t.sql(ERRS, RS))


@query("cause_types", W(f"""
SELECT layer, code, kind, n, requests, left(sha256('{{"code":"' || code || '","kind":"' || kind || '","layer":"' || layer || '"}}'), 16) AS type_id
FROM (SELECT layer, code, {K3} AS kind, count(*) AS n, count(DISTINCT request_id) AS requests FROM ({ERRS}) GROUP BY 1, 2, 3)""", RS))
def _(t):
    return K.cause_types(t.sql(ERRS, RS))


ATTEMPTS = "SELECT l_orderkey AS request_id, concat('L', CAST(l_linenumber % 4 AS STRING)) AS layer, CASE WHEN l_linenumber > 6 THEN 2 ELSE 1 END AS attempt, concat('u', CAST(l_suppkey % 2 AS STRING)) AS requested_url FROM lineitem"


@query("attempt_consistency", f"""
WITH a AS ({ATTEMPTS}), g AS (SELECT request_id, count(DISTINCT attempt) AS att, count(DISTINCT requested_url) AS u, count(*) AS n, count(DISTINCT layer) AS l, list(DISTINCT layer) AS ls FROM a GROUP BY 1)
SELECT request_id, 'mixed_attempt' AS problem FROM g WHERE att > 1 UNION ALL SELECT request_id, 'several_requested_urls' FROM g WHERE u > 1
UNION ALL SELECT request_id, 'duplicate_layer' FROM g WHERE n > l UNION ALL SELECT request_id, 'missing_layer_' || x FROM g, (SELECT unnest(['L0', 'L1', 'L2', 'L3']) AS x) WHERE NOT list_contains(ls, x)""")
def _(t):
    return K.attempt_consistency(t.sql(ATTEMPTS), ("L0", "L1", "L2", "L3"))


@query("dangling_refs", "SELECT l_orderkey, l_linenumber, l_partkey AS item FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(t):
    refs = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("item"))
    return K.dangling_refs(refs, t.part.where("p_size > 10").select(F.col("p_partkey").alias("item")), ["item"])


RAWS = "SELECT doc_id AS raw_key, text AS raw_text FROM documents WHERE n_chars > 200"


@query("record_raw_integrity", f"""
SELECT coalesce(a.raw_key, b.doc_id) AS raw_key, CASE WHEN a.raw_key IS NULL THEN 'record_without_raw' WHEN b.doc_id IS NULL THEN 'raw_without_record' ELSE 'hash_mismatch' END AS problem
FROM ({RAWS}) a FULL JOIN (SELECT doc_id, quality, sha256(text) AS h FROM documents JOIN labels USING (doc_id)) b ON b.doc_id = a.raw_key
WHERE a.raw_key IS NULL OR b.doc_id IS NULL OR quality = 0""")
def _(t):
    rec = t.documents.join(t.labels, "doc_id").select(F.col("doc_id").alias("raw_key"), F.when(F.col("quality") == 0, "stale").otherwise(F.sha2("text", 256)).alias("stored_sha256"))
    return K.record_raw_integrity(rec, t.sql(RAWS))


@query("event_source_links", """
SELECT event_id, CASE WHEN n = 0 THEN 'no_source_recorded' WHEN lost = 0 THEN 'recorded_source_links' WHEN lost = n THEN 'source_links_unresolved' ELSE 'source_links_partly_resolved' END AS relationship, lost AS unresolved_n FROM (
  SELECT o.o_orderkey AS event_id, count(l_partkey) AS n, count(l_partkey) FILTER (p_partkey IS NULL) AS lost FROM orders o LEFT JOIN lineitem l ON l_orderkey = o_orderkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 20) ON p_partkey = l_partkey GROUP BY 1)""")
def _(t):
    return K.event_source_links(t.orders.select(F.col("o_orderkey").alias("event_id")), t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("source_id")),
                                t.part.where("p_size > 20").select(F.col("p_partkey").alias("source_id")))


SIG_FIELDS = "SELECT l_orderkey * 100 + l_linenumber AS signal_id, l_suppkey AS entity_id, 'nation' AS field, CAST(l_linenumber + 3 AS STRING) AS value FROM lineitem"
ENT_FIELDS = "SELECT s_suppkey AS entity_id, 'nation' AS field, CAST(s_nationkey AS STRING) AS value FROM supplier"


@query("redundant_evidence", f"SELECT signal_id, s.field, s.entity_id FROM ({SIG_FIELDS}) s JOIN ({ENT_FIELDS}) e ON s.entity_id = e.entity_id AND s.value = e.value")
def _(t):
    return K.redundant_evidence(t.sql(SIG_FIELDS), t.sql(ENT_FIELDS))


POINTERS = "SELECT event_id AS evidence_id, concat(CASE event_type WHEN 'view' THEN '/l1_raw/dns' WHEN 'click' THEN '/l2_http_source' WHEN 'signup' THEN '/l2_http_source/hops' WHEN 'error' THEN '/odd' ELSE '/l2_tls_source' END, '/x', CAST(user_id AS STRING)) AS pointer FROM events"
PREFIXES = [("/l1_raw", "l1", "raw", ""), ("/l2_http_source", "l2", "raw", "/http"), ("/l2_http_source/hops", "l2", "raw", "/http/redirect_chain"), ("/l2_tls_source", "l2", "raw", "/tls")]


@query("source_location", f"""
SELECT evidence_id, layer, source, root || substr(pointer, length(prefix) + 1) AS artifact_pointer FROM (
  SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY length(prefix) DESC) AS rn FROM ({POINTERS}) JOIN (VALUES {', '.join(map(str, PREFIXES))}) p(prefix, layer, source, root) ON pointer = prefix OR starts_with(pointer, prefix || '/')) WHERE rn = 1""")
def _(t):
    from ..refdata import table
    return K.source_location(t.sql(POINTERS), table(t.spark, PREFIXES, "prefix layer source root"))


ARTS = "SELECT l_orderkey AS job_id, concat('a', CAST(l_linenumber AS STRING)) AS artifact, CAST(floor(l_quantity) AS BIGINT) % 3 AS attempt, l_linestatus AS verdict FROM lineitem"
AJOBS = "SELECT o_orderkey AS job_id, o_custkey % 3 AS attempt, o_orderstatus AS verdict FROM orders"


@query("artifact_consistency", f"""
WITH j AS (SELECT a.job_id, artifact, b.attempt AS ea, a.attempt AS fa, b.verdict AS ev, a.verdict AS fv FROM ({ARTS}) a JOIN ({AJOBS}) b USING (job_id))
SELECT job_id, artifact, 'attempt' AS field, ea::VARCHAR AS expected, fa::VARCHAR AS found FROM j WHERE ea <> fa UNION ALL SELECT job_id, artifact, 'verdict', ev, fv FROM j WHERE ev <> fv""")
def _(t):
    return K.artifact_consistency(t.sql(AJOBS), t.sql(ARTS), ["attempt", "verdict"])


@query("public_revision")
def _(t):
    return K.public_revision(t.derived("jobs"), ["job_id", "ledger_status", "final_verdict"])


@query("shared_columns", """
WITH g AS (SELECT s_nationkey, count(DISTINCT s_name) AS a, min(s_name) AS av, count(DISTINCT s_suppkey % 5) AS b, min((s_suppkey % 5)::VARCHAR) AS bv, min(n_regionkey)::VARCHAR AS cv FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)
SELECT s_nationkey, 'name' AS column_name, a = 1 AS shared, CASE WHEN a = 1 THEN av END AS constant FROM g UNION ALL SELECT s_nationkey, 'slot', b = 1, CASE WHEN b = 1 THEN bv END FROM g UNION ALL SELECT s_nationkey, 'region', true, cv FROM g""")
def _(t):
    r = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_nationkey", F.col("s_name").alias("name"), (F.col("s_suppkey") % 5).alias("slot"), F.col("n_regionkey").alias("region"))
    return V.shared_columns(r, "s_nationkey", ["name", "slot", "region"])


HOSTED = "SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, url FROM pages"


@query("common_prefix", f"""
SELECT host, left(lo, k) AS prefix, n FROM (SELECT *, (SELECT max(i) FROM range(0, 400) r(i) WHERE i <= least(length(lo), length(hi)) AND left(lo, i) = left(hi, i)) AS k FROM (SELECT host, min(url) AS lo, max(url) AS hi, count(*) AS n FROM ({HOSTED}) GROUP BY 1)) WHERE k >= 20""")
def _(t):
    return V.common_prefix(t.sql(HOSTED), "host")


@query("repeated_literals", "SELECT text AS literal, count(*) AS n, (count(*) - 1) * strlen(text) - count(*) * 8 AS saved FROM documents WHERE length(text) >= 24 GROUP BY text HAVING count(*) >= 2 AND (count(*) - 1) * strlen(text) > count(*) * 8")
def _(t):
    return V.repeated_literals(t.documents)


@query("url_prefix_dictionary", """
WITH x AS (SELECT url, left(url, i) AS prefix FROM pages, range(24, 300) r(i) WHERE i <= length(url) AND substr(url, i, 1) = '/'), k AS (SELECT prefix FROM x GROUP BY 1 HAVING count(*) >= 4)
SELECT url, arg_max(prefix, length(prefix)) AS prefix FROM (SELECT DISTINCT url, prefix FROM x WHERE prefix IN (SELECT prefix FROM k)) GROUP BY url""")
def _(t):
    return V.url_prefix_dictionary(t.pages)


VIEWS = {"source": "SELECT lang AS view, doc_id AS item_id FROM documents", "kept": "SELECT lang AS view, doc_id AS item_id FROM documents WHERE n_chars > 500",
         "omitted": "SELECT d.lang AS view, d.doc_id AS item_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 0"}


@query("source_accounting", f"""
SELECT view, count(*) FILTER (s) AS source_rows, count(*) FILTER (k) AS kept_rows, count(*) FILTER (o) AS omitted_rows, count(*) FILTER (k = o) AS bad_items, count(*) FILTER (k = o) = 0 AS ok
FROM (SELECT view, true AS s, item_id IN (SELECT item_id FROM ({VIEWS['kept']})) AS k, item_id IN (SELECT item_id FROM ({VIEWS['omitted']})) AS o FROM ({VIEWS['source']})) GROUP BY 1""")
def _(t):
    return V.source_accounting(*[t.sql(VIEWS[k]) for k in ("source", "kept", "omitted")])


@query("kept_omitted_disjoint", f"""
SELECT item_id, CASE WHEN k THEN 'kept_and_omitted' ELSE 'not_placed' END AS problem FROM (SELECT item_id, item_id IN (SELECT item_id FROM ({VIEWS['kept']})) AS k, item_id IN (SELECT item_id FROM ({VIEWS['omitted']})) AS o FROM ({VIEWS['source']})) WHERE k = o""")
def _(t):
    return V.kept_omitted_disjoint(*[t.sql(VIEWS[k]) for k in ("source", "kept", "omitted")])


@query("evidence_selection", W("""
SELECT request_id, signal_no, CASE WHEN status = 'not_applicable' THEN 'not_applicable' WHEN status = 'evaluated' AND detected IS NULL THEN 'routine_empty_answer' END AS omit_reason,
  NOT (status = 'not_applicable' OR (status = 'evaluated' AND detected IS NULL)) AS kept FROM record_signals""", RS))
def _(t):
    rules = [(F.col("status") == "not_applicable", "not_applicable"), ((F.col("status") == "evaluated") & F.col("detected").isNull(), "routine_empty_answer")]
    return V.evidence_selection(t.record_signals, rules).select("request_id", "signal_no", "omit_reason", "kept")


@query("context_budget", """SELECT lang, sum(strlen('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}'))::BIGINT AS bytes, sum(strlen('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}')) > 9000 AS over FROM documents GROUP BY 1""")
def _(t):
    return V.context_budget(t.documents, "lang", ["doc_id", "n_chars"], 9000)


ALIAS_ROWS = "SELECT l_orderkey AS doc, CASE WHEN l_returnflag = 'R' THEN 'fact' ELSE 'source' END AS kind, CAST(l_partkey AS BIGINT) * 100000 + l_suppkey AS item_id FROM lineitem GROUP BY 1, 2, 3"
RESERVED = "SELECT DISTINCT l_orderkey AS doc, 'fact' AS kind, l_linenumber AS number FROM lineitem"


@query("citation_alias", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc, kind ORDER BY item_id) AS rank FROM ({ALIAS_ROWS})),
n AS (SELECT doc, kind, i, row_number() OVER (PARTITION BY doc, kind ORDER BY i) AS rank FROM (SELECT DISTINCT doc, kind FROM r), range(1, 60) x(i) WHERE (doc, kind, i) NOT IN (SELECT doc, kind, number FROM ({RESERVED})))
SELECT doc, item_id, kind || ':' || i AS alias FROM r JOIN n USING (doc, kind, rank)""")
def _(t):
    return V.citation_alias(t.sql(ALIAS_ROWS), t.sql(RESERVED), "doc")


INPUTS = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'x' END AS placeholder, CASE page_id % 4 WHEN 0 THEN NULL ELSE url END AS label FROM pages"


@query("absence_kinds", f"""
SELECT page_id, 'placeholder' AS field, CASE WHEN placeholder IS NULL THEN 'absent_attribute' ELSE 'observed_empty' END AS absence FROM ({INPUTS}) WHERE coalesce(placeholder, '') = ''
UNION ALL SELECT page_id, 'label', 'not_recorded' FROM ({INPUTS}) WHERE label IS NULL""")
def _(t):
    return V.absence_kinds(t.sql(INPUTS), "page_id", {"placeholder": "absent_attribute", "label": "not_recorded"})


# A pointer for each row: a name, a name of digits, a place, a place with a leading zero, a bad escape, one without its slash, the whole.
POINTED = """SELECT event_id, concat('{"7":{"a":null},"l":["', event_type, '"],"p":', props, '}') AS body,
  CASE event_id % 8 WHEN 0 THEN '/p/k' WHEN 1 THEN '/7/a' WHEN 2 THEN '/l/0' WHEN 3 THEN '/l/00' WHEN 4 THEN '/p/~2' WHEN 5 THEN 'p' WHEN 6 THEN '/l/1' ELSE '/7/b' END AS pointer FROM events"""


@query("json_pointer", f"""SELECT event_id, CASE WHEN event_id % 8 IN (4, 5) THEN NULL ELSE event_id % 8 IN (0, 1, 2) END AS exists, CASE event_id % 8 WHEN 0 THEN json_extract_string(body, '$.p.k') WHEN 2 THEN json_extract_string(body, '$.l[0]') END AS value,
  CASE WHEN event_id % 8 IN (4, 5) THEN 'invalid_pointer' END AS problem FROM ({POINTED})""")
def _(t):
    return V.json_pointer(t.sql(POINTED), F.col("pointer")).select("event_id", "exists", "value", "problem")


@query("text_excerpt", r"SELECT doc_id, CASE WHEN length(text) > 16000 THEN left(text, 12000) || chr(10) || '...' || chr(10) || right(text, 4000) ELSE text END AS excerpt, CASE WHEN length(text) > 16000 THEN length(text) - 16000 ELSE 0 END AS omitted FROM documents")
def _(t):
    return V.text_excerpt(t.documents.select("doc_id", "text")).select("doc_id", "excerpt", "omitted")


IMGS = "SELECT page_id, concat('data:image/', CASE WHEN page_id % 2 = 0 THEN 'png' ELSE 'gif' END, ';base64,', repeat('QUJD', CAST(page_id AS INT) % 150)) AS value FROM pages"


@query("embedded_image_refs", f"SELECT page_id, regexp_extract(value, '^data:([^;,]+)', 1) AS media_type, length(value) AS chars, sha256(value) AS sha256 FROM ({IMGS}) WHERE length(value) > 300")
def _(t):
    return V.embedded_image_refs(t.sql(IMGS)).select("page_id", "media_type", "chars", "sha256")


@query("feed_overlap", W("SELECT a.source AS source_a, b.source AS source_b, count(*) AS urls FROM (SELECT DISTINCT url, source FROM sightings) a JOIN (SELECT DISTINCT url, source FROM sightings) b ON a.url = b.url AND a.source < b.source GROUP BY 1, 2", "sightings"))
def _(t):
    return V.feed_overlap(t.sightings)
