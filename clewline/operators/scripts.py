"""Script inventory, corpus screening and script-signal roll-ups.

Scripts are screened as a lexer reads them, without comments and literals. Values are not followed
through the code; relations between events come in as a link table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from ..functions import lexer as L, url as U
from ..functions.joins import left_lookup
from ..functions.logic import any3, first_true, joined
from ..refdata import SCRIPT_APIS
from .domains import url_relations
from .pages import _REST, attr, has, prepared, with_attributes

# Media types that run as scripts or hold JSON, limits, and signal names by event kind.
SCRIPT_TYPES = ("", "application/ecmascript", "application/javascript", "module", "text/ecmascript", "text/javascript")
JSON_TYPES = ("application/json", "application/ld+json")
MAX_SCRIPT_BYTES, MAX_SCRIPTS, MAX_EVENTS = 1_000_000, 20, 10_000
KIND_ORDER = ("dynamic_execution", "decode", "injection", "network", "dom_access", "credential_read", "redirect", "environment", "branch", "trace")
SIGNAL_OF_KIND = {"dynamic_execution": "L3-J-01", "injection": "L3-J-03", "network": "L3-J-04", "redirect": "L3-J-07", "environment": "L3-J-08"}
# Key roles in static data, media words, and words of a concrete control.
TEXT_KEYS = ("buttontext", "caption", "content", "description", "headline", "label", "message", "text", "title")
ADDRESS_KEYS = ("action", "actionurl", "contenturl", "href", "image", "link", "src", "targeturl", "url")
MEDIA_WORDS = ("audio", "image", "video")
CONTROL_TYPES = ("action", "button", "cta", "form", "input", "submit")
CONTROL_KEYS = ("action", "actionurl", "buttontext", "targeturl", "text")
CONTENT_TYPES = ("audio", "heading", "image", "paragraph", "text", "title", "video")


def page_scripts(pages: DataFrame) -> DataFrame:
    """Inline and external scripts in page order, from pages or from a table of their tags."""
    if "tag_text" in pages.columns:
        order = Window.partitionBy("page_id").orderBy("pos")
        s = pages.where("tag = 'script'").select("page_id", "url", "effective_base", (F.row_number().over(order) - 1).alias("pos"), "tag_text", "body")
        return _scripts(s)
    found = F.regexp_extract_all("html", F.lit(r"(?is)<!--.*?(?:-->|\z)|<script\b" + _REST + r".*?(?:</script\s*>|\z)"), F.lit(0))
    only = F.filter(found, lambda x: F.lower(F.substring(x, 1, 7)) == "<script")
    s = prepared(pages).select("page_id", "url", "effective_base", F.posexplode(only).alias("pos", "x"))
    s = s.withColumns({"tag_text": F.regexp_extract("x", r"(?is)^(<script\b" + _REST + ")", 1), "body": F.regexp_extract("x", r"(?is)^<script\b" + _REST + r"(.*?)(?:</script\s*>)?\z", 1)}).drop("x")
    return _scripts(s)


def _scripts(tags: DataFrame) -> DataFrame:
    s = with_attributes(tags)
    t = F.col("attrs")
    s = s.withColumns({"raw_src": attr(t, "src"), "media_type": attr(t, "type"), "is_async": has(t, "async"), "is_defer": has(t, "defer")})
    s = U.with_resolved(s, "raw_src", "effective_base", "source_url")
    inline = F.col("raw_src").isNull()
    return s.select("page_id", "url", "effective_base", F.concat(F.lit("script-"), (F.col("pos") + 1).cast("string")).alias("script_id"), "pos",
                    F.when(inline, "inline").otherwise("external").alias("type"), "source_url", F.when(inline, F.col("body")).alias("source"),
                    F.when(inline, F.sha2("body", 256)).alias("sha256"), F.when(inline, F.octet_length("body")).alias("size"), "media_type", "is_async", "is_defer")


def script_status(scripts: DataFrame, max_bytes: int = MAX_SCRIPT_BYTES) -> DataFrame:
    m = F.lower(F.trim(F.split_part(F.coalesce("media_type", F.lit("")), F.lit(";"), F.lit(1))))
    return scripts.select("page_id", "script_id", first_true([
        (~m.isin(*SCRIPT_TYPES), "data_block"), (F.col("source").isNull(), "missing_source"), (F.col("size") > max_bytes, "source_limit_exceeded")], "parsed").alias("status"))


def script_reuse(scripts: DataFrame) -> DataFrame:
    """Same source across pages and hosts."""
    s = scripts.where("sha256 IS NOT NULL").withColumn("host", U.raw_host(F.col("url")))
    return s.groupBy("sha256").agg(F.count_distinct("page_id").alias("pages"), F.count_distinct("host").alias("hosts"))


def _pattern(kind: str, api: str) -> str:
    name = api.replace(".", r"\s*\.\s*")
    if api == "XMLHttpRequest.open":
        return r"\.\s*open\s*\("
    if api in ("location.href", "window.location"):
        return rf"(?<![\w$]){name}\s*=(?!=)"
    tail = r"\b" if kind == "environment" else r"\s*\("
    head = r"(?<![\w$])" if "." in api else r"(?<![\w$.])"
    return head + name + tail


def script_api_screen(scripts: DataFrame) -> DataFrame:
    """Configured APIs that occur in each script, with count and first offset in the text without comments and literals."""
    s = scripts.where("source IS NOT NULL").select("page_id", "script_id", L.lexed(F.col("source")).alias("lex"))
    s = U.settle(s.select("page_id", "script_id", L.blanked(F.col("lex.code")).alias("code")), "code")
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(a).alias("api"), F.regexp_count("code", F.lit(_pattern(k, a))).alias("n"), F.regexp_instr("code", F.lit(_pattern(k, a))).alias("first_offset"))
            for k, apis in SCRIPT_APIS.items() for a in apis]
    return s.select("page_id", "script_id", F.explode(F.array(*rows)).alias("e")).select("page_id", "script_id", "e.*").where("n > 0")


def script_literal_destinations(scripts: DataFrame, rules: DataFrame) -> DataFrame:
    """Literal addresses given to network and redirect calls, resolved, with an external flag. Comments and literals hold no calls."""
    q = r"""\s*"([0-9]+)\""""
    kinds = {"network": rf"(?:\bfetch|navigator\.sendBeacon)\s*\({q}", "network_open": rf"""\.open\s*\(\s*"[0-9]+"\s*,{q}""",
             "redirect": rf"\blocation\.(?:replace|assign)\s*\({q}", "redirect_set": rf"\blocation(?:\.href)?\s*=(?!=){q}"}

    def found(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all("lex.code", F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), F.get("lex.texts", n.cast("int")).alias("raw")))

    s = scripts.where("source IS NOT NULL").select("page_id", "url", "effective_base", "script_id", L.lexed(F.col("source")).alias("lex"))
    arr = F.concat(*[found(k.split("_")[0], p) for k, p in kinds.items()])
    e = U.settle(s, "lex").select("page_id", "url", "effective_base", "script_id", F.explode(arr).alias("e")).select("page_id", "url", "effective_base", "script_id", "e.*")
    e = U.with_resolved(e.where("raw <> ''"), "raw", "effective_base", "destination")
    r = url_relations(e, rules, "url", "destination")
    return r.select("page_id", "script_id", "kind", "destination", (~F.col("same_site_scope")).alias("external"))


def script_fetch_plan(scripts: DataFrame, n: int = MAX_SCRIPTS) -> DataFrame:
    """External scripts once per page and address (fragment ignored); the first n are fetched."""
    e = scripts.where("type = 'external'").withColumn("u", F.regexp_replace("source_url", "#.*$", ""))
    first = e.where("u IS NOT NULL").groupBy("page_id", "u").agg(F.min("pos").alias("first_pos"))
    w = Window.partitionBy("page_id").orderBy("first_pos")
    ranked = first.withColumn("rank", F.row_number().over(w))
    j = e.join(ranked, ["page_id", "u"], "left")
    return j.select("page_id", "script_id", first_true([
        (F.col("u").isNull(), "unresolved"), (F.col("rank") > n, "over_limit"), (F.col("pos") > F.col("first_pos"), "shared")], "fetch").alias("action"))


def script_text_budget(scripts: DataFrame, per: int = 4000, total: int = 16000) -> DataFrame:
    """Characters of each script that fit its own and the page's budget, in source order."""
    want = F.least(F.length("source"), F.lit(per))
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = scripts.where("source IS NOT NULL").withColumn("before", F.coalesce(F.sum(want).over(w), F.lit(0)))
    inc = F.greatest(F.lit(0), F.least(want, F.lit(total) - F.col("before")))
    return s.select("page_id", "script_id", inc.alias("included"), (F.length("source") - inc).alias("omitted"))


def event_limit(events: DataFrame, n: int = MAX_EVENTS) -> DataFrame:
    """One cap over all kinds in fixed kind order; links to dropped sources are marked."""
    order = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    w = Window.partitionBy("page_id").orderBy(order, "pos")
    e = events.withColumn("kept", F.row_number().over(w) <= n)
    src = e.select(F.col("event_id").alias("_s"), F.col("kept").alias("source_kept"))
    return left_lookup(e.select("event_id", "source_id", "kept"), src, "source_id", "_s").select("event_id", "kept", F.when(F.col("kept"), F.coalesce(~F.col("source_kept"), F.lit(False))).alias("source_dropped"))


def script_signal_counts(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Per page and script signal: found or not, how often, which APIs, external destinations."""
    kinds = F.create_map(*[x for k, s in SIGNAL_OF_KIND.items() for x in (F.lit(k), F.lit(s))])
    e = events.withColumn("signal_id", kinds[F.col("kind")]).where("signal_id IS NOT NULL")
    g = e.groupBy("page_id", "signal_id").agg(F.count("*").alias("n"), joined(F.collect_set("api")).alias("apis"), F.count_if("external").alias("external_n"))
    every = pages.select("page_id", F.explode(F.array(*[F.lit(s) for s in SIGNAL_OF_KIND.values()])).alias("signal_id"))
    j = every.join(g, ["page_id", "signal_id"], "left")
    return j.select("page_id", "signal_id", F.col("n").isNotNull().alias("detected"), F.coalesce("n", F.lit(0)).alias("n"), "apis", F.coalesce("external_n", F.lit(0)).alias("external_n"))


def _with_source(events: DataFrame) -> DataFrame:
    src = events.select(F.col("event_id").alias("_s"), F.col("kind").alias("source_kind"), F.col("api").alias("source_api"))
    return left_lookup(events, src, "source_id", "_s").drop("_s")


def decode_exec_chain(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Execution fed by a decode call; a decode call alone is not positive."""
    e = _with_source(events.where("kind IN ('dynamic_execution', 'decode')")).where("kind = 'dynamic_execution' AND source_kind = 'decode'")
    g = e.groupBy("page_id").agg(F.count("*").alias("n"), joined(F.collect_set("source_api")).alias("methods"))
    return pages.select("page_id").join(g, "page_id", "left").select("page_id", F.col("n").isNotNull().alias("detected"), F.coalesce("n", F.lit(0)).alias("n"), "methods")


def credential_access_exfil(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Field read (J-05), and a read whose value goes to another site (J-06)."""
    e = _with_source(events.where("kind IN ('credential_read', 'network')"))
    read = F.col("kind") == "credential_read"
    sent = F.when(F.col("source_kind") == "credential_read", F.col("external"))
    g = e.groupBy("page_id").agg(F.bool_or(read).alias("read"), F.count_if(~read).alias("requests"),
                                 F.bool_or(~read & sent).alias("ext"), F.count_if(~read & sent.isNull()).alias("unknown"))
    j = pages.select("page_id").join(g, "page_id", "left")
    has_read = F.coalesce("read", F.lit(False))
    j06 = first_true([(F.coalesce("ext", F.lit(False)), True), (has_read & (F.col("unknown") > 0), F.lit(None).cast("boolean"))], False)
    rows = F.array(F.struct(F.lit("L3-J-05").alias("signal_id"), has_read.alias("detected")), F.struct(F.lit("L3-J-06").alias("signal_id"), j06.alias("detected")))
    return j.select("page_id", F.explode(rows).alias("x")).select("page_id", "x.*")


def env_branching(pages: DataFrame, branches: DataFrame) -> DataFrame:
    """Environment branches whose two arms do different things (order within an arm is ignored)."""
    # Arms are compared by how often each has a thing, so rows are counted before they move and no list is made.
    more = F.when(F.col("arm") == "a", 1).when(F.col("arm") == "b", -1).otherwise(0)
    item = F.concat_ws("|", "behaviour", "target")
    g = branches.groupBy("page_id", "branch_id", item.alias("item")).agg(F.sum(more).alias("more"))
    g = g.groupBy("page_id", "branch_id").agg(F.bool_or(F.col("more") != 0).alias("differs"))
    p = g.groupBy("page_id").agg(F.bool_or("differs").alias("differs"), F.count("*").alias("branches"))
    return pages.select("page_id").join(p, "page_id", "left").select("page_id", F.coalesce("differs", F.lit(False)).alias("detected"), F.coalesce("branches", F.lit(0)).alias("branches"))


def signal_completeness(signals: DataFrame) -> DataFrame:
    """Final status of a script signal.

    Positives stay. Without scripts the signal does not apply; without a policy it is
    evaluated but unknown; unparsed or incomplete sources, and relations that could not be
    followed, turn a negative into an error.
    """
    d, positive = F.col("detected"), F.coalesce(F.col("detected"), F.lit(False))
    error = first_true([
        ((F.col("script_count") == 0) | positive, F.lit(None).cast("string")), (~F.col("policy_set"), "detection_policy_unresolved"),
        (F.col("parsed_count") == 0, "javascript_analysis_unavailable"), (~F.col("source_complete"), "javascript_analysis_incomplete"),
        (F.col("semantic_error").isNotNull() & (d == F.lit(False)), "javascript_relationship_unresolved")])
    status = first_true([(F.col("script_count") == 0, "not_applicable"), (error.isNull() | (error == "detection_policy_unresolved"), "evaluated")], "error")
    return signals.select("target_id", "signal_id", status.alias("status"), F.when((status == "evaluated") & error.isNull(), d).alias("detected"), error.alias("error"))


def json_content_fields(scripts: DataFrame, levels: int = 32) -> DataFrame:
    """JSON blocks as (path, kind, value, resolved URL): text, address and resource fields by key role.

    Objects are opened level by level inside one task chain, ``levels`` at a time, until none holds a text.
    """
    m = F.lower(F.trim(F.split_part(F.coalesce("media_type", F.lit("")), F.lit(";"), F.lit(1))))
    node = scripts.where(m.isin(*JSON_TYPES)).select("page_id", "url", "script_id", F.lit("").alias("path"), F.lit(None).cast("string").alias("key"),
                                                     F.lit(None).cast("string").alias("declared_type"), F.try_parse_json("source").alias("v"))
    shape = F.schema_of_variant("v")
    unopened = shape.rlike("^(OBJECT|ARRAY)<") & shape.rlike("STRING|VARIANT")
    while True:
        for _ in range(levels):
            # A scalar has nothing to open: the outer form keeps its row as it is.
            node = scripts.sparkSession.sql(
                "SELECT d.page_id, d.url, d.script_id, if(x.pos IS NULL, d.path, concat(d.path, '/', coalesce(replace(replace(x.key, '~', '~0'), '/', '~1'), CAST(x.pos AS STRING)))) AS path, "
                "if(x.pos IS NULL, d.key, x.key) AS key, if(x.pos IS NULL, d.declared_type, try_variant_get(d.v, '$.type', 'string')) AS declared_type, "
                "if(x.pos IS NULL, d.v, x.value) AS v FROM {node} d, LATERAL variant_explode_outer(d.v) x", node=node)
        node = materialise(node, "json-nodes")
        if node.where(unopened).isEmpty():
            break
    leaf = node.where(F.schema_of_variant("v") == "STRING").withColumn("value", F.try_variant_get("v", "$", "string")).where(F.trim("value") != "")
    role = F.regexp_replace(F.lower("key"), "[^a-z]", "")
    media = F.coalesce(F.lower("declared_type").isin(*MEDIA_WORDS), F.lit(False))
    address = role.isin(*ADDRESS_KEYS) | ((role == "content") & media)
    kind = first_true([(address & (media | role.isin("image", "src")), "resource"), (address, "address"),
                       (role.isin(*TEXT_KEYS) & ~F.ltrim("value").rlike("^https?://"), "text")])
    f = leaf.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("_ref", F.when(F.col("kind") != "text", F.col("value")))
    return U.with_resolved(f, "_ref", "url", "resolved_url").select("page_id", "script_id", "path", "kind", "value", "resolved_url", "declared_type")


def content_groups(fields: DataFrame, page_hosts: DataFrame) -> DataFrame:
    """Static objects that hold both a text and an address, without menus that only repeat the page's own links.

    ``page_hosts`` gives each page's host and whether its links already lead there. Typed
    neighbours in an array with a concrete control stay too.
    """
    last = F.regexp_replace(F.lower(F.regexp_extract("path", "([^/]*)$", 1)), "[^a-z]", "")
    word = F.lower(F.coalesce("declared_type", F.lit("")))
    is_address = F.col("kind") == "address"
    f = fields.withColumns({"obj": F.regexp_replace("path", "/[^/]*$", ""), "host": F.when(is_address, U.raw_host(F.col("resolved_url")))}).join(page_hosts, "page_id", "left")
    key = ["page_id", "script_id", "obj"]
    o = f.groupBy(*key).agg(
        F.bool_or(F.col("kind") == "text").alias("t"), F.bool_or(is_address).alias("a"), F.bool_or(word.isin(*CONTROL_TYPES) | last.isin(*CONTROL_KEYS)).alias("control"),
        F.bool_or(word.isin(*CONTENT_TYPES)).alias("typed"), F.bool_and(~is_address | F.coalesce(F.col("host") == F.col("page_host"), F.lit(False))).alias("own"),
        F.bool_or(F.coalesce("known_navigation", F.lit(False))).alias("known"))
    o = o.withColumn("arr", F.when(F.col("obj").rlike("/[0-9]+$"), F.regexp_replace("obj", "/[0-9]+$", "")))
    menu = F.col("obj").rlike("(?i)(?:^|/)[^/]*(?:menu|nav)[^/]*(?:/|$)") & ~F.col("control") & F.col("known") & F.col("own")
    good = F.col("t") & F.col("a") & ~menu
    arrays = o.where(good & F.col("control") & F.col("arr").isNotNull()).select("page_id", "script_id", "arr").distinct().withColumn("arr_kept", F.lit(True))
    kept = o.join(arrays, ["page_id", "script_id", "arr"], "left").where(good | (F.col("arr_kept") & F.col("typed"))).select(*key)
    return f.join(kept, key, "left_semi").select("page_id", "script_id", "path", "kind", "value")
