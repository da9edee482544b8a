"""Brand tables, brand identification and brand/domain comparison."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.logic import any3, first_true, joined
from ..refdata import SuffixIndex
from ..session import materialise
from .domains import etld1

GRAM = 3


def brand_policy_from_table(brands: DataFrame) -> DataFrame:
    """Token rows per brand: names for title and site name, compact letters-and-digits for host labels."""
    names = F.array_distinct(F.array_compact(F.concat(F.array("requested_name", "label"), F.coalesce("aliases", F.array().cast("array<string>")))))
    n = brands.select(F.col("label").alias("brand"), F.explode(names).alias("name"))
    compact = F.lower(F.regexp_replace("name", r"[^\p{L}\p{N}]", ""))
    rows = F.array(F.struct(F.lit("title").alias("token_kind"), F.lower("name").alias("token")), F.struct(F.lit("site_name").alias("token_kind"), F.lower("name").alias("token")),
                   F.struct(F.lit("hostname").alias("token_kind"), compact.alias("token")))
    return n.select("brand", F.explode(rows).alias("x")).select("brand", "x.*").where("token <> ''").distinct()


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))))


def _contains(docs: DataFrame, tokens: DataFrame, col: str, kind: str) -> DataFrame:
    """Exact substring match by token anchors: a text that holds a token holds each of its pieces, so also its rarest one.

    Tokens of three letters and more are looked for by the one of their three-letter pieces that fewest texts hold, shorter
    ones by themselves. Texts send hashes of pieces, and only of those that occur in a token; a text itself moves once, for
    the tokens whose anchor it holds, and is checked in full.
    """
    t = tokens.where(F.col("token_kind") == kind).select("brand", "token").distinct()
    t = t.withColumn("piece", F.explode(F.when(F.length("token") < GRAM, F.array("token")).otherwise(_grams(F.col("token"), GRAM))))
    low = docs.where(F.col(col).isNotNull()).select("page_id", F.lower(F.col(col)).alias("txt"))
    grams = F.array_distinct(F.concat(*[F.coalesce(_grams(F.col("txt"), n), F.array().cast("array<string>")) for n in range(1, GRAM + 1)]))
    pieces = low.select("page_id", F.explode(F.transform(grams, lambda g: F.xxhash64(g))).alias("h"))
    wanted = t.select(F.xxhash64("piece").alias("h")).distinct()
    held = materialise(pieces.join(wanted, "h", "left_semi"), "pieces")
    often = held.groupBy("h").agg(F.count("*").alias("n"))
    ranked = t.withColumn("h", F.xxhash64("piece")).join(often, "h", "left")  # a piece that no text holds rules its token out
    anchors = ranked.groupBy("brand", "token").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("h").alias("h"))).alias("a")).where("a.n > 0")
    candidates = held.join(anchors.select("brand", "token", "a.h"), "h").select("page_id", "brand", "token")
    return low.join(candidates, "page_id").where(F.contains("txt", "token")).select("page_id", "brand", F.lit(kind).alias("source"))


def brand_identify(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The one brand a page names; none or several leave it unknown."""
    labels = docs.select("page_id", F.explode(F.split(F.lower("hostname"), r"\.")).alias("label"))
    parts = F.split("label", "-")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(F.sequence(F.lit(1), F.size(parts) - i + 1), lambda k: F.array_join(F.slice(parts, i, k), "-"))))
    h = labels.select("page_id", F.explode(F.array_distinct(runs)).alias("token")).join(tokens.where("token_kind = 'hostname'").select("brand", "token"), "token")
    hits = _contains(docs, tokens, "title", "title").unionByName(_contains(docs, tokens, "site_name", "site_name")).unionByName(h.select("page_id", "brand", F.lit("hostname").alias("source")))
    g = hits.groupBy("page_id").agg(F.min("brand").alias("lo"), F.max("brand").alias("hi"), F.collect_set("source").alias("s"))
    one = F.col("lo") == F.col("hi")
    g = g.where(one).select("page_id", F.col("lo").alias("brand"), joined(F.col("s")).alias("sources"),
                            F.when(F.array_contains("s", "title") | F.array_contains("s", "site_name"), "high").otherwise("low").alias("confidence"))
    return docs.select("page_id").join(g, "page_id", "left")


def brand_domain_mismatch(identified: DataFrame, current: DataFrame, brand_domains: DataFrame) -> DataFrame:
    """Identified brand on a domain that is not one of its own."""
    known = brand_domains.groupBy("brand").agg(F.count("domain").alias("n"))
    own = brand_domains.where("domain IS NOT NULL").select("brand", F.col("domain").alias("current_domain"), F.lit(True).alias("own")).distinct()
    j = identified.join(current, "page_id", "left").join(known, "brand", "left").join(own, ["brand", "current_domain"], "left")
    limit = first_true([(F.col("brand").isNull(), "brand_not_identified"), (F.col("n").isNull(), "brand_absent_from_domain_reference"),
                        (F.col("current_domain").isNull(), "brand_comparison_domain_unresolved"), (F.col("n") == 0, "brand_domain_reference_empty")])
    return j.select("page_id", F.when(limit.isNull(), F.col("own").isNull()).alias("detected"), limit.alias("limitation"))


def brand_resource_mismatch(resources: DataFrame, identified: DataFrame, current: DataFrame, allowed: DataFrame, shared: DataFrame, policies: DataFrame) -> DataFrame:
    """A page resource outside current, brand and shared domains; could-not-tell without a resource policy."""
    ok_brand = allowed.select("brand", "domain", F.lit(True).alias("b")).distinct()
    ok_shared = shared.select("domain", F.lit(True).alias("s")).distinct()
    r = resources.where("domain IS NOT NULL").select("page_id", "domain").distinct().join(identified.select("page_id", "brand"), "page_id").join(current, "page_id")
    r = r.join(ok_brand, ["brand", "domain"], "left").join(ok_shared, "domain", "left")
    odd = F.col("b").isNull() & F.col("s").isNull() & (F.col("domain") != F.col("current_domain"))
    g = r.groupBy("page_id").agg(F.bool_or(odd).alias("odd"))
    j = identified.join(current, "page_id", "left").join(policies, "brand", "left").join(g, "page_id", "left")
    known = F.col("resource_policy").isNotNull() & F.col("current_domain").isNotNull()
    out = F.when(known & ~F.coalesce("odd", F.lit(False)), F.lit(False)).when(known & F.col("resource_policy"), F.lit(True))
    return j.select("page_id", out.alias("detected"))


def brand_resolve(ranked: DataFrame, entity_domains: DataFrame) -> DataFrame:
    """Ranked domain to the one entity whose current official site it is."""
    e = entity_domains.select("entity_id", "domain").distinct().groupBy("domain").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id"))
    j = ranked.join(e, "domain", "left")
    return j.select("rank", "domain", F.when(F.col("n") == 1, F.col("entity_id")).alias("entity_id"),
                    F.when(F.col("n").isNull(), "no_entity").when(F.col("n") > 1, "several_entities").alias("unresolved"))


def official_domains(claims: DataFrame, at: Column, index: SuffixIndex) -> DataFrame:
    """Current site claims: deprecated and ended ones dropped, preferred rank wins, distinct domains."""
    c = claims.where((F.col("claim_rank") != "deprecated") & (F.col("end_time").isNull() | (F.col("end_time") > at)))
    best = c.groupBy("entity_id").agg(F.bool_or(F.col("claim_rank") == "preferred").alias("has_preferred"))
    c = c.join(best, "entity_id").where(~F.col("has_preferred") | (F.col("claim_rank") == "preferred"))
    return etld1(c, index, "url", "domain").where("domain IS NOT NULL").select("entity_id", "domain").distinct()


def entity_labels(names: DataFrame, requested: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Label by language order, aliases distinct ignoring case; the requested name must be among them."""
    rank = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang"))
    n = names.withColumn("r", rank).where("r > 0")
    label = n.where("kind = 'label'").groupBy("entity_id").agg(F.min_by("value", F.struct("r", "value")).alias("label"))
    alias = n.groupBy("entity_id", F.lower("value").alias("folded")).agg(F.min("value").alias("alias"))
    ok = alias.join(requested.select("entity_id", F.lower("requested_name").alias("folded")), ["entity_id", "folded"], "left_semi").select("entity_id").distinct().withColumn("named", F.lit(True))
    j = alias.join(label, "entity_id").join(ok, "entity_id", "left")
    return j.where(F.col("folded") != F.lower("label")).select("entity_id", "label", "alias", F.coalesce("named", F.lit(False)).alias("requested_found"))


POLICY_SHAPE = ("struct<schema_version:string,policy_name:string,credential_fields:struct<type_mapping:map<string,string>,autocomplete_mapping:map<string,string>,identifier_tokens:map<string,array<string>>>,"
                "javascript:map<string,string>>")
POLICY_FIELDS = ("schema_version", "policy_name", "credential_fields", "brands", "brand_resources", "javascript")


def policy_tables(docs: DataFrame, col: str = "body") -> tuple[DataFrame, DataFrame]:
    """Policy JSON as one rule table (policy_id, map, key, kind) and its problem rows."""
    p = docs.select("policy_id", F.from_json(col, POLICY_SHAPE).alias("p"), F.json_object_keys(col).alias("keys"))
    pairs = lambda name, field: p.select("policy_id", F.lit(name).alias("map"), F.explode(f"p.credential_fields.{field}").alias("key", "kind"))
    tokens = p.select("policy_id", F.explode("p.credential_fields.identifier_tokens").alias("kind", "toks")).select("policy_id", F.lit("token").alias("map"), F.explode("toks").alias("key"), "kind")
    rules = pairs("type", "type_mapping").unionByName(pairs("autocomplete", "autocomplete_mapping")).unionByName(tokens)
    unknown = p.select("policy_id", F.explode(F.array_except("keys", F.array(*[F.lit(f) for f in POLICY_FIELDS]))).alias("subject")).select("policy_id", F.lit("unknown_field").alias("problem"), "subject")
    twice = rules.groupBy("policy_id", "map", F.lower("key").alias("subject")).agg(F.count_distinct("kind").alias("n")).where("n > 1").select("policy_id", F.lit("token_with_two_kinds").alias("problem"), "subject")
    bad = p.where("p.credential_fields IS NULL").select("policy_id", F.lit("wrong_type").alias("problem"), F.lit("credential_fields").alias("subject"))
    return rules, unknown.unionByName(twice).unionByName(bad)
