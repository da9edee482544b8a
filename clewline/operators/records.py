"""Signals, causes and layer records: states, roll-ups, deduplication and integrity checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.logic import canonical_json, content_hash, first_true

# Signal states, and lookup states in order.
SIGNAL_STATES = ("not_applicable", "not_observed_in_analyzed_scope", "observed", "relationship_record_only", "unresolved")


def cause_kind_of(code: Column) -> Column:
    """Cause kind of an error code; the first rule that matches wins."""
    c = lambda *words: code.rlike("|".join(words))
    return first_true([
        (code.endswith("_not_configured"), "capability_not_configured"),
        (code == "brand_not_identified", "identification_unresolved"),
        (code.isin("brand_absent_from_domain_reference", "brand_domain_reference_empty"), "reference_coverage_gap"),
        (code == "brand_resource_evaluator_abstained", "evaluation_abstained"),
        (code == "analysis_unresolved_reason_not_recorded", "reason_not_recorded"),
        (code.startswith("brand_") & c("invalid"), "invalid_policy_result_or_configuration"),
        (c("policy") & c("unresolved", "missing"), "policy_unconfigured"),
        (c("blocked"), "collection_blocked"),
        (c("timeout"), "collection_timeout"),
        (c("parse", "syntax"), "parse_unsupported_or_invalid"),
        (c("encoding", "decoding"), "decoding_incomplete"),
        (c("truncat", "limit", "interrupted"), "partial_observation"),
        (c("order", "selector", "conditional", "source_sink", "callback"), "relationship_unresolved"),
        (c("source_unavailable"), "source_unavailable"),
        (c("unsupported_content"), "content_outside_analyzer_scope"),
        (c("not_attempted"), "not_attempted"),
        (c("historical"), "historical_observation_limit"),
    ], "tool_or_collection_error")


def cause_kind(errors: DataFrame, code: str = "code") -> DataFrame:
    return errors.withColumn("kind", cause_kind_of(F.col(code)))


def signal_state_of(detected: Column, status: Column) -> Column:
    return first_true([
        (detected, "observed"), (~detected, "not_observed_in_analyzed_scope"),
        (status == "relationship_only", "relationship_record_only"), (status == "not_applicable", "not_applicable"),
    ], "unresolved")


def signal_state(signals: DataFrame) -> DataFrame:
    return signals.withColumn("state", signal_state_of(F.col("detected"), F.col("status")))


def signal_contract(signals: DataFrame) -> DataFrame:
    """Rows that state a result although they were not evaluated."""
    return signals.where((F.col("status") != "evaluated") & F.col("detected").isNotNull())


def result_counts(signals: DataFrame) -> DataFrame:
    s = signal_state(signals)
    return s.groupBy("request_id", "layer").agg(*[F.count_if(F.col("state") == n).alias(n) for n in SIGNAL_STATES])


def observation_state_of(status: Column, partial: Column) -> Column:
    return first_true([
        (status == "not_queried", "not_attempted"), (status.isin("timeout", "tool_error"), "unavailable"),
        (partial, "partial"), (status.isNotNull(), "observed")], "unrecorded")


def observation_state(lookups: DataFrame) -> DataFrame:
    return lookups.withColumn("state", observation_state_of(F.col("status"), F.coalesce(F.col("dropped") > 0, F.lit(False))))


def acquisition_state(lookups: DataFrame, causes: DataFrame) -> DataFrame:
    """Layer acquisition from its lookups: partial as soon as anything usable sits beside a gap."""
    c = causes.groupBy("request_id", "layer").agg(F.count("*").alias("cause_count"))
    st = F.col("state")
    agg = observation_state(lookups).groupBy("request_id", "layer").agg(
        F.bool_or(st.isin("observed", "partial")).alias("usable"), F.bool_or(st != "observed").alias("gap"),
        F.bool_and(st == "not_attempted").alias("none_tried"), F.bool_or(st == "unavailable").alias("failed"))
    # A layer that only has causes could not be observed.
    j = agg.join(c, ["request_id", "layer"], "outer")
    return j.select("request_id", "layer", first_true([
        (F.col("usable") & F.col("gap"), "partial"), (F.col("usable"), "observed"), (F.col("none_tried"), "not_attempted"),
        (F.col("failed") | F.col("cause_count").isNotNull(), "unavailable")], "unrecorded").alias("state"))


def analysis_state(signals: DataFrame, causes: DataFrame) -> DataFrame:
    c = causes.where("impact_scope = 'analysis'").groupBy("request_id", "layer").agg(F.count("*").alias("cause_count"))
    st = F.col("state")
    agg = signal_state(signals).groupBy("request_id", "layer").agg(
        F.bool_or(st.isin("observed", "not_observed_in_analyzed_scope", "relationship_record_only")).alias("usable"),
        F.bool_or(st == "unresolved").alias("open"))
    j = agg.join(c, ["request_id", "layer"], "outer").withColumn("open", F.col("open") | F.col("cause_count").isNotNull())
    return j.select("request_id", "layer", first_true([
        (F.col("usable") & F.col("open"), "partial"), (F.col("open"), "unavailable")], "completed").alias("state"))


def execution_state(records: DataFrame, causes: DataFrame) -> DataFrame:
    failed = causes.where("code = 'layer_execution_failed'").select("request_id", "layer").distinct().withColumn("failed", F.lit(True))
    j = records.join(failed, ["request_id", "layer"], "left")
    return j.select("request_id", "layer", first_true([
        (F.col("preflight") == "blocked", "not_performed"), (F.col("stop_reason").isNotNull(), "interrupted"),
        (F.col("failed"), "failed"), (F.col("producer_status").isNull(), "unrecorded")], "completed").alias("state"))


def cause_dedupe(errors: DataFrame) -> DataFrame:
    """One cause id per identity; one row per distinct place that reported it."""
    h = F.sha2(canonical_json("request_id", "layer", "code"), 256)
    cid = F.concat(F.col("layer"), F.lit(":cause:"), F.substring(h, 1, 16))
    return errors.select("request_id", cid.alias("cause_id"), "code", cause_kind_of(F.col("code")).alias("kind"), "hint").distinct()


def cause_types(causes: DataFrame) -> DataFrame:
    """The shared description of causes factored out, occurrences counted separately."""
    c = causes.select("request_id", "layer", "code", cause_kind_of(F.col("code")).alias("kind"))
    t = c.groupBy("layer", "code", "kind").agg(F.count("*").alias("n"), F.count_distinct("request_id").alias("requests"))
    return t.withColumn("type_id", F.substring(content_hash("code", "kind", "layer"), 1, 16))


def attempt_consistency(records: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """Requests whose layer records do not fit together."""
    agg = records.groupBy("request_id").agg(
        F.count_distinct("attempt").alias("attempts"), F.count_distinct("requested_url").alias("urls"),
        F.count("*").alias("n"), F.count_distinct("layer").alias("distinct_layers"),
        *[F.count_if(F.col("layer") == x).alias(f"has_{x}") for x in layers])
    missing = F.array(*[F.when(F.col(f"has_{x}") == 0, F.lit(f"missing_layer_{x}")) for x in layers])
    problems = F.concat(F.array(
        F.when(F.col("attempts") > 1, "mixed_attempt"), F.when(F.col("urls") > 1, "several_requested_urls"),
        F.when(F.col("n") > F.col("distinct_layers"), "duplicate_layer")), missing)
    return agg.select("request_id", F.explode(F.array_compact(problems)).alias("problem"))


def dangling_refs(refs: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    return refs.join(targets.select(*key).distinct(), key, "left_anti")


def record_raw_integrity(records: DataFrame, raws: DataFrame) -> DataFrame:
    """Stored hash against the raw text it names; either side may be missing."""
    r = raws.select("raw_key", F.sha2("raw_text", 256).alias("actual"))
    j = records.select("raw_key", F.col("stored_sha256")).join(r, "raw_key", "full_outer")
    problem = F.when(F.col("actual").isNull(), "record_without_raw").when(F.col("stored_sha256").isNull(), "raw_without_record").when(
        F.col("stored_sha256") != F.col("actual"), "hash_mismatch")
    return j.select("raw_key", problem.alias("problem")).where("problem IS NOT NULL")


def event_source_links(events: DataFrame, refs: DataFrame, sources: DataFrame) -> DataFrame:
    """How an event relates to the source events it names."""
    s = sources.select(F.col("source_id").alias("_s")).distinct()
    e = refs.join(s, F.col("source_id") == F.col("_s"), "left").groupBy("event_id").agg(
        F.count("source_id").alias("named"), F.count_if(F.col("source_id").isNotNull() & F.col("_s").isNull()).alias("unresolved_n"))
    j = events.join(e, "event_id", "left")
    named, lost = F.coalesce("named", F.lit(0)), F.coalesce("unresolved_n", F.lit(0))
    rel = first_true([(named == 0, "no_source_recorded"), (lost == 0, "recorded_source_links"), (lost == named, "source_links_unresolved")], "source_links_partly_resolved")
    return j.select("event_id", rel.alias("relationship"), lost.alias("unresolved_n"))


def redundant_evidence(signals: DataFrame, entities: DataFrame) -> DataFrame:
    """Evidence fields that repeat the same field of the entity they point to."""
    e = entities.select("entity_id", "field", F.col("value").alias("_v"))
    return signals.join(e, ["entity_id", "field"]).where(F.col("value") == F.col("_v")).select("signal_id", "field", "entity_id")


def source_location(pointers: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pointer to artifact by exact key or longest known prefix, tried one path level at a time."""
    segs = F.split("pointer", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(segs)), lambda i: F.array_join(F.slice(segs, F.lit(1), i), "/"))
    x = pointers.select("evidence_id", "pointer", F.explode(tails).alias("prefix")).join(prefixes, "prefix")
    best = x.groupBy("evidence_id", "pointer").agg(F.max_by(F.struct("prefix", "layer", "source", "root"), F.length("prefix")).alias("b"))
    rest = F.expr("substring(pointer, length(b.prefix) + 1)")
    return best.select("evidence_id", "b.layer", "b.source", F.concat("b.root", rest).alias("artifact_pointer"))


def artifact_consistency(jobs: DataFrame, artifacts: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of an artifact that disagree with its job, one row per disagreement."""
    a = artifacts.select("job_id", "artifact", *[F.col(f).alias(f"_a_{f}") for f in fields])
    j = a.join(jobs.select("job_id", *fields), "job_id")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("expected"), F.col(f"_a_{f}").cast("string").alias("found")) for f in fields])
    return j.select("job_id", "artifact", F.explode(rows).alias("x")).select("job_id", "artifact", "x.*").where("NOT (expected <=> found)")


def public_revision(results: DataFrame, cols: list[str]) -> DataFrame:
    return results.select("job_id", content_hash(*cols).alias("sha256"))
