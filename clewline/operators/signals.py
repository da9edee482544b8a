"""Every signal of a page in one table, in fixed order, with its status.

Checks hand in what they found, one row per page and signal; what that says about pages that were cut, not collected or
have nothing to check is worked out here and nowhere else.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.logic import first_true
from ..session import materialise
from .pages import html_result, page_sources
from .scripts import signal_completeness

# The signals in their order, and those that measure and detect nothing.
HEADER = tuple(f"L2-H-0{k}" for k in range(1, 10))
CERTIFICATE = tuple(f"L2-C-0{k}" for k in range(1, 9))
HTML = tuple(f"L3-H-0{k}" for k in range(1, 9))
SCRIPT = tuple(f"L3-J-0{k}" for k in range(1, 10))
SIGNALS = HEADER + CERTIFICATE + HTML + SCRIPT
MEASURED = ("L2-C-01", "L2-C-06")
#: Of these a page without a row has nothing to check.
ONLY_WHERE_FOUND = ("L3-H-03", "L3-H-04")


def finding(rows: DataFrame, signal_id: str | None, key: str = "page_id", detected: str = "detected", measured: str | None = None) -> DataFrame:
    """Result rows of a check as (target_id, signal_id, detected, measured)."""
    name = F.lit(signal_id) if signal_id else F.col("signal_id")
    return rows.select(F.col(key).cast("bigint").alias("target_id"), name.alias("signal_id"), F.expr(detected).cast("boolean").alias("detected"),
                       (F.col(measured).isNotNull() if measured else F.lit(True)).alias("measured"))


def script_facts(statuses: DataFrame) -> DataFrame:
    """Per page: scripts that run, those that were parsed, and whether the source of all is there, from ``script_status``."""
    runs = F.col("status") != "data_block"
    return statuses.groupBy("page_id").agg(F.count_if(runs).alias("script_count"), F.count_if(F.col("status") == "parsed").alias("parsed_count"),
                                           F.bool_and(~runs | (F.col("status") == "parsed")).alias("scripts_complete"))


def page_signals(pages: DataFrame, findings: list[DataFrame], statuses: DataFrame, policies: tuple[str, ...] = SCRIPT) -> DataFrame:
    """target_id, position, signal_id, status, detected, error for every page and signal.

    ``findings`` come from :func:`finding`, at most one row per page and signal. A header or certificate signal without a
    row was not collected. ``statuses`` are those of the pages' scripts; a script signal outside ``policies`` has no policy.
    """
    found = reduce(lambda a, b: a.unionByName(b), findings).where(F.col("signal_id").isin(*SIGNALS))
    # All findings meet their page in one shuffle, counted together before it as one bit a signal; a page has at most one entry a signal.
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int"))
    bits = found.withColumn("bit", bit(F.array_position(F.array(*[F.lit(s) for s in SIGNALS]), F.col("signal_id")) - 1))
    where = lambda c: F.coalesce(F.bit_or(F.when(c, F.col("bit"))), F.lit(0))
    by_page = bits.groupBy("target_id").agg(F.count("*").alias("n"), F.bit_or("bit").alias("found"), where(F.col("detected")).alias("yes"), where(~F.col("detected")).alias("no"), where(F.col("measured")).alias("measures"))
    once = F.when(F.col("n") == F.bit_count("found"), F.col("found")).otherwise(F.raise_error(F.lit("a page has two findings of one signal")))
    by_page = by_page.withColumn("found", once).drop("n")
    base = page_sources(pages).join(by_page, F.col("page_id") == F.col("target_id"), "left").drop("target_id").join(script_facts(statuses), "page_id", "left")
    base = base.withColumns({"script_count": F.coalesce("script_count", F.lit(0)), "parsed_count": F.coalesce("parsed_count", F.lit(0))})
    # Written, as the two kinds of signals below read different columns of it and would each work out all findings.
    base = materialise(base, "findings")
    every = base.select("*", F.posexplode(F.array(*[F.lit(s) for s in SIGNALS])).alias("position", "signal_id"))
    held = lambda mask: F.coalesce(F.col(mask).bitwiseAND(bit(F.col("position"))) != 0, F.lit(False))
    every = every.withColumns({"got": held("found"), "detected": F.when(held("yes"), True).when(held("no"), False), "measured": held("measures")}).withColumns({
        "target_id": F.col("page_id"), "position": F.col("position") + 1})

    name = F.col("signal_id")
    flat = every.where(~name.isin(*SCRIPT))
    html = html_result(F.col("detected"), F.col("got") | ~name.isin(*ONLY_WHERE_FOUND))
    missing = first_true([(~F.col("got"), "not_collected"), (name.isin(*MEASURED) & ~F.col("measured"), "measurement_unavailable")])
    other = F.struct(F.when(missing.isNull(), "evaluated").otherwise("error").alias("status"), F.when(missing.isNull() & ~name.isin(*MEASURED), F.col("detected")).alias("detected"), missing.alias("error"))
    flat = flat.select("target_id", "position", "signal_id", F.when(name.isin(*HTML), html).otherwise(other).alias("r")).select("target_id", "position", "signal_id", "r.*")

    scripts = every.where(name.isin(*SCRIPT)).withColumns({
        "detected": F.coalesce("detected", F.when(~F.col("got"), F.lit(False))), "policy_set": name.isin(*policies), "semantic_error": F.lit(None).cast("string"),
        "source_complete": F.col("source_complete") & F.coalesce("scripts_complete", F.lit(True))})
    places = {s: k + 1 for k, s in enumerate(SIGNALS)}
    place = F.create_map(*[x for s in SCRIPT for x in (F.lit(s), F.lit(places[s]))])
    done = signal_completeness(scripts).withColumn("position", place[F.col("signal_id")])
    return flat.unionByName(done)
