"""Checks of a verdict against the recorded evidence."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.logic import first_true
from ..functions.udfs import fold_udf
from ..session import materialise

# Verdicts by contract version.
VERDICTS = {
    "1": ("MALICIOUS", "LIKELY_MALICIOUS", "LIKELY_BENIGN", "BENIGN", "UNKNOWN"),
    "2": ("MALICIOUS", "SUSPICIOUS", "LIKELY_BENIGN", "UNKNOWN"),
}
# Word stems by language and by their part in a claim that a secret was sent.
WORDS = {
    ("object", "en"): ("credential", "password"),
    ("object", "ko"): ("비밀번호", "암호", "자격증명"),
    ("transfer", "en"): ("deliver", "exfiltrat", "forward", "leak", "send", "sent", "transmit"),
    ("transfer", "ko"): ("보내", "보냈", "송신", "유출", "전달", "전송", "흘러"),
    ("denial", "en"): ("not", "never", "no evidence", "without evidence", "cannot", "n't"),
    ("denial", "ko"): ("않", "못하", "못했", "증거가 없", "증거는 없", "증거 없"),
    ("static", "en"): ("configured", "configuration"),
    ("static", "ko"): ("구성", "설정", "하도록"),
    ("observed", "en"): ("actually", "delivered", "observed", "was sent", "were sent"),
    ("observed", "ko"): ("관찰", "보냈다", "송신했다", "실제", "실행되어", "유출됐다", "유출되었다", "전달했다", "전송됐다", "전송되었다", "전송했다"),
}
CLAUSE_END = r"[,;。；\n]|\.(?:\s|$)|\b(?:but|however)\b|지만"


def spoken(role: str) -> str:
    """Pattern of the words of a role, in any case; blanks stand for any white space."""
    stems = [w for (r, _), words in WORDS.items() if r == role for w in words]
    return "(?i)(?:" + "|".join((r"\b" if w.isascii() and w[0] != "n" or w in ("not", "never", "no evidence") else "") + w.replace(" ", r"\s+") for w in stems) + ")"


def valid_verdict(verdict: Column, contract: Column) -> Column:
    """Whether the contract has the verdict; a version that is not known has none."""
    return F.coalesce(first_true([(contract == v, verdict.isin(*words)) for v, words in VERDICTS.items()], False), F.lit(False))


def verdict_contract(judgments: DataFrame, reasons: DataFrame, facts: DataFrame) -> DataFrame:
    """Structural problem rows of a verdict, by the contract version of its row (the first where there is none)."""
    j = judgments if "contract" in judgments.columns else judgments.withColumn("contract", F.lit("1"))
    r = reasons.groupBy("job_id").agg(F.count("*").alias("n"))
    row = lambda df, name: df.select("job_id", F.lit(name).alias("problem"))
    bad = row(j.where(~valid_verdict(F.col("verdict"), F.coalesce("contract", F.lit("1")))), "invalid_verdict")
    empty = row(j.where(F.coalesce(F.trim("interpretation"), F.lit("")) == ""), "empty_text")
    none = row(j.where("NOT verdict <=> 'UNKNOWN'").join(r, "job_id", "left_anti"), "missing_reasons")
    dup = row(reasons.groupBy("job_id", "fact_id").agg(F.count("*").alias("n")).where("n > 1").select("job_id").distinct(), "duplicate_fact_id")
    ref = row(reasons.join(facts.select("fact_id").distinct(), "fact_id", "left_anti").select("job_id").distinct(), "unknown_fact_id")
    return bad.unionByName(empty).unionByName(none).unionByName(dup).unionByName(ref)


def claims_transfer(text: Column, observed: bool = False) -> Column:
    """A clause that says a secret was sent and does not deny it; ``observed``: that it was seen to be, not only set up."""
    def hit(c):
        ok = c.rlike(spoken("object")) & c.rlike(spoken("transfer")) & ~c.rlike(spoken("denial"))
        return ok & c.rlike(spoken("observed")) & ~c.rlike(spoken("static")) if observed else ok
    return F.coalesce(F.exists(F.split(text, CLAUSE_END), hit), F.lit(False))


def verdict_basis_support(verdicts: DataFrame, basis: DataFrame, facts: DataFrame) -> DataFrame:
    """A credential-transfer claim needs a basis fact with that relation; an observed claim an observed one."""
    b = basis.join(facts, "fact_id").groupBy("job_id").agg(F.bool_or("transfer_relation").alias("linked"), F.bool_or(F.col("transfer_relation") & F.col("execution_observed")).alias("seen"))
    v = verdicts.select("job_id", claims_transfer(F.col("interpretation")).alias("claim"), claims_transfer(F.col("interpretation"), observed=True).alias("as_observed")).where("claim")
    j = v.join(b, "job_id", "left")
    code = first_true([(~F.coalesce("linked", F.lit(False)), "credential_transfer_without_linked_basis"),
                       (F.col("as_observed") & ~F.coalesce("seen", F.lit(False)), "observed_transfer_without_observed_basis")])
    return j.select("job_id", code.alias("finding_code")).where("finding_code IS NOT NULL")


def _folded(c: Column) -> Column:
    """Compatibility form, case folded, dashes alike, without white space."""
    return F.regexp_replace(F.translate(fold_udf(c), "—–−", "---"), r"\s+", "")


def _slip_keys(label: Column) -> Column:
    """Keys that two labels share when they differ by one Korean letter (changed, missing or extra)."""
    at = F.filter(F.sequence(F.lit(1), F.length(label)), lambda i: F.substring(label, i, F.lit(1)).rlike("[가-힣]"))
    cut = lambda mark: F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(label, F.lit(1), i - 1), F.lit("*" if mark == "S" else ""), F.substring(label, i + 1, F.length(label))))
    return F.when(F.length(label) > 0, F.array_distinct(F.concat(cut("S"), cut("D"), F.array(F.concat(F.lit("D"), label)))))


#: Steps of a link, in the order in which they are tried.
LINK_STEPS = ("exact", "normalized", "item_label", "spelling")


def _label_rows(df: DataFrame, **own: Column) -> DataFrame:
    """Rows with folded labels and what a slip leaves of them; without a document or a label they can meet nothing."""
    d = df.where("doc IS NOT NULL AND item IS NOT NULL").withColumns({"ns": _folded(F.col("section")), "ni": _folded(F.col("item"))})
    return d.withColumn("rest", F.regexp_replace("ni", "[가-힣]", "")).select("doc", "rest", "ni", "ns", "section", "item", *[c.alias(k) for k, c in own.items()])


def _steps_of_labels(reasons: DataFrame, items: DataFrame) -> DataFrame:
    """Reasons with their first step that has items (none yet for a slip), and the labels that a slip may lead to.

    A slip changes Korean letters only, so all rows that may meet have the rest of their labels in common: items and
    reasons move once, sorted together, and each step counts the items of a shorter key. Reasons without any item of
    that rest and items without a reason still open there go no further.
    """
    item = _label_rows(items, fact_id=F.col("fact_id"), reason_id=F.lit(None).cast(reasons.schema["reason_id"].dataType), cited=F.lit(False))
    reason = _label_rows(reasons, fact_id=F.lit(None).cast(items.schema["fact_id"].dataType), reason_id=F.col("reason_id"), cited=F.lit(True))
    key = ["doc", "rest", "ni", "ns", "section", "item"]
    every = item.unionByName(reason).repartition("doc", "rest").sortWithinPartitions(*key)
    over = lambda k: Window.partitionBy(*key[:k])
    places = (6, 4, 3)
    every = every.withColumns({k: v for no, n in enumerate(places) for k, v in ((f"n{no}", F.count_if(~F.col("cited")).over(over(n))), (f"f{no}", F.min("fact_id").over(over(n))))})
    named = (F.col("section").isNotNull(), F.col("section").isNotNull(), F.lit(True))
    step = first_true([(F.col("cited") & ok & (F.col(f"n{no}") > 0), no) for no, ok in enumerate(named)])
    every = every.withColumn("step", step)
    every = every.withColumns({"labels": F.count_if(~F.col("cited")).over(over(2)), "open": F.count_if(F.col("cited") & F.col("step").isNull()).over(over(2))})
    kept = every.where(F.when(F.col("cited"), F.col("step").isNotNull() | (F.col("labels") > 0)).otherwise(F.col("open") > 0))
    at = lambda c: first_true([(F.col("step") == no, F.col(f"{c}{no}")) for no in range(len(places))], F.when(~F.col("cited"), F.col(f"{c}1")))
    return kept.select("cited", "reason_id", "doc", "ns", "ni", "step", at("n").alias("n"), at("f").alias("fact_id"))


def judgment_item_link(reasons: DataFrame, items: DataFrame) -> DataFrame:
    """Reason reference to fact: exact pair, folded pair, folded label, then a one-letter Korean spelling slip.

    Items are counted per key, so a key met by many items is one number. Slip keys are made only for reasons still open
    after three steps and for labels that such a reason may reach.
    """
    rows = materialise(_steps_of_labels(reasons, items), "item-links")
    direct = rows.where("step IS NOT NULL").select("reason_id", "step", "n", "fact_id")
    # Labels one Korean letter apart share a key: the label with a letter masked, or with one left out.
    label = rows.where("NOT cited").groupBy("doc", "ns", F.col("ni").alias("other")).agg(F.max("n").alias("n"), F.min("fact_id").alias("fact_id"))
    r = rows.where("cited AND step IS NULL").select("reason_id", "doc", "ns", "ni", F.explode(_slip_keys(F.col("ni"))).alias("key"))
    x = r.join(label.select("doc", "ns", "other", "n", "fact_id", F.explode(_slip_keys(F.col("other"))).alias("key")), ["doc", "ns", "key"])
    near = x.where(F.levenshtein("ni", "other", 1) == 1).select("reason_id", "other", "n", "fact_id").distinct()
    slip = near.groupBy("reason_id").agg(F.sum("n").alias("n"), F.min("fact_id").alias("fact_id")).select("reason_id", F.lit(3).alias("step"), "n", "fact_id")
    found = direct.unionByName(slip).withColumn("method", F.get(F.array(*[F.lit(m) for m in LINK_STEPS]), F.col("step")))
    best = found.groupBy("reason_id").agg(F.min_by(F.struct("method", "n", "fact_id"), "step").alias("b"))
    j = reasons.select("reason_id").join(best, "reason_id", "left")
    status = first_true([(F.col("b").isNull(), "unresolved"), (F.col("b.n") > 1, "ambiguous"), (F.col("b.fact_id").isNotNull(), "resolved")], "model_only")
    return j.select("reason_id", F.when(status == "resolved", F.col("b.fact_id")).alias("fact_id"), F.col("b.method").alias("method"), status.alias("status"))
