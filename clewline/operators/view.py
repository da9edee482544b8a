"""Evidence views: budgets, shared parts, accounting, selection and pointers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.logic import first_true


def shared_columns(rows: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Columns that hold one value in a whole group. Types count: text '0' is not number 0."""
    j = lambda c: F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"})
    agg = rows.groupBy(group).agg(*[F.struct(F.min(j(c)).alias("lo"), F.max(j(c)).alias("hi"), F.min(F.col(c).cast("string")).alias("v")).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col(c)["lo"] == F.col(c)["hi"]).alias("shared"), F.col(c)["v"].alias("v")) for c in cols])
    return agg.select(group, F.explode(pairs).alias("x")).select(
        group, "x.column_name", "x.shared", F.when(F.col("x.shared"), F.col("x.v")).alias("constant"))


def common_prefix(urls: DataFrame, group: str, col: str = "url", min_len: int = 20) -> DataFrame:
    """Longest common prefix per group: that of its smallest and largest string."""
    agg = urls.groupBy(group).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count("*").alias("n"))
    limit = F.least(F.length("lo"), F.length("hi"))
    same = F.size(F.filter(F.sequence(F.lit(0), limit), lambda k: F.expr("substring(lo, 1, 0)").isNotNull() & (F.substring(F.col("lo"), F.lit(1), k) == F.substring(F.col("hi"), F.lit(1), k)))) - 1
    return agg.withColumn("k", same).where(F.col("k") >= min_len).select(group, F.substring("lo", F.lit(1), F.col("k")).alias("prefix"), "n")


def repeated_literals(strings: DataFrame, col: str = "text", min_len: int = 24) -> DataFrame:
    """Long strings worth storing once: repeated, and cheaper as a reference."""
    d = strings.where(F.length(col) >= min_len).select(F.col(col).alias("literal"), F.sha2(col, 256).alias("h"))
    # Counting moves hashes only. Of a repeated text each task sends one copy: equal ones are put together before the shuffle.
    g = d.groupBy("h").agg(F.count("*").alias("n"), F.max(F.octet_length("literal")).alias("bytes")).where("n >= 2")
    g = g.withColumn("saved", (F.col("n") - 1) * F.col("bytes") - F.col("n") * 8).where("saved > 0").select("h", "n", "saved")
    wanted = g.select(F.col("h").alias("w"))
    texts = d.join(wanted, F.col("h") == F.col("w"), "left_semi").groupBy("h").agg(F.any_value("literal").alias("literal"))
    return texts.join(g, "h").select("literal", "n", "saved")


def url_prefix_dictionary(urls: DataFrame, col: str = "url", min_len: int = 24, min_n: int = 4) -> DataFrame:
    """Longest frequent ``/``-ended prefix of each distinct URL."""
    d = urls.groupBy(F.col(col).alias("url")).agg(F.count("*").alias("w"))
    cuts = F.transform(F.sequence(F.lit(1), F.size(F.split("url", "/")) - 1), lambda i: F.concat(F.array_join(F.slice(F.split("url", "/"), F.lit(1), i), "/"), F.lit("/")))
    x = d.where(F.col("url").contains("/")).select("url", "w", F.explode(cuts).alias("prefix")).where(F.length("prefix") >= min_len)
    known = x.groupBy("prefix").agg(F.sum("w").alias("n")).where(F.col("n") >= min_n)
    return x.join(known, "prefix").groupBy("url").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def source_accounting(source: DataFrame, kept: DataFrame, omitted: DataFrame) -> DataFrame:
    """Per view: source rows against kept + omitted. The checksum is order-free, so nothing is collected."""
    tag = lambda df, n: df.select("view", "item_id", *[F.lit(1 if n == k else 0).alias(k) for k in ("s", "k", "o")])
    x = tag(source, "s").unionByName(tag(kept, "k")).unionByName(tag(omitted, "o"))
    ids = x.groupBy("view", "item_id").agg(F.sum("s").alias("s"), F.sum("k").alias("k"), F.sum("o").alias("o"))
    return ids.groupBy("view").agg(
        F.sum("s").alias("source_rows"), F.sum("k").alias("kept_rows"), F.sum("o").alias("omitted_rows"),
        F.count_if((F.col("s") != 1) | (F.col("k") + F.col("o") != 1)).alias("bad_items")).withColumn("ok", F.col("bad_items") == 0)


def kept_omitted_disjoint(source: DataFrame, kept: DataFrame, omitted: DataFrame) -> DataFrame:
    both = kept.select("item_id").intersect(omitted.select("item_id")).withColumn("problem", F.lit("kept_and_omitted"))
    placed = kept.select("item_id").union(omitted.select("item_id"))
    lost = source.select("item_id").subtract(placed).withColumn("problem", F.lit("not_placed"))
    extra = placed.subtract(source.select("item_id")).withColumn("problem", F.lit("unknown_item"))
    return both.unionByName(lost).unionByName(extra)


def evidence_selection(evidence: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """Reason to leave a row out; rows without one are kept. Kept + omitted is the source by construction."""
    return evidence.withColumn("omit_reason", first_true(rules)).withColumn("kept", F.col("omit_reason").isNull())


def context_budget(views: DataFrame, view: str, cols: list[str], max_bytes: int) -> DataFrame:
    body = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}))
    g = views.groupBy(view).agg(F.sum(body).alias("bytes"))
    return g.withColumn("over", F.col("bytes") > max_bytes)


def citation_alias(rows: DataFrame, reserved: DataFrame, group: str) -> DataFrame:
    """Sequential alias per kind prefix, skipping reserved ones.

    Ranks come from the row order inside one document. The i-th reserved number (ascending) pushes every rank from its cut
    (the number less i - 1) on one up, so ranks and cuts are merged in order and a running sum counts the cuts passed.
    """
    own = [group, "kind"]
    r = rows.select(*own, "item_id", F.row_number().over(Window.partitionBy(*own).orderBy("item_id")).cast("bigint").alias("at"), F.lit(0).alias("cut"))
    taken = reserved.select(*own, F.col("number").cast("bigint").alias("t")).distinct()
    cuts = taken.select(*own, (F.col("t") - F.row_number().over(Window.partitionBy(*own).orderBy("t")) + 1).alias("at"), F.lit(1).alias("cut"))
    passed = F.sum("cut").over(Window.partitionBy(*own).orderBy("at", F.desc("cut")).rowsBetween(Window.unboundedPreceding, 0))
    j = r.unionByName(cuts, allowMissingColumns=True).withColumn("shift", passed).where("cut = 0")
    return j.select(group, "item_id", F.concat("kind", F.lit(":"), (F.col("at") + F.col("shift")).cast("string")).alias("alias"))


def absence_kinds(elements: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Why each empty field is empty. ``fields`` maps a column to what NULL means there."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNull(), F.lit(k)).when(F.col(f) == "", F.lit("observed_empty")).alias("absence")) for f, k in fields.items()])
    return elements.select(key, F.explode(rows).alias("x")).select(key, "x.*").where("absence IS NOT NULL")


def json_pointer(docs: DataFrame, pointer: str | Column, col: str = "body") -> DataFrame:
    """Value at a JSON pointer, one for all rows or a column; a present null or empty value differs from an absent one.

    ``problem`` names a text that is no JSON and a pointer that is none: one that neither is empty nor starts with a slash,
    or has a tilde that escapes nothing. Of an array only a number without leading zeros is a place; of an object any name
    is, also one of digits.
    """
    p = pointer if isinstance(pointer, Column) else F.lit(pointer)
    rows = docs.withColumns({"_v": F.try_parse_json(F.col(col)), "_p": p})
    rows = rows.withColumn("problem", first_true([
        (F.col("_v").isNull(), "invalid_json"), ((F.col("_p") != "") & ~F.col("_p").startswith("/"), "invalid_pointer"), (F.col("_p").rlike("~(?![01])"), "invalid_pointer")]))
    names = F.slice(F.split("_p", "/"), F.lit(2), F.greatest(F.size(F.split("_p", "/")) - 1, F.lit(0)))
    names = F.transform(names, lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))

    def step(at, name):
        members, items = F.try_variant_get(at, "$", "map<string,variant>"), F.try_variant_get(at, "$", "array<variant>")
        place = F.when(name.rlike("^(0|[1-9][0-9]{0,8})$"), name.cast("int"))
        return F.coalesce(members[name], F.get(items, place))

    got = F.when(F.col("problem").isNull(), F.aggregate(names, F.col("_v"), step))
    out = rows.withColumn("_got", got)
    return out.withColumns({"exists": F.when(F.col("problem").isNull(), F.col("_got").isNotNull()), "value": F.try_variant_get("_got", "$", "string")}).drop("_v", "_p", "_got")


def text_excerpt(texts: DataFrame, col: str = "text", limit: int = 16000, head: int = 12000, tail: int = 4000, marker: str = "\n...\n") -> DataFrame:
    t = F.col(col)
    long = F.length(t) > limit
    return texts.withColumns({
        "excerpt": F.when(long, F.concat(F.substring(t, 1, head), F.lit(marker), F.substring(t, -tail, tail))).otherwise(t),
        "omitted": F.when(long, F.length(t) - head - tail).otherwise(0)})


def embedded_image_refs(values: DataFrame, col: str = "value", min_chars: int = 300) -> DataFrame:
    """Inline image data replaced by media type, length and hash."""
    v = values.where(F.col(col).startswith("data:image/") & (F.length(col) > min_chars))
    return v.withColumns({"media_type": F.regexp_extract(col, r"^data:([^;,]+)", 1), "chars": F.length(col), "sha256": F.sha2(col, 256)})


def feed_overlap(feed: DataFrame) -> DataFrame:
    """URLs reported by both of two sources.

    Each URL is folded to its set of sources (as many as there are feeds), equal sets are
    counted first, and pairs come only from the distinct sets.
    """
    sets = feed.select("url", "source").distinct().groupBy("url").agg(F.array_sort(F.collect_set("source")).alias("s"))
    counted = sets.where(F.size("s") > 1).groupBy("s").agg(F.count("*").alias("n"))
    a = counted.select("s", "n", F.explode("s").alias("source_a"))
    b = a.select("n", "source_a", F.explode(F.filter("s", lambda x: x > F.col("source_a"))).alias("source_b"))
    return b.groupBy("source_a", "source_b").agg(F.sum("n").alias("urls"))
