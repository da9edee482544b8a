import collections
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from clewline.llm import jaccard_join, language, packing, quality_rules

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage on what the one before kept, against a plain account of what it must keep."""
    docs = given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if k < 3:
            assert out.columns == given.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r[0] for r in docs.select("doc_id").collect()}
    texts = {r[0]: r[1] for r in given.select("doc_id", "text").collect()}
    with_letter = {i for i, t in texts.items() if language.LETTERS.search(t or "")}
    assert kept["language_id"] <= with_letter and len(kept["language_id"]) >= 0.99 * len(with_letter)

    def base_ok(t):
        n = dict(zip(quality_rules.COUNTS, quality_rules.count_text(t)))
        return not (n["n_words"] < 50 or 100 * n["n_repeat_words"] > 50 * n["n_words"])

    assert kept["quality_rules"] <= {i for i in kept["language_id"] if base_ok(texts[i])}
    sets = {i: set(jaccard_join.shingles(texts[i]).tolist()) for i in kept["quality_rules"]}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b]) if a < b else 0
            if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert kept["jaccard_join"] == {root(i) for i in sets}
    assert kept["packing"] == kept["jaccard_join"]


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, __language string, language string, stats int, __key string, kept int"


def odd(k, text, lang="en"):
    return k, text, lang, "s", len(text or ""), "mine", "own", 5, "key", 6


def test_language_stage_decides(spark, tmp_path):
    """Planted scrambled and foreign texts go, under one in a hundred of the others; the columns stay what they were."""
    given = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    draw = random.Random(5)
    planted = [(-k - 1, " ".join("".join(draw.choice("bcdfghjklmnpqrstvwxz") for _ in range(draw.randint(3, 8))) for _ in range(60)) if k % 2 else "Съешь ещё этих мягких булок " * (3 + k), None, "x", 9) for k in range(60)]
    docs = given.unionByName(spark.createDataFrame(planted, given.schema)).withColumn("__language", F.lit("mine")).withColumn("language", F.lit(1))
    kept = corpus_pipeline.identify_language(spark, docs, FOLDER)
    assert kept.columns == docs.columns and kept.where("__language <> 'mine' or language <> 1").isEmpty()
    assert kept.where("doc_id < 0").isEmpty()
    letters = given.where(F.col("text").rlike(r"\p{L}")).count()
    assert kept.count() > 0.99 * letters


def test_nothing_learned_keeps_all(spark, frame):
    docs = frame([odd(1, "some text", None), odd(2, "9", None), odd(3, None, None)], ODD)
    assert corpus_pipeline.identify_language(spark, docs, FOLDER).count() == 3


def test_stages_on_odd_rows(spark, frame, tmp_path):
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(9000))
    rows = [odd(1, None), odd(2, ""), odd(3, long), odd(3, long), odd(None, long + " more"), odd(5, "short text"), odd(6, "5 6"), odd(7, " ".join(f"w{k}" for k in range(60)), None)]
    frame([(3, 1, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for part in (rows, []):
        docs = frame(rows, ODD).limit(len(part)) if part else frame(rows, ODD).where("false")
        counts = []
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
                assert all(r["__language"] == "mine" and r.stats == 5 and r["__key"] == "key" and r.kept == 6 for r in out.collect())
            counts.append(out.count())
            docs = out if name == "packing" else spark.createDataFrame(out.collect(), out.schema)
        assert counts[-1] > 0 if part else counts == [0, 0, 0, 0]


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
    rows = names["pipeline"](spark, FOLDER).collect()
    filled = collections.Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert sum(n < packing.WINDOW for n in filled.values()) <= 1 and max(filled.values()) == packing.WINDOW
