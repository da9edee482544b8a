import re
from collections import Counter

import numpy as np
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from clewline.llm import quality_rules as q

FOLDER = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    inside = {k + d for k, w in enumerate(windows) if times[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@given(st.text(alphabet="ab c\n\t\x0b#*é\x85 ", max_size=120))
def test_counts(text):
    assert q.count_text(text)[:5] == brute(text)


def test_counts_of_special_texts():
    for text in (None, "", " \n ", "a b c a b c", "x " * 50_000, "l\nl\n\nl", "a\x1cb"):
        assert q.count_text(text)[:5] == brute(text)


def test_large_vocabulary_keys():
    places = np.array([0, 1, 2, 5, 0, 1, 2, 7])
    assert q.repeat_words(places, 8) == q.repeat_words(places, 3_000_000) == 6


def test_learned_list_separates():
    rng = np.random.default_rng(1)
    x, y = rng.random(3000), rng.random(3000)
    bad = (x > 0.8) & (y < 0.5) | (x < 0.1)
    rules = q.learn({"x": x, "y": y}, bad)
    hit = np.zeros(3000, dtype=bool)
    for r in rules:
        hit |= r.covers({"x": x, "y": y})
    assert (hit == bad).mean() > 0.98 and all(len(r.conditions) <= 3 for r in rules)


def test_nothing_to_learn():
    assert q.learn({"x": np.arange(10.0)}, np.zeros(10, dtype=bool)) == []
    assert q.learn({"x": np.zeros(0)}, np.zeros(0, dtype=bool)) == []


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rules = q.QualityRules.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    named = [str(r) for r in rules.rules]
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    rows = q.op2(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = dict(zip(q.COUNTS, q.count_text(texts[r.doc_id])))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        failed = n["n_words"] < 50 or 100 * n["n_repeat_words"] > 50 * n["n_words"]
        share = lambda a, b: n[a] / n[b] if n[b] else 0.0
        values = {"words": n["n_words"], "word_length": share("word_chars", "n_words"), "symbol_rate": share("n_symbols", "word_chars"), "dup_line_rate": share("n_dup_lines", "n_lines"),
                  "repeat_rate": share("n_repeat_words", "n_words"), "distinct_rate": share("n_distinct_words", "n_words"), "upper_rate": share("n_upper", "word_chars"),
                  "mark_rate": share("n_marks", "word_chars"), "digit_rate": share("n_digits", "word_chars"), "line_words": share("n_words", "n_lines")}
        hit = any(x.covers({k: np.array([v]) for k, v in values.items()})[0] for x in rules.rules)
        assert r.base_failed == failed and r.kept == (not failed and not hit), (r.doc_id, named)


def test_held_out_labels(spark):
    """Rules from half of the labelled documents judge the other half."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rules = q.QualityRules.fit(docs, labels.where("doc_id % 2 = 0"))
    judged = rules.judge(docs).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    right, n = judged.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.95


def test_edge_rows(frame):
    df = frame([(1, None), (None, ""), (2, "w " * 60), (2, "w " * 60)], "doc_id bigint, text string").withColumn("n_words", F.lit(7))
    rules = q.QualityRules.fit(df, frame([(None, 0), (9, None)], "doc_id bigint, quality int"))
    assert rules.rules == []
    got = rules.judge(df).collect()
    assert len(got) == 4 and not any(r.kept for r in got) and all(r.n_words == 7 for r in got)
    assert rules.judge(df.where("false")).collect() == []
