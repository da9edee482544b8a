import math
import random

from pyspark.sql import functions as F

from clewline.llm import language as l

SCHEMA = "doc_id bigint, text string, lang string"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = l.op9(spark, folder).join(docs, "doc_id")
    assert got.count() == docs.count()
    right, n = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.97
    assert got.where("score < 0 or score > 1 or score is null or lang_pred is null").isEmpty()


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(50).select("id", l.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_label_of_held_out_rows_is_not_read(frame):
    rows = [(k, "alpha beta gamma" if k % 2 else "uno dos tres", "xx" if k % 2 else "yy") for k in range(100)]
    train = frame(rows, SCHEMA).where(~l.held_out(F.col("doc_id")))
    other = frame([(i, t, "zz") for i, t, _ in rows], SCHEMA).where(l.held_out(F.col("doc_id"))).unionByName(train)
    a = l.LanguageModel.fit(train)
    b = l.LanguageModel.fit(other.where(~l.held_out(F.col("doc_id"))))
    assert a.langs == b.langs == ["xx", "yy"] and (a.weights == b.weights).all()


def test_edge_texts(spark, frame):
    train = frame([(k, "the cat sat on the mat", "en") for k in range(5)] + [(9 + k, "le chat est sur le lit", "fr") for k in range(5)] + [(30, None, "en"), (31, "x", None)], SCHEMA)
    model = l.LanguageModel.fit(train)
    texts = [None, "", " \n", "123 !!", "the", "chat,", "THE CAT", "the " * 20_000, "sat" * 20_000, "ж"]
    df = frame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("score", F.lit("kept")).withColumn("f", l.identify(F.col("text"), model, spark))
    got = {r.doc_id: r for r in df.collect()}
    assert [got[k].f.lang_pred for k in range(8)] == ["und"] * 4 + ["en", "fr", "en", "en"]
    assert [got[k].f.score for k in range(4)] == [0.0] * 4 and got[0].score == "kept"
    assert all(0 <= r.f.score <= 1 for r in got.values()) and got[9].f.lang_pred == "en"
    assert df.where("false").collect() == []


def test_no_training_rows(spark, frame):
    df = frame([(1, "text", None)], SCHEMA)
    model = l.LanguageModel.fit(df)
    assert df.select(l.identify(F.col("text"), model, spark).alias("f")).first().f.lang_pred == "und"


def test_model_size_is_bounded(frame):
    df = frame([(k, f"{chr(97 + k % 26) * 3} common words here", "en") for k in range(200)], SCHEMA)
    assert len(l.LanguageModel.fit(df, most_entries=40).weights) <= 40


def scored(model, text):
    """The method, word by word and without tables of what was met: known word, else the longest letter groups known."""
    words = l.LETTERS.findall((text or "").lower())
    if not words:
        return "und", 0.0, 0.0
    total, known = [0.0] * len(model.langs), 0
    for w in words:
        if w in model.tables[0]:
            known += 1
            rows = [model.tables[0][w]]
        else:
            rows = []
            for k in range(l.LONGEST_GROUP, 0, -1):
                rows = rows or [model.tables[k][g] for g in l.groups(w, k) if g in model.tables[k]]
        for j in range(len(total)):
            total[j] += sum(float(model.weights[r][j]) for r in rows) / max(1, len(rows))
    best = max(range(len(total)), key=lambda j: total[j])
    return model.langs[best], 1 / sum(math.exp((x - total[best]) / len(words)) for x in total), known / len(words)


def test_every_given_document_by_a_plain_scorer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = l.LanguageModel.fit(docs.where(~l.held_out(F.col("doc_id"))))
    for r in docs.select("text", l.identify(F.col("text"), model, spark).alias("f")).collect():
        lang, score, known = scored(model, r.text)
        assert r.f.lang_pred == lang and abs(r.f.score - score) < 1e-4 and abs(r.f.known - known) < 1e-9


def test_score_tells_foreign_from_own(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = l.LanguageModel.fit(docs.where(~l.held_out(F.col("doc_id"))))
    own = [model.predict(r[0])[1] for r in docs.where("n_chars > 300").select("text").limit(200).collect()]
    assert sorted(own)[2] > 0.6 and sorted(own)[100] < 0.9999
    assert model.predict("Съешь ещё этих мягких французских булок " * 9)[1] < 0.6


def test_fits(spark):
    """Scrambled and foreign text does not fit, given text does; without held-out documents everything with a letter fits."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = l.held_out(F.col("doc_id"))
    plain = l.LanguageModel.fit(docs.where(~held))
    model = plain.calibrated(docs.where(held))
    assert set(model.fitting) == set(model.langs)
    draw = random.Random(1)
    scrambled = " ".join("".join(draw.choice("bcdfghjklmnpqrstvwxyz") for _ in range(draw.randint(3, 9))) for _ in range(80))
    for text in (scrambled, "a" * 4 + " " + "aaaa " * 60, "Съешь ещё этих мягких французских булок да выпей чаю " * 5, "日本語の文章です。" * 30, "qwrt " * 100):
        assert not model.predict(text)[3] and plain.predict(text)[3]
    rows = docs.where("n_chars > 0").select(l.identify(F.col("text"), model, spark).alias("f")).where("f.lang_pred <> 'und'")
    assert rows.where("not f.fits").count() < 0.005 * rows.count()
    assert not model.predict("12 34")[3] and not model.predict(None)[3]


def test_totals_hold_rare_entries(frame):
    df = frame([(k, "common " * 3 + f"{chr(97 + k % 26)}{chr(97 + k // 26)}rare", "en") for k in range(60)], SCHEMA)
    model = l.LanguageModel.fit(df)
    # 180 of 240 words; the 60 met once are counted though they have no entry.
    assert abs(math.exp(model.weights[model.tables[0]["common"]][0]) - 180.5 / (240 + 0.5 * 62)) < 1e-4


def test_same_model_from_any_partitions(spark):
    rows = [(k % 70, f"word{chr(97 + k % 9)} and more {chr(97 + k % 7)}", ["en", "de", None][k % 3]) for k in range(300)]
    models = [l.LanguageModel.fit(spark.createDataFrame(rows, SCHEMA).repartition(n), fit_rows=30) for n in (1, 7, 13)]
    assert all(m.tables == models[0].tables and (m.weights == models[0].weights).all() for m in models)
