import numpy as np
from pyspark.sql import functions as F

from clewline.llm import quality_model as m

FOLDER = "/root/testdata/sf0.01"


def test_held_out_grades(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = m.OrdinalModel.fit(docs, labels.where("doc_id % 3 > 0"), m.label_grade(), 3, fit_rows=2000)
    assert (np.diff(model.thresholds) > 0).all()
    got = docs.select("doc_id", m.grade_texts(F.col("text"), model, spark).alias("g")).join(labels.where("doc_id % 3 = 0").withColumn("grade", m.label_grade()), "doc_id")
    rows = got.select("quality", "toxic", "grade", "g.*").collect()
    kept = lambda want: np.mean([r.tail_probability >= 0.5 for r in rows if want(r)])
    assert len(rows) > 1000
    assert kept(lambda r: r.grade == 2) > 0.98 and kept(lambda r: r.quality == 0) < 0.1
    # Two fifths of the toxic labels lie on texts without any of the words that mark the others.
    assert kept(lambda r: r.toxic == 1) < 0.5
    mean = {k: np.mean([r.expected_grade for r in rows if r.grade == k]) for k in (0, 1, 2)}
    assert mean[0] < mean[1] < mean[2]
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_learns_order():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 200, 20)).astype(np.int32) for _ in range(1500)]
    true = np.array([sum(x < 40 for x in r) - sum(x > 160 for x in r) for r in rows])
    grades = np.digitize(true, [-1, 2])
    model = m.OrdinalModel.learn(rows, grades, 3, penalty=0.01)
    scores = np.array([model.weights[r].sum() for r in rows])
    assert (np.digitize(scores, model.thresholds) == grades).mean() > 0.9


def test_query(spark):
    rows = m.op10(spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.kept == (r.tail_probability >= m.LEAST_CHANCE) for r in rows)


def test_edge_rows(spark, frame):
    docs = frame([(1, None), (None, ""), (2, "a " * 40_000), (2, "a " * 40_000), (3, "b!! C$$ " * 20)], "doc_id bigint, text string").withColumn("g", F.lit(1))
    for labels in ([], [(1, 1, 0), (2, None, 0), (None, 1, 1)], [(2, 1, 0), (2, 1, 0), (3, 0, 1)]):
        marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
        model = m.OrdinalModel.fit(docs, marks, m.label_grade(), 3)
        got = docs.withColumn("x", m.grade_texts(F.col("text"), model, spark)).collect()
        assert len(got) == 5 and all(np.isfinite(r.x.expected_grade) and r.g == 1 for r in got)
    assert docs.where("false").select(m.grade_texts(F.col("text"), model, spark)).collect() == []


def test_bound_on_features(frame):
    docs = frame([(k, " ".join(f"w{k}x{n}" for n in range(50))) for k in range(40)], "doc_id bigint, text string")
    marks = frame([(k, k % 2, 0) for k in range(40)], "doc_id bigint, quality int, toxic int")
    m.OrdinalModel.fit(docs, marks, m.label_grade(), 3, fit_rows=10, fit_features=200)


def test_same_model_from_any_partitions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(400).collect()
    marks = spark.createDataFrame([(r.doc_id, k % 3 > 0, k % 5 == 0) for k, r in enumerate(docs)], "doc_id bigint, quality boolean, toxic boolean").selectExpr("doc_id", "cast(quality as int) quality", "cast(toxic as int) toxic")
    fits = [m.OrdinalModel.fit(spark.createDataFrame(docs).repartition(n), marks.repartition(n), m.label_grade(), 3, fit_rows=300, fit_features=9000) for n in (1, 7, 13)]
    assert np.abs(fits[0].weights).sum() > 0
    assert all((f.weights == fits[0].weights).all() and (f.thresholds == fits[0].thresholds).all() for f in fits)


def test_every_given_document_by_a_plain_scorer(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = m.OrdinalModel.fit(docs, labels, m.label_grade(), 3, fit_rows=150)
    for r in docs.select("text", m.grade_texts(F.col("text"), model, spark).alias("g")).collect():
        # Features are the same set that fitting reads; each counts once.
        score = sum(float(model.weights[b]) for b in set(m.features(r.text).tolist()))
        chances = [1 / (1 + np.exp(c - score)) for c in model.thresholds]
        assert abs(r.g.expected_grade - sum(chances)) < 1e-6 and abs(r.g.tail_probability - chances[-1]) < 1e-6


def test_slope_by_differences(monkeypatch):
    """The gradient of the likelihood against differences of the likelihood."""
    held = {}
    monkeypatch.setattr(m, "minimise", lambda loss, x, rounds, **more: held.update(loss=loss, x=x) or x)
    rng = np.random.default_rng(8)
    rows = [np.unique(rng.integers(0, 30, 8)).astype(np.int32) for _ in range(90)]
    m.OrdinalModel.learn(rows, rng.integers(0, 4, 90), 4, least_rows=1)
    x = held["x"] + rng.normal(size=len(held["x"])) * 0.3
    slope = held["loss"](x)[1]
    for k in range(len(x)):
        step = np.zeros_like(x)
        step[k] = 1e-5
        assert abs((held["loss"](x + step)[0] - held["loss"](x - step)[0]) / 2e-5 - slope[k]) < 1e-4 * max(1, abs(slope[k]))
