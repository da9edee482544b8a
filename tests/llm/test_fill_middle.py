import hashlib
import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from clewline.llm import fill_middle as m

SCHEMA = "doc_id bigint, text string"


def plain(doc_id, text, fim_rate=100, spm_rate=50):
    """The contract, word by word."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, mid, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(mid), f"<S>{s}<P>{p}<M>{mid}"
    return n, "psm", len(p), len(mid), f"<P>{p}<S>{s}<M>{mid}"


def same(df, rows, **rates):
    out = m.fill_in_middle(df, **rates).withColumn("back", m.restore(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, *r[1:6]) for r in out), key=key) == sorted(((i, *plain(i, t, **rates)) for i, t in rows), key=key)
    assert sorted(r.back for r in out) == sorted(t or "" for _, t in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=900), st.data())
def test_skip_list_places(widths, data):
    units = m.SkipList(np.array(widths, dtype=np.int64))
    for rank in {0, len(widths), data.draw(st.integers(0, len(widths)))}:
        assert units.place(rank) == sum(widths[:rank])


@given(st.text("a\né😀\r ", max_size=40))
def test_units_are_lines(text):
    found = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert m.SkipList.of(text).lanes[0][1].tolist() == [len(u) for u in found]


def test_descent_is_short():
    units = m.SkipList(np.ones(100_000, dtype=np.int64))
    assert len(units.lanes) == 5 and len(units.lanes[-1][0]) <= m.FAN and units.place(99_999) == 99_999


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    same(spark.createDataFrame(rows, SCHEMA), rows)
    got = {r.doc_id: r for r in m.op12(spark, folder).collect()}
    for i, t in rows:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[i].output_sha256, got[i].restored_sha256) == (sha(plain(i, t)[4]), sha(t or ""))


ODD = [None, "", "\n", "\n\n\n", "no break", "a\nb", "a\r\nb\n", "é😀\nü\n" * 3, "x <M> y\nz", "<P>", "< P>\n<s>\n", " a\x0bb\n", "line\n" * 50_000, "w" * 2_000_000 + "\nend"]


def test_odd_texts(frame):
    rows = [(k, t) for k in (0, 17, 10**15, -5) for t in ODD] + [(None, "a\nb\nc"), (17, "same\nid"), (17, "same\nid")]
    same(frame(rows, SCHEMA), rows)


def test_rates(frame):
    rows = [(k, "a\nb\nc\n") for k in range(300)]
    same(frame(rows, SCHEMA), rows, fim_rate=40, spm_rate=20)
    forms = {r[0]: r[1] for r in m.fill_in_middle(frame(rows, SCHEMA), fim_rate=40, spm_rate=20).groupBy("form").count().collect()}
    assert forms["plain"] > forms["psm"] > forms["spm"] > 0


def test_empty_table_and_clashing_columns(frame):
    df = frame([(1, "a\nb", "x", 5)], SCHEMA + ", form string, n int").withColumn("cut", F.lit(3)).withColumn("h3", F.lit("h"))
    assert tuple(m.fill_in_middle(df).first()) == (1, *plain(1, "a\nb"))
    assert m.digest(m.fill_in_middle(df.where("false"))).collect() == []
