"""the signal table takes every URL apart once, and counts before rows move."""
import pytest
from pyspark.sql import functions as F

from clewline import refdata as R
from clewline.functions import url as U
from clewline.operators import scripts as S, signals as G, transport as T


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_host_is_taken_out_of_its_url_once(spark):
    df = spark.createDataFrame([("https://A.example.com:8443/x",), ("http://0x7f.1/",), ("http://u@%65xample.org/",), (None,), ("http://300.1.1.1/",)], "url string")
    got = U.with_host(df, "url", "h")
    assert rows(got.select("h")) == sorted([("a.example.com",), ("127.0.0.1",), ("example.org",), (None,), ("300.1.1.1",)], key=repr)
    assert plan(got).count("([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://") == 1  # the pattern of a URL's parts


@pytest.fixture
def journeys(spark):
    j = spark.createDataFrame([(1, "https://bit.ly/a", None), (2, "https://x.example.com/", "https://y.example.com/"), (3, "http://q.net/", None), (3, "http://q.net/", None), (None, "https://bit.ly/n", None), (5, None, None)], "journey_id bigint, original_url string, final_url string")
    h = spark.createDataFrame([(1, 1, "https://bit.ly/a", "http://198.51.100.7/x"), (1, 2, "http://198.51.100.7/x", "https://s.example.org/"), (3, 0, "http://q.net/", "http://q.net/2"), (3, None, "http://q.net/2", None), (None, 1, "https://a.com/", "https://b.com/"), (9, 1, "https://a.com/", "https://b.com/"), (5, 1, "https://a.com/", "http://10.0.0.1/")], "journey_id bigint, hop_no int, source_url string, destination_url string")
    return j, h, R.suffix_index(R.table(spark, [("com", "icann"), ("ly", "icann"), ("org", "icann"), ("net", "icann")], "rule section")), R.table(spark, [("bit.ly",)], "domain")


def test_checks_of_journeys_share_split_urls(spark, journeys, tmp_path):
    j, h, index, short = journeys
    T.journey_urls(j, h, index).write.parquet(str(tmp_path / "urls"))
    urls = spark.read.parquet(str(tmp_path / "urls"))
    assert urls.count() == j.count() + h.count()
    checks = (lambda x: T.redirect_domain_change(j, x, index), lambda x: T.redirect_to_ip(j, x), lambda x: T.shortener_journey(j, x, index, short))
    for check in checks:
        assert rows(check(urls)) == rows(check(h))
        assert "suffix_key" not in plan(check(urls)) and "(?://" not in plan(check(urls))
    assert [r[:3] for r in rows(T.redirect_to_ip(j, urls)) if r[0] in (1, 5)] == [(1, True, "http://198.51.100.7/x"), (5, True, "http://10.0.0.1/")]


def test_findings_are_counted_before_they_move(spark):
    p = spark.createDataFrame([(1, "https://a.com/", "<p>", True), (2, "https://a.com/", "<p>", True)], "page_id bigint, url string, html string, source_complete boolean")
    statuses = spark.createDataFrame([(1, "s1", "parsed")], "page_id bigint, script_id string, status string")
    values = {s: (None, True, False)[k % 3] for k, s in enumerate(G.SIGNALS)}
    found = [G.finding(spark.createDataFrame([(1, v), (7, v), (None, v)], "page_id bigint, detected boolean"), s) for s, v in values.items() if s != "L2-H-09"]
    got = G.page_signals(p, found, statuses)
    assert "collect_list" not in plan(got)
    state = {(r.target_id, r.signal_id): (r.status, r.detected, r.error) for r in got.collect()}
    assert len(state) == 2 * len(G.SIGNALS)
    for s, v in values.items():
        lost = s == "L2-H-09"
        assert state[1, s] == (("error", None, "not_collected") if lost else ("evaluated", None if s in G.MEASURED else v, None))
    assert state[2, "L2-H-01"] == ("error", None, "not_collected") and state[2, "L3-H-03"] == ("not_applicable", None, None)
    with pytest.raises(Exception, match="two findings"):
        G.page_signals(p, [*found, found[0]], statuses).collect()


def test_arms_are_compared_by_counts(spark):
    arms = [(1, 1, "a", "x", "t"), (1, 1, "a", "y", "t"), (1, 1, "b", "y", "t"), (1, 1, "b", "x", "t"), (2, 1, "a", "x", "t"), (2, 1, "a", "x", "t"), (2, 1, "b", "x", "t"), (3, 1, None, "x", "t"), (3, 2, None, "x", None), (4, None, "a", None, "x"), (4, None, "b", "x", None), (5, 1, "a", "x", "t"), (5, 2, "b", "x", "t")]
    got = S.env_branching(spark.range(1, 7).toDF("page_id"), spark.createDataFrame(arms, "page_id bigint, branch_id int, arm string, behaviour string, target string"))
    assert rows(got) == [(1, False, 1), (2, True, 1), (3, False, 2), (4, False, 1), (5, True, 2), (6, False, 0)]
    assert "collect_list" not in plan(got)


def test_findings_are_worked_out_once(spark):
    p = spark.createDataFrame([(1, "https://a.com/", "<p>", True)], "page_id bigint, url string, html string, source_complete boolean")
    statuses = spark.createDataFrame([(1, "s1", "parsed")], "page_id bigint, script_id string, status string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def noted(x):
        seen.add(1)
        return x

    found = spark.createDataFrame([(1, True, 0.5)], "page_id bigint, detected boolean, age double").withColumn("detected", noted("detected"))
    got = G.page_signals(p, [G.finding(found, "L2-C-02"), G.finding(found, "L2-C-01", measured="age")], statuses)
    assert got.where("detected").count() == 1 and got.count() == len(G.SIGNALS)
    assert seen.value == 2
