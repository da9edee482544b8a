import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clewline.llm import jaccard_join as j
from clewline.llm.components import components

SCHEMA = "doc_id bigint, text string"


def shingle_set(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Rows by position: links and smallest id of the class."""
    sets = [shingle_set(t) for _, t in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
            n[a] += 1
            n[b] += 1
            parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(rows[k][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return [(rows[k][0], least[root(k)], n[k]) for k in range(len(rows))], len(groups)


def compare(frame, rows):
    got = j.similar_groups(frame(rows, SCHEMA)).collect()
    want, groups = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2])
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == groups
    assert all(r.doc_id == r.class_id for r in got if r.kept)


def edited(rnd, words, share):
    return " ".join(w if rnd.random() > share else f"n{rnd.randint(0, 9**6)}" for w in words)


def test_families_of_copies(frame):
    rnd = random.Random(4)
    rows = []
    for family in range(12):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice([8, 40, 300]))]
        for k in range(rnd.randint(1, 12)):
            rows.append((len(rows), edited(rnd, words, rnd.choice([0, 0.01, 0.03, 0.06]))))
    compare(frame, rows)


def test_large_dense_group_is_tiled(frame, monkeypatch):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    rows = [(k, edited(rnd, words, 0.02)) for k in range(500)]
    monkeypatch.setattr(j, "LEAF", 40)
    monkeypatch.setattr(j, "TILE", 64)
    got = {r.doc_id: (r.n_links, r.class_id) for r in j.similar_groups(frame(rows, SCHEMA)).collect()}
    want = {i: (n, c) for i, c, n in brute(rows)[0]}
    missing = sum(want[i][0] - got[i][0] for i in want)
    assert all(got[i][0] <= want[i][0] and got[i][1] == want[i][1] for i in want)
    assert missing <= 0.001 * sum(n for n, _ in want.values())


def test_edge_rows(frame):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one  two"), (6, "two one"), (7, "a b c d e"), (None, "a b c d e"), (8, "a b c d e"), (8, "a b c d e"), (None, None), (9, "x " * 5000), (10, "x " * 6000)]
    compare(frame, rows)


def test_empty_table(frame):
    df = frame([(1, "a")], SCHEMA).where("false")
    assert j.similar_groups(df).collect() == [] and j.keep_one(df).collect() == []


def test_keep_one(frame):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "q", "z"), (3, "q", "z"), (3, "q", "v"), (4, "", "e"), (4, "", "e"), (None, "only this text here now", None)]
    got = j.keep_one(frame(rows, SCHEMA + ", key string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [(-1, "only this text here now"), (1, "a b c d e f"), (3, "q"), (4, ""), (4, "")]
    assert got[0].__fields__ == ["doc_id", "text", "key"]


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (c, n) for i, c, n in brute(rows)[0]}
    assert {r.doc_id: (r.class_id, r.n_links) for r in j.op3(spark, folder).collect()} == want


def test_recall_bound():
    assert j.met_within(1, 0.8) == pytest.approx(0.75 * 0.8 + 0.25 * 0.96)
    for depth in (1, 4, 9, 30):
        r = j.runs_needed(depth, 0.8, 0.999)
        assert 1 - (1 - j.met_within(depth, 0.8)) ** r >= 0.999


def test_shared_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (0, 1, 50, 6000, 8000)]
    sets = [s for s in sets if len(s)]
    got = j.shared_counts(sets)
    for a in range(len(sets)):
        for b in range(len(sets)):
            if a != b:
                assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))


def test_components(frame):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, 90), (90, 80), (70, 70), (None, 3), (200, 150), (151, 150), (152, 151)]
    got = {r.vertex: r.component for r in components(frame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 80, 90: 80, 80: 80, 70: 70, 200: 150, 150: 150, 151: 150, 152: 150}
    assert components(frame(links, "a bigint, b bigint").where("false")).collect() == []


def test_rounds_reach_the_recall_over_agreeing_places():
    rng = np.random.default_rng(1)
    for depth in (1, 6, 10, 20, 30, 45):
        rounds = [j.FIRST_RUNS]
        while more := j.next_round(depth, 0.8, 0.999, rounds):
            rounds.append(more)
        assert sum(rounds) < 1 << j.RUN_BITS
        agree = rng.binomial(j.PLACES, 0.8, (len(rounds), 200_000)) / j.PLACES
        met = j.met_within(depth, 0.8, agree)
        assert np.prod((1 - met) ** np.array(rounds)[:, None], axis=0).mean() <= 0.00105


def test_run_field():
    last = (1 << j.RUN_BITS) - 1
    start = np.array([1 << (63 - j.RUN_BITS), last << (63 - j.RUN_BITS)])
    names = j.child(start, np.array([3, 3]), np.array([7, 7]))
    assert (names >> (63 - j.RUN_BITS)).tolist() == [1, last] and (names != start).all()


def test_recall_in_a_deep_group(frame, monkeypatch):
    """Pairs just over the threshold, inside a group whose trees go over ten splits deep."""
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(400)]
    rows, pairs = [], 0
    fresh = itertools.count()

    def change(words, k, step):
        out = list(words)
        for at in rnd.sample(range(len(words) // step), k):
            out[at * step + 2] = f"n{next(fresh)}"
        return out

    while pairs < 1000:
        one = change(base, 16, 8)
        two = change(one, 8, 9)
        a, b = shingle_set(" ".join(one)), shingle_set(" ".join(two))
        if 0.8 <= len(a & b) / len(a | b) < 0.825:
            rows += [(2 * pairs, " ".join(one)), (2 * pairs + 1, " ".join(two))]
            pairs += 1
    depths = []
    leaves = j._leaves
    monkeypatch.setattr(j, "LEAF", 8)
    monkeypatch.setattr(j, "_leaves", lambda *a: depths.append((got := leaves(*a))[1]) or got)
    got = {r.doc_id: r.class_id for r in j.similar_groups(frame(rows, SCHEMA)).collect()}
    assert max(depths) >= 10
    assert sum(got[2 * k] != got[2 * k + 1] for k in range(pairs)) <= 2
