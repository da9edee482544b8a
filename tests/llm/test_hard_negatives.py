import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from clewline.llm import hard_negatives as h

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """The contract over plain rows (vec_id, embedding, label), in Python's own whole numbers."""
    sound = []
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        if not q or len(q) * max(map(abs, q)) ** 2 < 2**62:
            sound.append((i, q, lab))
    out = []
    for at, (i, q, lab) in enumerate(sound):
        if not is_anchor(i):
            continue
        others = sorted((-sum(a * b for a, b in zip(q, w)), j, m) for k, (j, w, m) in enumerate(sound) if k != at and len(w) == len(q))
        for s, j, _ in [o for o in others if o[2] == lab][:positives]:
            near = [o for o in others if o[2] != lab and low * -s <= 100 * -o[0] <= high * -s][:negatives]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(near)]
    return sorted(out)


def found(df, is_anchor, **more):
    return sorted(map(tuple, h.hard_negatives(df, is_anchor, **more).collect()))


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(h, "TILE", 40)
    monkeypatch.setattr(h, "STRIP", 7)


def vectors(n, width, seed, spread=1.0, centres=6):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, width))
    return [(k, [float(np.float32(x)) for x in middle[k % centres] + spread * draw.normal(size=width)], int(draw.integers(0, 4))) for k in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 6), st.integers(1, 9), st.integers(2, 5), st.integers(0, 10**6))
def test_tree_boxes_hold_their_rows(n, width, leaf, fan, seed):
    points = np.random.default_rng(seed).integers(-9, 9, size=(n, width)).astype(float)
    order = h.str_order(points, leaf)
    assert sorted(order.tolist()) == list(range(n))
    tree = h.RTree(points[order], leaf, fan)
    assert len(tree.levels[-1][0]) <= fan
    anchors = np.random.default_rng(seed + 1).integers(-9, 9, size=(3, width)).astype(float)
    scores = tree.points @ anchors.T
    for level, (least, most) in enumerate(tree.intervals(anchors)):
        span = leaf * fan**level
        for k in range(least.shape[1]):
            inside = scores[k * span : (k + 1) * span]
            assert (inside >= least[:, k]).all() and (inside <= most[:, k]).all()


def test_str_sorts_and_tiles_by_coordinate():
    grid = np.array([(x, y) for x in range(8) for y in range(8)], dtype=float)[np.random.default_rng(3).permutation(64)]
    points = grid[h.str_order(grid, 4)]
    areas = [np.prod(points[k : k + 4].max(axis=0) - points[k : k + 4].min(axis=0) + 1) for k in range(0, 64, 4)]
    assert areas == [4] * 16  # sixteen squares of two by two


def test_queue_leaves_boxes_out():
    draw = np.random.default_rng(5)
    points = np.floor(256 * np.concatenate([c + 0.02 * draw.normal(size=(128, 8)) for c in draw.normal(size=(64, 8))]))
    tree = h.RTree(points[h.str_order(points)])
    seen = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    plain = tree.points
    bounds = [(a[0], b[0]) for a, b in tree.intervals(plain[:1])]
    tree.points = plain.view(Counted)
    scores = plain @ plain[0]
    for low, high in ((h.NO_LOW, h.NO_HIGH), (0.3 * scores.max(), 0.9 * scores.max())):
        seen.clear()
        kept = h.Kept(low, high, 10, h.NO_LOW, np.arange(len(plain)))
        tree.search(plain[0], bounds, np.ones(len(plain), dtype=bool), [kept])
        inside = [(-s, k) for k, s in enumerate(scores.tolist()) if low <= s <= high]
        assert [(b[0], b[1]) for b in kept.best] == sorted(inside)[:10]
        assert sum(seen) < len(plain) / 3


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_many_tiles(spark, small_tiles, spread):
    rows = vectors(600, 7, 11, spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df, F.col("vec_id") % 20 == 0) == brute(rows, lambda i: i % 20 == 0)


def test_ties_and_repeated_rows(spark, small_tiles):
    draw = random.Random(2)
    rows = [(draw.randrange(60), [draw.choice([0.0, 0.5, -0.5, 1.0]) for _ in range(3)], draw.randrange(2)) for _ in range(260)]
    rows += [(7, [0.5, 0.5, 0.5], 1)] * 150  # one row a third of all
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df, F.col("vec_id") % 3 == 0) == brute(rows, lambda i: i % 3 == 0)


def test_odd_rows(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (None, [1.0, 1.0], 2), (8, [1.0, 1.0], None),
            (9, [], 1), (10, [], 2), (11, [1.0], 2), (12, [0.0, 0.0], 2), (13, [-1.0, -1.0], 1), (14, [0.7, 0.6], 2), (15, [3e38, 1.0], 2), (16, [1e5, 2e5], 1), (17, [3e4, 2e4], 2), (18, [0.001, -0.001], 3)]
    for anchors in (lambda i: i % 1 == 0, lambda i: i in (0, 9)):
        ids = [i for i in range(19) if anchors(i)]
        assert found(frame(rows, SCHEMA), F.col("vec_id").isin(ids)) == brute(rows, anchors)


def test_sums_beyond_doubles(spark, small_tiles):
    draw = np.random.default_rng(4)
    rows = [(k, [float(np.float32(x)) for x in draw.normal(size=3) * 10**5], int(k % 3)) for k in range(120)]
    assert found(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") < 12) == brute(rows, lambda i: i < 12)


def test_other_numbers(spark):
    rows = vectors(200, 4, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, F.col("vec_id") < 9, positives=2, negatives=3, low=50, high=120) == brute(rows, lambda i: i < 9, 2, 3, 50, 120)


def test_empty_table_and_clashing_columns(frame):
    df = frame([(0, [1.0], 1, 5), (1, [1.0], 1, 6), (2, [0.5], 2, 7)], SCHEMA + ", row int").withColumn("values", F.lit(1)).withColumn("anchor", F.lit("x")).withColumn("tile", F.lit(2))
    assert found(df, F.col("vec_id") == 0) == [(0, 1, 1, 2, 65536, 32768)]
    assert found(df, F.col("vec_id") == 77) == [] and found(df.where("false"), F.lit(True)) == []
    assert found(df.withColumn("label", F.lit(None).cast("int")), F.lit(True)) == []
