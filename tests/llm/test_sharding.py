import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from clewline.llm import sharding as s

SCHEMA = "doc_id bigint, text string"


def spread(runs, n):
    """Shard of each rank."""
    bounds = [r[0] for r in runs] + [n]
    return [shard for (low, shard), high in zip(runs, bounds[1:]) for _ in range(high - low)]


def one_by_one(sizes, capacity, shards=None):
    """Best-fit-decreasing, item by item, over a plain list of shards."""
    room, out = [capacity] * (shards or 0), []
    for size in sizes:
        fits = [(r, k) for k, r in enumerate(room) if r >= size]
        if not fits and shards is not None:
            return None
        if not fits:
            room.append(max(capacity, size))
            fits = [(room[-1], len(room) - 1)]
        k = min(fits)[1]
        room[k] -= size
        out.append(k)
    return out


def classes(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=80), st.integers(1, 100), st.sampled_from([None, 1, 3, 9]))
def test_plan_equals_packing_one_by_one(sizes, capacity, shards):
    plan = s.best_fit(classes(sizes), capacity, shards)
    want = one_by_one(sorted(sizes, reverse=True), capacity, shards)
    assert (plan and spread(plan[0], len(sizes))) == (want if plan else None)
    if plan and shards is None:
        assert plan[1] == len(set(want))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=120), st.data())
def test_tree(keys, data):
    tree, held = None, []

    def depth(t):
        if t is None:
            return 0
        a, b = depth(t[2]), depth(t[3])
        assert abs(a - b) <= 1 and t[1] == 1 + max(a, b)
        return t[1]

    for k in keys:
        if (k,) in held and data.draw(st.booleans()):
            tree = s.tree_without(tree, (k,))
            held.remove((k,))
        elif (k,) not in held:
            tree = s.tree_with(tree, (k,))
            held.append((k,))
        depth(tree)
        assert s.tree_at_least(tree, (25,)) == min((h for h in held if h >= (25,)), default=None)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=150), st.integers(1, 12))
def test_equal_shards(sizes, shards):
    ordered = sorted(sizes, reverse=True)
    got = spread(s.equal_shards(classes(sizes), shards), len(sizes))
    filled = Counter()
    for size, shard in zip(ordered, got):
        filled[shard] += size
    assert len(got) == len(sizes) and set(got) <= set(range(shards))
    # No plan can stay below the largest item or an even share; best-fit-decreasing stays within the usual 4/3 of that.
    least = max(ordered[0], -(-sum(sizes) // shards), *(ordered[k * shards] + ordered[k * shards - 1] for k in range(1, 2) if len(ordered) > k * shards))
    assert max(filled.values()) <= 4 / 3 * least + 1


def hold(rows, got, shards=None):
    texts = dict(rows)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    shard_of, slots, filled = {}, defaultdict(list), Counter()
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert shard_of.setdefault(raw, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        filled[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert shards is None or set(filled) <= set(range(shards))
    return filled


def test_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = s.op11(spark, folder).collect()
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    filled, mass = hold(rows, got, s.SHARDS), Counter()
    for _, t in rows:
        mass[t or ""] += len((t or "").encode()) + 16
    even = sum(mass.values()) / s.SHARDS
    assert len(filled) == s.SHARDS and max(filled.values()) <= max(1.01 * even, *mass.values())
    # What Spark placed is what packing groups one by one gives for the capacity found.
    exact = sorted(mass.values(), reverse=True)
    ranks = spread(s.equal_shards(classes([-(-m // (w := 1 << max(0, m.bit_length() - s.CLASS_BITS))) * w for m in exact]), s.SHARDS), len(exact))
    planned = Counter()
    for m, shard in zip(exact, ranks):
        planned[shard] += m
    assert all(abs(planned[k] - filled[k]) <= 0.01 * even for k in planned)


def test_hot_group_and_odd_texts(frame):
    rows = [(k, "the same text") for k in range(700)] + [(1000 + k, f"{k} " * (1 + k % 37)) for k in range(900)] + [(5000, None), (5001, ""), (5002, "é😀" * 400_000)]
    filled = hold(rows, s.shard_documents(frame(rows, SCHEMA), shards=6).collect(), 6)
    rest = sorted(filled.values())[:-2]  # the long text and the copies have a shard of their own
    assert len(filled) == 6 and max(rest) - min(rest) < 0.02 * max(rest)


def test_capacity(frame):
    rows = [(k, "x" * (20 + 7 * k % 90)) for k in range(400)] + [(999, "long " * 200)]
    got = s.shard_documents(frame(rows, SCHEMA), shards=None, capacity=400).collect()
    filled, mass = hold(rows, got), Counter()
    for _, t in rows:
        mass[t] += len(t) + 16
    assert len(filled) == len(set(one_by_one(sorted(mass.values(), reverse=True), 400)))
    over = {k for k, v in filled.items() if v > 400}
    assert all(len({r.size for r in got if r.shard == k}) == 1 for k in over)


def test_size_class(spark):
    sizes = [0, 1, 16, 4095, 4096, 4097, 8193, 10**9 + 7, 2**40 + 1]
    got = spark.createDataFrame([(x,) for x in sizes], "n bigint").select("n", s.size_class(F.col("n")).alias("c")).collect()
    for r in got:
        step = 1 << max(0, r.n.bit_length() - s.CLASS_BITS)
        assert r.c == -(-r.n // step) * step and 0 <= r.c - r.n <= r.n / 2048


def test_null_and_repeated_ids_empty_table_other_columns(frame):
    df = frame([(1, "a", "x"), (1, "a", "y"), (None, "b", "z"), (None, None, None)], SCHEMA + ", shard string").withColumn("key", F.lit(0)).withColumn("size", F.lit("s"))
    got = s.shard_documents(df, shards=3).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == [("1", 17), ("1", 17), ("None", 16), ("None", 17)]
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    assert s.shard_documents(df.where("false"), shards=3).collect() == []
    with pytest.raises(ValueError):
        s.shard_documents(df, shards=3, capacity=5)
