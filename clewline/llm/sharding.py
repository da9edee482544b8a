"""Shards of near equal size by best-fit-decreasing packing of indivisible groups.

Groups, largest first, go to the shard with the tightest room left that still takes them; a balanced tree over (room,
shard) finds it. What the order needs to know about groups is how many there are of each size class, so the packing is
planned over that table of bounded length: equal sizes follow one another, and a shard that is tightest for one of them
stays so until it is full. The plan says which ranks of the sorted groups go where; Spark sorts, ranks and places them.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window

from ..session import materialise
from .registry import query, table

SHARDS = 40
#: What a document takes beside its text.
OVERHEAD = 16
#: Leading bits of a group's size that the packing looks at, rounded up: exact below 4,096, a 2,048th part at most beyond.
#: A 64-bit size has at most 2^12 + 52 * 2^11 such classes, which bounds the table that the plan is made from.
CLASS_BITS = 12
#: Steps of the search for the least capacity.
SEARCH = 24
#: A group with this part of all rows or more is placed by broadcast; there are at most as many of them.
HOT_PART = 1024


# A tree node is (key, height, left, right); nodes are never changed. Heights of two branches differ by one at most.
def _node(key, left, right):
    return key, 1 + max(left[1] if left else 0, right[1] if right else 0), left, right


def _balanced(key, left, right):
    tilt = (left[1] if left else 0) - (right[1] if right else 0)
    if tilt > 1:
        k, _, a, b = left
        if (b[1] if b else 0) > (a[1] if a else 0):
            return _node(b[0], _node(k, a, b[2]), _node(key, b[3], right))
        return _node(k, a, _node(key, b, right))
    if tilt < -1:
        k, _, a, b = right
        if (a[1] if a else 0) > (b[1] if b else 0):
            return _node(a[0], _node(key, left, a[2]), _node(k, a[3], b))
        return _node(k, _node(key, left, a), b)
    return _node(key, left, right)


def tree_with(tree, key):
    if tree is None:
        return _node(key, None, None)
    k, _, left, right = tree
    return _balanced(k, tree_with(left, key), right) if key < k else _balanced(k, left, tree_with(right, key))


def tree_without(tree, key):
    k, _, left, right = tree
    if key < k:
        return _balanced(k, tree_without(left, key), right)
    if key > k:
        return _balanced(k, left, tree_without(right, key))
    if left is None or right is None:
        return left or right
    least = right
    while least[2]:
        least = least[2]
    return _balanced(least[0], left, tree_without(right, least[0]))


def tree_at_least(tree, key):
    """Smallest key that is not below ``key``, or None."""
    found = None
    while tree:
        if tree[0] >= key:
            found, tree = tree[0], tree[2]
        else:
            tree = tree[3]
    return found


def best_fit(classes: list[tuple[int, int]], capacity: int, shards: int | None = None, first: int = 0):
    """Runs (first rank, shard) over the items of ``classes`` ((size, count), largest first), and the number of shards.

    With ``shards`` all are open from the start and None says that they do not suffice; else a shard is opened when
    none has room. An item above the capacity has a shard of its own.
    """
    tree, opened, rank, runs = None, first, 0, []
    for _ in range(shards or 0):
        tree, opened = tree_with(tree, (capacity, opened)), opened + 1
    for size, count in classes:
        while count:
            spot = tree_at_least(tree, (size, -1))
            if spot:
                tree = tree_without(tree, spot)
            elif shards is not None:
                return None
            else:
                spot, opened = (max(capacity, size), opened), opened + 1
            room, shard = spot
            taken = min(count, room // size) if size else count
            if not runs or runs[-1][1] != shard:
                runs.append((rank, shard))
            rank, count, room = rank + taken, count - taken, room - taken * size
            tree = tree_with(tree, (room, shard))
    return runs, opened


def equal_shards(classes: list[tuple[int, int]], shards: int):
    """Runs that fill ``shards`` shards as evenly as best-fit-decreasing can: with the least capacity for which it needs no
    more. A group larger than an even share of what is left has a shard of its own, and the others share the rest."""
    rest = [list(c) for c in classes]
    total, left, runs, own = sum(s * n for s, n in classes), shards, [], 0
    while rest and left > 1 and rest[0][0] * left > total:
        size = rest[0][0]
        runs.append((own, own))
        own, left, total = own + 1, left - 1, total - size
        rest[0][1] -= 1
        if not rest[0][1]:
            rest.pop(0)
    open_ = [(s, n) for s, n in rest]
    if not open_:
        return runs
    low = -(-total // left)
    high = low + open_[0][0]  # a shard without room for an item holds over an even share, which not all can
    best = best_fit(open_, high, left, own)
    for _ in range(SEARCH):
        if low >= high:
            break
        middle = (low + high) // 2
        plan = best_fit(open_, middle, left, own)
        if plan:
            best, high = plan, middle
        else:
            low = middle + 1
    return runs + [(own + rank, shard) for rank, shard in best[0]]


def size_class(size: Column) -> Column:
    """``size`` rounded up to ``CLASS_BITS`` leading bits."""
    shift = F.greatest(F.length(F.bin(size)) - CLASS_BITS, F.lit(0))
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)
    return size + F.pmod(-size, step)


def assign(rows: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """``rows`` (a written table with a binary ``key`` of the indivisible group and a ``size``) with shard and slot.

    Either a number of shards is given, and they come out as equal as groups allow, or a capacity, and the shards are as
    few as best-fit-decreasing needs. Slots number the rows of a shard from 0 without a gap.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give a number of shards or a capacity")
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    order = [F.desc("class"), F.asc("key")]
    ranked = groups.select("key", "rows", size_class(F.col("bytes")).alias("class")).repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = materialise(ranked.withColumn("at", F.monotonically_increasing_id()), "groups")
    # Both tables are bounded: one row for each size class, and one for each partition.
    classes = sorted(((r[0], r[1]) for r in ranked.groupBy("class").count().collect()), reverse=True)
    parts = dict(ranked.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
    runs = equal_shards(classes, shards) if shards is not None else best_fit(classes, capacity)[0]
    base = np.zeros(max(parts, default=0) + 1, dtype=np.int64)
    for part, n in parts.items():
        base[part] = n
    base = np.cumsum(base) - base
    plan = rows.sparkSession.sparkContext.broadcast((base, np.array([r[0] for r in runs], dtype=np.int64), np.array([r[1] for r in runs], dtype=np.int32)))

    @arrow_udf(IntegerType())
    def shard_of(at: pa.Array) -> pa.Array:
        base, first, shard = plan.value
        at = at.to_numpy()
        return pa.array(shard[np.searchsorted(first, base[at >> 33] + (at & (1 << 33) - 1), side="right") - 1])

    placed = ranked.select("key", "rows", shard_of(F.col("at")).alias("shard"))
    placed = materialise(placed, "groups")
    total = sum(r[0] or 0 for r in placed.agg(F.sum("rows")).collect())
    is_hot = F.col("rows") * HOT_PART >= total
    hot = F.broadcast(placed.where(is_hot).select("key", "shard"))  # at most HOT_PART rows
    near = rows.join(hot, "key")
    far = rows.join(hot, "key", "left_anti").join(placed.where(~is_hot).select("key", "shard"), "key")
    return numbered(near.unionByName(far))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a slot: gapless from 0 in each ``shard``, by the counts of the partitions before."""
    at = rows.columns.index("shard")

    def run(batches):
        part, counts = TaskContext.get().partitionId(), {}
        for batch in batches:
            shard = batch.column(at).to_numpy()
            local = np.zeros(len(shard), dtype=np.int64)
            for s in np.unique(shard).tolist():
                mine = np.flatnonzero(shard == s)
                local[mine] = counts.get(s, 0) + np.arange(len(mine))
                counts[s] = counts.get(s, 0) + len(mine)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(shard), pa.int32()), pa.array(local)], names=[*batch.schema.names, "part", "local"])

    held = materialise(rows.mapInArrow(run, f"{rows.schema.toDDL()}, part int, local bigint"), "shards")
    counts = held.groupBy("shard", "part").agg((F.max("local") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    return held.join(counts.select("shard", "part", before.alias("before")), ["shard", "part"]).withColumn("slot", F.col("before") + F.col("local"))


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot. Documents with equal texts stay together.

    A null text counts as empty; null and repeated ids are rows of their own; an empty table gives no rows; other columns
    are not read. Texts are held to be equal if their SHA-256 is.
    """
    read = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(read) + OVERHEAD).cast("bigint").alias("size"), F.crc32(read).alias("text_crc32"),
        F.unhex(F.sha2(read, 256)).alias("key"))
    return assign(materialise(rows, "sizes"), shards, capacity).select("doc_id", "size", "text_crc32", "shard", "slot")


@query("op11_shards_best_fit")
def op11(spark, folder):
    placed = shard_documents(table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
