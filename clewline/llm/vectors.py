"""Near-duplicate vectors by tiles compared along principal components.

Vectors are turned so that leading places hold most of what tells them apart. Cells of the three leading places make blocks
as large as a task can hold; a pair of blocks is skipped if their boxes are too far apart. Else a task holds one block as
tiles and the other passes by, so a vector travels once for each block it may meet, not for each tile. Between two tiles a
product over the leading places, with the norms of the rest as one more place, bounds every cosine from above, and only what
reaches the threshold is worked out further, in double precision at the end.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from ..session import materialise
from .components import components
from .grouped import salted, uneven
from .registry import query, table
from .sampling import sampled_ids

THRESHOLD = 0.95
TILE = 4096
#: Bytes of doubles that a task holds of one block; blocks that a table is cut into at least.
BLOCK_BYTES = 64 << 20
SIDES = 4
#: Cells along the leading places.
CELLS = (32, 16, 8)
#: A pair of blocks is a task of its own up to so many.
MOST_TASKS = 8192
#: Links that a row of a component hands on at most, so that none gathers in one task.
FAN = 32
#: Leading places compared at a time; rows of a tile compared at a time.
STEPS = (8, 24)
ROWS = 512
#: Vectors that the components are worked out from, at most. Any rotation gives the same links; this one gives them faster.
FIT_ROWS = 4096
SLACK = 1e-5


@arrow_udf(BinaryType())
def _sound(vectors: pa.Array) -> pa.Array:
    """Little-endian doubles of a vector; null if it is null, empty, zero or holds a null or non-finite number."""
    out = []
    for v in vectors:
        values = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
            if np.isfinite(x).all() and x.any():
                values = (x + 0.0).tobytes()  # one zero
        out.append(values)
    return pa.array(out, pa.binary())


def as_doubles(vector: Column) -> Column:
    return _sound(vector)


def unit(matrix: np.ndarray) -> np.ndarray:
    # Scaled first, so that neither large nor tiny numbers leave the range of doubles when squared.
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def rotation(sample: np.ndarray) -> np.ndarray:
    """Columns: principal directions about the origin, strongest first."""
    u = unit(sample)
    return np.linalg.eigh(u.T @ u)[1][:, ::-1]


def prepared(matrix: np.ndarray, turn: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Unit vectors, and their leading places with the norm of the rest, for each step."""
    u = unit(matrix)
    r = u @ turn if turn is not None else u
    return u, [np.concatenate([r[:, :k], np.linalg.norm(r[:, k:], axis=1, keepdims=True)], axis=1).astype(np.float32) for k in STEPS if k < r.shape[1]]


def hits(x: tuple, y: tuple, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Strips (rows of x, rows of y, where their cosines reach ``threshold``) that hold all such pairs."""
    for low in range(0, len(x[0]), ROWS):
        rows, columns = np.arange(low, min(low + ROWS, len(x[0]))), np.arange(len(y[0]))
        for bx, by in zip(x[1], y[1]):
            if not len(rows) or not len(columns):
                break
            reach = bx[rows] @ by[columns].T >= threshold - SLACK
            rows, columns = rows[reach.any(axis=1)], columns[reach.any(axis=0)]
        if len(rows) and len(columns):
            near = x[0][rows] @ y[0][columns].T >= threshold
            if near.any():
                yield rows, columns, near


class BlockPair:
    """Link counts and components of the rows of two blocks (or of one with itself) while they pass by."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.held: list[tuple[int, tuple]] = []
        self.keys: list[bytes] = []
        self.copies = np.zeros(0)
        self.links = np.zeros(0)
        self.root = np.zeros(0, dtype=np.int64)

    def add(self, keys: list[bytes], copies: np.ndarray, tile: tuple, hold: bool, meet: bool) -> None:
        """A tile that meets those held, if ``meet``, and is held itself, if ``hold``; one that does both meets itself."""
        start, size = len(self.keys), len(keys)
        self.keys += keys
        self.copies = np.concatenate([self.copies, copies.astype(float)])
        self.links = np.concatenate([self.links, np.zeros(size)])
        self.root = np.concatenate([self.root, np.arange(start, start + size)])
        if hold:
            self.held.append((start, tile))
        if not meet:
            return
        for other, mate in self.held:
            for rows, columns, near in hits(tile, mate, self.threshold):
                if other == start:
                    near &= rows[:, None] < columns[None, :]
                self._link(rows + start, columns + other, near)

    def _link(self, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> None:
        self.links[left] += near @ self.copies[right]
        self.links[right] += self.copies[left] @ near
        while True:
            a, b = self.root[left], self.root[right]
            apart = near & (a[:, None] != b[None, :])
            rows, columns = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
            if not len(rows):
                return
            ends = np.concatenate([np.stack([a[rows], b[apart[rows].argmax(axis=1)]]), np.stack([a[apart[:, columns].argmax(axis=0)], b[columns]])], axis=1)
            for x, y in np.unique(ends, axis=1).T.tolist():
                while self.root[x] != x:
                    x = int(self.root[x])
                while self.root[y] != y:
                    y = int(self.root[y])
                self.root[max(x, y)] = min(x, y)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def result(self) -> pa.RecordBatch | None:
        """A row with the links of each key that has some, and the edges of a tree of few branches for each component."""
        linked = np.flatnonzero(self.links)
        if not len(linked):
            return None
        order = linked[np.lexsort((np.array([self.keys[k] for k in linked]), self.root[linked]))]
        own = self.root[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        start = np.repeat(first, np.diff(np.append(first, len(order))))
        place = np.arange(len(order)) - start
        above = order[start + np.maximum(place - 1, 0) // FAN]
        some = place > 0
        ends = order[some].tolist(), above[some].tolist()
        key = [self.keys[k] for k in linked] + [self.keys[k] for k in ends[0]]
        return pa.RecordBatch.from_arrays(
            [pa.array(key, pa.binary()), pa.array([None] * len(linked) + [self.keys[k] for k in ends[1]], pa.binary()),
             pa.array(self.links[linked].astype(np.int64).tolist() + [0] * len(ends[0]), pa.int64())], names=["key", "other", "links"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
    """Slices of sorted batches with one (low, high, block) each."""
    for batch in batches:
        if not len(batch):
            continue
        names = np.stack([batch.column(k).to_numpy() for k in range(3)])
        starts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for low, high in zip(starts, starts[1:]):
            yield tuple(names[:, low].tolist()), batch.slice(low, high - low)


def _compare(shipped, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, at, waiting = None, None, []

        def flush() -> None:
            if not waiting:
                return
            part = pa.Table.from_batches(waiting)
            raw = part["values"].to_pylist()
            matrix = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
            low, high, block = at
            pair.add(part["key"].to_pylist(), part["copies"].to_numpy(), prepared(matrix, shipped.value.get(matrix.shape[1])), block == low, block == high)
            waiting.clear()

        for name, piece in _pieces(batches):
            if name != at:
                flush()
                if at is None or name[:2] != at[:2]:
                    if pair is not None and (out := pair.result()) is not None:
                        yield out
                    pair = BlockPair(threshold)
                at = name
            for low in range(0, len(piece), TILE):
                waiting.append(piece.slice(low, TILE))
                if sum(map(len, waiting)) >= TILE:
                    flush()
        flush()
        if pair is not None and (out := pair.result()) is not None:
            yield out

    return run


def blocks(counts: list[tuple[int, int, int]]) -> tuple[list[tuple], list[tuple]]:
    """From (width, cell, rows) in order: for each cell (width, cell, its first block, its number of blocks), for each block
    (width, block, least and greatest leading places). Neighbouring cells share a block; a larger cell is cut by a hash."""
    homes, boxes, at = [], [], 0
    totals: dict[int, int] = {}
    for width, _, n in counts:
        totals[width] = totals.get(width, 0) + n
    while at < len(counts):
        width, size, last = counts[at][0], 0, at
        most = max(1, min(BLOCK_BYTES // (8 * width), math.ceil(totals[width] / SIDES)))
        while last < len(counts) and counts[last][0] == width and (size == 0 or size + counts[last][2] <= most):
            size += counts[last][2]
            last += 1
        cuts = math.ceil(size / most)
        homes += [(width, counts[k][1], len(boxes), cuts) for k in range(at, last)]
        places = np.array(np.unravel_index([counts[k][1] for k in range(at, last)], CELLS))
        step = 2 / np.array(CELLS)
        box = (places.min(axis=1) * step - 1).tolist() + ((places.max(axis=1) + 1) * step - 1).tolist()
        boxes += [(width, len(boxes) + c, *box) for c in range(cuts)]
        at = last
    return homes, boxes


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Linked are vectors of one length whose cosine reaches ``threshold`` (above 0); equal vectors are compared once and
    count as often as they come. A null or zero vector, or one with a null or non-finite component, links with nothing.
    ``component_id`` is the smallest id reachable by links; kept is the row that has it (a null id is no smallest id where
    there is another; of rows that repeat an id each is kept). An empty table gives no rows.
    """
    named = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), as_doubles(F.col(f"`{vector}`")).alias("values"))
    given = materialise(named.withColumn("key", F.unhex(F.md5("values"))), "vectors")
    ids = given.select("vec_id", "key")
    distinct = given.where("key is not null").groupBy("key").agg(F.first("values").alias("values"), F.count("*").alias("copies"), F.min("vec_id").alias("head"))
    distinct = materialise(distinct, "vectors")

    sample = distinct.join(F.broadcast(sampled_ids(distinct, "key", FIT_ROWS)), F.col("key") == F.col("fit_key"), "left_semi")
    by_length: dict[int, list[bytes]] = {}
    for r in sample.select("values").collect():
        by_length.setdefault(len(r[0]) // 8, []).append(bytes(r[0]))
    turns = {d: rotation(np.frombuffer(b"".join(v), dtype="<f8").reshape(-1, d)) for d, v in by_length.items() if len(v) >= d}
    shipped = rows.sparkSession.sparkContext.broadcast(turns)

    @arrow_udf("int")
    def cell(values: pa.Array) -> pa.Array:
        raw = values.to_pylist()
        widths, out = np.array([len(v) // 8 for v in raw]), np.zeros(len(raw), dtype=np.int32)
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            x, turn = unit(np.frombuffer(b"".join(raw[k] for k in at), dtype="<f8").reshape(len(at), width)), shipped.value.get(width)
            lead = (x @ turn if turn is not None else x)[:, : len(CELLS)]
            places = [np.clip((lead[:, k] + 1) / 2 * n, 0, n - 1).astype(int) if k < width else np.zeros(len(at), int) for k, n in enumerate(CELLS)]
            out[at] = np.ravel_multi_index(places, CELLS)
        return pa.array(out, pa.int32())

    placed = distinct.select("key", "values", "copies", (F.length("values") / 8).cast("int").alias("width"), cell(F.col("values")).alias("cell"))
    placed = materialise(placed, "placed")
    # At most 4,096 rows per length of vectors.
    homes, boxes = blocks([tuple(r) for r in placed.groupBy("width", "cell").count().orderBy("width", "cell").collect()])
    spark = rows.sparkSession
    if not boxes:
        return ids.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    home = spark.createDataFrame(homes, "width int, cell int, first int, cuts int")
    sides = [f"{e}{k}" for e in ("l", "h") for k in range(len(CELLS))]
    block = spark.createDataFrame(boxes, "width int, block int, " + ", ".join(f"{c} double" for c in sides))
    mate = block.select(F.col("width").alias("w"), F.col("block").alias("mate"), *[F.col(c).alias("m" + c) for c in sides])
    # Unit vectors as near as wanted are no farther apart than this, and at least as far as their boxes.
    gaps = [F.greatest(F.col(f"ml{k}") - F.col(f"h{k}"), F.col(f"l{k}") - F.col(f"mh{k}"), F.lit(0.0)) for k in range(len(CELLS))]
    close = sum((g * g for g in gaps), F.lit(0.0)) <= 2 - 2 * threshold + 1e-9
    mates = block.join(mate, (F.col("width") == F.col("w")) & close).groupBy("block").agg(F.collect_list("mate").alias("mates"))
    dealt = placed.join(home, ["width", "cell"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int"))
    paired = dealt.join(mates, "block").withColumn("mate", F.explode("mates")).select(
        F.least("block", "mate").alias("low"), F.greatest("block", "mate").alias("high"), "block", "key", "values", "copies")
    tasks = min(MOST_TASKS, len(boxes) * (len(boxes) + 1) // 2)
    passing = paired.repartition(tasks, "low", "high").sortWithinPartitions("low", "high", "block")
    links = materialise(passing.mapInArrow(_compare(shipped, threshold), "key binary, other binary, links bigint"), "links")

    degree = links.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    group = components(links.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))).withColumnRenamed("vertex", "key")
    known = distinct.select("key", "copies", "head").join(degree, "key", "left").join(group, "key", "left").select(
        "key", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "head", "component")
    known = materialise(known, "known")
    linked = known.where("component is not null")
    heads = linked.groupBy("component").agg(F.min("head").alias("component_id"))
    facts = salted(linked, heads, "component", "key").select("key", "copies", "n_links", "component_id").unionByName(
        known.where("component is null").select("key", "copies", "n_links", F.col("head").alias("component_id")))
    facts = materialise(facts, "facts")
    named_ids = ids.where("key is not null")
    total = facts.agg(F.sum("copies")).first()[0] or 0
    hot, others = uneven(named_ids, facts, "key", "copies", total)
    whole = hot.unionByName(others).select("vec_id", "n_links", "component_id")
    alone = ids.where("key is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS least FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


@query("op6_vectors_pca_tiles", ORACLE)
def op6(spark, folder):
    return near_vectors(table(spark, folder, "embeddings"))
