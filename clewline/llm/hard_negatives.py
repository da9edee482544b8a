"""Hard negatives by inner product, found in a forest of STR-packed R-trees.

Vectors become integers, so every score is exact. Rows are dealt into tiles by ranges of one coordinate; in a tile they are
sorted and tiled coordinate by coordinate into leaves, and leaves are packed into nodes, each with its bounding box. For an
anchor, a box gives an interval of inner products by coordinate, and the sums of their ends bound every score inside. A
best-first queue opens the box with the highest bound, and leaves out boxes that cannot meet a score window or that lie
strictly below the worst row still wanted. Anchors go first to the tile that promises most, and then to the others with
what they found there, so a tile that cannot do better is never visited.
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window

from ..session import materialise
from .registry import query, table
from .sampling import sampled_ids

SCALE = 256
#: Rows of a tile at least, and tiles at most (their boxes travel to every task, 2 * width numbers each).
TILE, MOST_TILES = 4096, 8192
LEAF, FAN = 128, 8
#: Anchors that meet a tile in one task; beyond, the tile is sent to several.
STRIP = 16384
#: Vectors from which the coordinate that deals rows into tiles is chosen. Any choice gives the same result.
FIT_ROWS = 4096
#: Sums below this are exact in double precision, also a hundredfold.
EXACT = 1 << 46


@arrow_udf(BinaryType())
def _whole(vectors: pa.Array, scale: pa.Array) -> pa.Array:
    out = []
    by = scale[0].as_py() if len(scale) else 1
    for v in vectors:
        values = None
        if v.is_valid and not v.values.null_count:
            with np.errstate(over="ignore"):
                x = np.floor(by * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
            # len * max^2 bounds every score, which has to fit a long.
            if np.isfinite(x).all() and (not len(x) or len(x) * float(np.abs(x).max()) ** 2 < 2.0**62):
                values = x.astype("<i8").tobytes()
        out.append(values)
    return pa.array(out, pa.binary())


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as little-endian 64-bit numbers; null for a null vector, for null or non-finite
    components, and where a score could leave the range of a long."""
    return _whole(vector, F.lit(scale))


def str_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Rows in sort-tile-recursive order: consecutive stretches of ``leaf`` rows make the leaves."""
    axes = np.argsort(-points.astype(np.float64).var(axis=0), kind="stable") if points.size else []

    def cut(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        pages = -(-len(rows) // leaf)
        if pages <= 1 or depth == len(axes):
            return [rows]
        slabs = int(np.ceil(pages ** (1 / (len(axes) - depth))))
        rows = rows[np.argsort(points[rows, axes[depth]], kind="stable")]
        step = -(-pages // slabs) * leaf
        return [part for low in range(0, len(rows), step) for part in cut(rows[low : low + step], depth + 1)]

    return np.concatenate(cut(np.arange(len(points)), 0)) if len(points) else np.arange(0)


class RTree:
    """Rows packed in :func:`str_order`; ``levels[0]`` are the boxes of leaves, ``levels[-1]`` has at most ``FAN``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.points, self.leaf, self.fan = points, leaf, fan
        low, high = self._boxes(points, points, leaf)
        self.levels = [(low, high)]
        while len(low) > fan:
            low, high = self._boxes(low, high, fan)
            self.levels.append((low, high))

    @staticmethod
    def _boxes(low: np.ndarray, high: np.ndarray, size: int):
        at = np.arange(0, len(low), size)
        return np.minimum.reduceat(low, at, axis=0), np.maximum.reduceat(high, at, axis=0)

    def intervals(self, anchors: np.ndarray):
        """By level: least and greatest possible score of each (anchor, box)."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return [(up @ low.T + down @ high.T, up @ high.T + down @ low.T) for low, high in self.levels]

    def search(self, anchor: np.ndarray, bounds, allowed: np.ndarray, windows: list[Kept]) -> None:
        """Best-first through the tree; ``bounds`` are the anchor's rows of :meth:`intervals`, ``allowed`` marks its rows."""
        least = min(w.floor() for w in windows)
        most = max(w.high for w in windows)
        top = len(self.levels) - 1
        queue = [(-b, top, k) for k, b in enumerate(bounds[top][1].tolist())]
        heapq.heapify(queue)
        while queue:
            bound, level, k = heapq.heappop(queue)
            if -bound < least:
                return
            if bounds[level][0][k] > most:
                continue
            if level:
                children = range(k * self.fan, min((k + 1) * self.fan, len(self.levels[level - 1][0])))
                for child in children:
                    b = bounds[level - 1][1][child]
                    if b >= least:
                        heapq.heappush(queue, (-b, level - 1, child))
                continue
            span = slice(k * self.leaf, (k + 1) * self.leaf)
            scores = self.points[span] @ anchor
            hits = np.flatnonzero((scores >= least) & (scores <= most) & allowed[span])
            if len(hits):
                found = [(int(scores[h]), k * self.leaf + int(h)) for h in hits]
                for w in windows:
                    w.add(found)
                least = min(w.floor() for w in windows)


class Kept:
    """The best ``size`` rows with low <= score <= high; of equal scores the smaller id."""

    def __init__(self, low: float, high: float, size: int, worst: float, ids: np.ndarray):
        self.low, self.high, self.size, self.ids = max(low, worst), high, size, ids
        self.best: list[tuple[int, int, int]] = []

    def floor(self) -> float:
        return self.low if len(self.best) < self.size else max(self.low, -self.best[-1][0])

    def add(self, found: list[tuple[int, int]]) -> None:
        least = self.floor()
        new = [(-s, int(self.ids[at]), at) for s, at in found if least <= s <= self.high]
        if new:
            self.best = sorted(self.best + new)[: self.size]


def _numbers(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype="<i8").reshape(len(values), -1)


def _ready(points: np.ndarray, anchors: np.ndarray):
    """Doubles where all sums are exact in them, else Python's own whole numbers."""
    reach = lambda m: int(np.abs(m).max(initial=0))
    kind = np.float64 if points.shape[1] * reach(points) * reach(anchors) < EXACT else object
    return points.astype(kind), anchors.astype(kind)


TILES = "tile bigint, width int, size int, rows binary, ids binary, labels binary, points binary, low binary, high binary"


def build(rows: DataFrame) -> DataFrame:
    """Tiles of an index over ``rows`` (a written table of row, vec_id, label, values)."""
    total = rows.count()
    tile = max(TILE, -(-total // MOST_TILES))
    width = (F.length("values") / 8).cast("int")
    sample = rows.join(F.broadcast(sampled_ids(rows, "row", FIT_ROWS)), F.col("row") == F.col("fit_key"), "left_semi").select("values").collect()
    widths = [len(r[0]) for r in sample]
    lead = 0
    if widths and (longest := max(widths)):
        lead = int(_numbers([bytes(r[0]) for r in sample if len(r[0]) == longest]).astype(np.float64).var(axis=0).argmax())

    @arrow_udf("bigint")
    def leading(values: pa.Array) -> pa.Array:
        return pa.array([int.from_bytes(v.as_py()[8 * lead : 8 * lead + 8], "little", signed=True) for v in values], pa.int64())

    dealt = rows.withColumn("width", width).withColumn("lead", leading(F.col("values"))).repartitionByRange(-(-total // tile) or 1, "width", "lead", "row")

    def pack(rows_, ids, labels, values):
        points = _numbers(values)
        order = str_order(points)
        points = np.ascontiguousarray(points[order])
        byte = lambda a: pa.array([np.ascontiguousarray(a).astype("<i8").tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([int(rows_[order][0])]), pa.array([points.shape[1]], pa.int32()), pa.array([len(points)], pa.int32()), byte(rows_[order]), byte(ids[order]), byte(labels[order]),
             byte(points), byte(points.min(axis=0)), byte(points.max(axis=0))], names=[c.split()[0] for c in TILES.split(", ")])

    def run(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            while len(held) >= 2 * tile:
                yield from flush(held.slice(0, tile))
                held = held.slice(tile)
        if held is not None and len(held):
            yield from flush(held)

    def flush(held):
        wide = held["width"].to_numpy()
        for w in np.unique(wide).tolist():
            mine = held.take(pa.array(np.flatnonzero(wide == w)))
            yield pack(mine["row"].to_numpy(), mine["vec_id"].to_numpy(), mine["label"].to_numpy(), mine["values"].to_pylist())

    # A tile is named by one of its rows, so names do not depend on tasks.
    return materialise(dealt.select("row", "vec_id", "label", "values", "width").mapInArrow(run, TILES), "tiles")


class Forest:
    """The written tiles and, for routing, their boxes: a table of at most about ``MOST_TILES`` rows for a width."""

    def __init__(self, rows: DataFrame):
        self.tiles = build(rows)
        boxes = self.tiles.select("tile", "width", "low", "high").collect()
        by_width = {}
        for w in {b["width"] for b in boxes}:
            own = sorted((b["tile"], bytes(b["low"]), bytes(b["high"])) for b in boxes if b["width"] == w)
            by_width[w] = np.array([o[0] for o in own]), _numbers([o[1] for o in own]), _numbers([o[2] for o in own])
        self.boxes = rows.sparkSession.sparkContext.broadcast(by_width)

    def route(self, wants: DataFrame, first: bool) -> DataFrame:
        """``wants`` (row, label, values, windows) with the ``tile`` to visit: only the most promising one for ``first``, else
        all others that may hold something. ``windows``: array of (window, low, high, worst) in whole numbers."""
        boxes = self.boxes

        def run(batches):
            for batch in batches:
                values, windows = batch.column(batch.schema.get_field_index("values")).to_pylist(), batch.column(batch.schema.get_field_index("windows")).to_pylist()
                at, to = [], []
                for k, (v, ws) in enumerate(zip(values, windows)):
                    if len(v) // 8 not in boxes.value or not ws:
                        continue
                    names, low, high = boxes.value[len(v) // 8]
                    anchor = np.frombuffer(v, dtype="<i8")
                    both, anchor = _ready(np.concatenate([low, high]), anchor)
                    low, high = both[: len(low)], both[len(low) :]
                    up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
                    least, most = low @ up + high @ down, high @ up + low @ down
                    top = int(np.argmax(most))
                    floor, ceiling = min(max(w["low"], w["worst"]) for w in ws), max(w["high"] for w in ws)
                    go = [top] if first else [t for t in np.flatnonzero((most >= floor) & (least <= ceiling)).tolist() if t != top]
                    at += [k] * len(go)
                    to += names[go].tolist()
                out = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(to, pa.int64())], names=[*out.schema.names, "tile"])

        return wants.mapInArrow(run, f"{wants.schema.toDDL()}, tile bigint")

    def visit(self, wants: DataFrame, strips: int, size: int, same: bool, first: bool) -> DataFrame:
        """(row, window, other, score): of each visited tile, for each window of an anchor, its best ``size`` rows of the same or another label."""
        routed = self.route(wants, first).withColumn("strip", F.pmod(F.xxhash64("row"), F.lit(strips)).cast("int"))
        copies = self.tiles.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
        # One row of either kind; the tile comes first in its group and the anchors pass by it.
        fields = "row", "label", "values", "windows"
        packed = F.struct("size", "rows", "ids", "labels", "points")
        both = copies.select("tile", "strip", F.lit(0).alias("kind"), packed.alias("packed")).unionByName(
            routed.select("tile", "strip", F.lit(1).alias("kind"), F.struct(*fields).alias("anchor")), allowMissingColumns=True)

        def run(batches):
            tile = None
            for batch in batches:
                kind = batch.column(batch.schema.get_field_index("kind")).to_pylist()
                packed, anchors = batch.column(batch.schema.get_field_index("packed")), batch.column(batch.schema.get_field_index("anchor"))
                at = 0
                while at < len(kind):
                    if kind[at] == 0:
                        p = packed[at].as_py()
                        rows, ids, labels = (np.frombuffer(p[c], dtype="<i8") for c in ("rows", "ids", "labels"))
                        tile = rows, ids, labels, np.frombuffer(p["points"], dtype="<i8").reshape(p["size"], -1)
                        at += 1
                        continue
                    to = at
                    while to < len(kind) and kind[to] == 1 and to - at < 256:
                        to += 1
                    yield answer(tile, anchors.slice(at, to - at).to_pylist())
                    at = to

        trees: dict = {}

        def answer(tile, anchors):
            rows, ids, labels, raw = tile
            points, vectors = _ready(raw, _numbers([a["values"] for a in anchors]))
            if trees.get("of") is not rows or trees["kind"] != points.dtype:
                trees.update(of=rows, kind=points.dtype, tree=RTree(points))
            tree = trees["tree"]
            bounds = tree.intervals(vectors)
            out: list[tuple[int, int, int, int]] = []
            for k, a in enumerate(anchors):
                windows = [Kept(w["low"], w["high"], size, w["worst"], ids) for w in a["windows"]]
                allowed = (labels == a["label"]) == same
                allowed &= rows != a["row"]
                tree.search(vectors[k], [(low[k], high[k]) for low, high in bounds], allowed, windows)
                out += [(a["row"], w["window"], b[1], -b[0]) for w, found in zip(a["windows"], windows) for b in found.best]
            columns = list(zip(*out)) or [()] * 4
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["row", "window", "other", "score"])

        sorted_ = both.repartition("tile", "strip").sortWithinPartitions("tile", "strip", "kind")
        return sorted_.mapInArrow(run, "row bigint, window int, other bigint, score bigint")

    def best(self, wants: DataFrame, strips: int, size: int, same: bool) -> DataFrame:
        """(row, window, rank, other, score): the best ``size`` rows for each window of ``wants`` (row, label, values, windows)."""
        place = Window.partitionBy("row", "window").orderBy(F.desc("score"), "other")
        cut = lambda df: df.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= size)
        near = materialise(self.visit(wants, strips, size, same, True), "found")
        worst = cut(near).groupBy("row", "window").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") == size)
        known = worst.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", "worst"))).alias("known"))
        better = F.transform("windows", lambda w: F.struct(w["window"].alias("window"), w["low"].alias("low"), w["high"].alias("high"), F.greatest(w["worst"], F.element_at("known", w["window"])).alias("worst")))
        again = wants.join(known, "row", "left").withColumn("windows", F.when(F.col("known").isNull(), F.col("windows")).otherwise(better)).drop("known")
        far = self.visit(again, strips, size, same, False)
        return cut(near.unionByName(far))


NO_LOW, NO_HIGH = -(1 << 63), (1 << 63) - 1


def hard_negatives(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among ``rows``.

    A score is the inner product of floor(scale * x). Positives are an anchor's first rows of the same label other than
    itself; for each, the first rows of other labels with low * positive <= 100 * negative <= high * positive. Higher
    scores come first, then smaller ids. A row without id, label or vector, with a null or non-finite component, or so
    large that a score could leave the range of a long takes no part; a row only meets vectors of its own length. Rows
    that repeat an id are rows of their own (they are each other's candidates). An anchor without positive or without
    negative in the window gives no row, an empty table gives none. ``label`` and ``vec_id`` are whole numbers.
    """
    chosen = rows.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("bigint").alias("label"),
        whole_numbers(F.col(f"`{vector}`"), scale).alias("values"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    sound = chosen.where("vec_id is not null and label is not null and values is not null")
    given = materialise(sound.withColumn("row", F.monotonically_increasing_id()), "vectors")
    forest = Forest(given.select("row", "vec_id", "label", "values"))
    anchors = given.where("anchor").select("row", "vec_id", "label", "values")
    strips = max(1, -(-anchors.count() // STRIP))
    window = lambda k, low, high: F.struct(F.lit(k).cast("int").alias("window"), low.alias("low"), high.alias("high"), F.lit(NO_LOW).alias("worst"))
    wide = F.array(window(0, F.lit(NO_LOW), F.lit(NO_HIGH)))
    near = forest.best(anchors.select("row", "label", "values", wide.alias("windows")), strips, positives, True)
    near = materialise(near.select("row", F.col("rank").cast("int").alias("window"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # low * p <= 100 * n <= high * p in whole numbers; decimals hold the products.
    p = F.col("positive_score").cast("decimal(38,0)")
    span = F.struct("window", F.ceil(p * low / 100).cast("bigint").alias("low"), F.floor(p * high / 100).cast("bigint").alias("high"), F.lit(NO_LOW).alias("worst"))
    open_ = near.where(f"{low} * cast(positive_score as decimal(38,0)) <= {high} * cast(positive_score as decimal(38,0))")
    spans = open_.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("windows"))
    far = forest.best(anchors.join(spans, "row").select("row", "label", "values", "windows"), strips, negatives, False)
    named = far.join(near, ["row", "window"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op13_hard_negatives_rtree", ORACLE)
def op13(spark, folder):
    given = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(given.withColumn("label", shifted), F.col("vec_id") % 100 == 0)
