"""Chosen-path similarity join over word shingles.

Every text becomes a set of hashed five-word shingles and, of it, one MinHash token for each of 128 places. A run is a
tree of splits: a node draws one or two of the places (1 / threshold on average) and its texts go to the children named
by the tokens they have there, so texts meet again only where they share the drawn token. Small nodes are leaves, and so
are nodes that drawing hardly splits, since their texts are alike anyway. Leaves are compared by brute force, first on
8 bits of each token, then exactly on the shingles. Runs are repeated until a pair at the threshold is met in one of them
with the wanted probability, given the depth the trees have reached. Runs that draw from the same places are not
independent, since a pair may agree in few of them: after a round of runs the texts get tokens of new places.

Only texts move, never pairs: a pair counts in the first leaf its two texts have in common, so links are counted inside
leaves, and a leaf hands on one row per text and a spanning forest of its links. A leaf of any size is cut into tiles.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from ..session import materialise
from .components import components
from .grouped import map_groups, salted, uneven
from .registry import query, release, table

THRESHOLD = 0.8
SHINGLE = 5
PLACES = 128
#: Texts of a leaf; texts and bytes of shingles of a tile.
LEAF = 200
TILE = 512
TILE_BYTES = 48 << 20
RECALL = 0.999
FIRST_RUNS = 12
#: A node whose share of its parent is this part of the threshold is not split further.
DENSE = 0.9

_U = np.uint64
#: Bits of a node's name that tell its run.
RUN_BITS = 11


def factors(round_: int) -> np.ndarray:
    """Multipliers of the places of a round of runs."""
    rng = np.random.Generator(np.random.PCG64(20240229 + round_))
    return rng.integers(1, 1 << 63, PLACES, dtype=np.uint64) * _U(2) + _U(1)


FACTORS = factors(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        if len(self) < 50_000 and len(word) <= 64:
            self[word] = value
        return value


_WORDS = _Words()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, a text without words has none."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(h) < size:
        out = np.full(1, len(h), dtype=np.uint64)
        for k in range(len(h)):
            out = mix(out + h[k : k + 1])
        return out
    n = len(h) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out + h[k : k + n])
    return np.unique(out)


def tokens(sets: np.ndarray, by: np.ndarray = FACTORS) -> np.ndarray:
    """The MinHash token (32 bits) of a set for every place."""
    best = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(sets), 4096):
        part = sets[None, low : low + 4096] * by[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return (mix(best) >> _U(32)).astype(np.uint32)


@arrow_udf(StructType([StructField("n_shingles", IntegerType()), StructField("tokens", BinaryType())]))
def _sketch(texts: pa.Array) -> pa.Array:
    n, out = [], []
    for t in texts:
        own = shingles(t.as_py())
        n.append(len(own))
        out.append(tokens(own).tobytes() if len(own) else None)
    release()
    return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(out, pa.binary())], names=["n_shingles", "tokens"])


def _tokens(round_: int):
    by = factors(round_)

    @arrow_udf(BinaryType())
    def run(texts: pa.Array) -> pa.Array:
        out = [tokens(own, by).tobytes() if len(own := shingles(t.as_py())) else None for t in texts]
        release()
        return pa.array(out, pa.binary())

    return run


@arrow_udf(BinaryType())
def _sets(texts: pa.Array) -> pa.Array:
    return pa.array([shingles(t.as_py()).tobytes() for t in texts], pa.binary())


def text_key(text: Column) -> Column:
    """16 bytes that tell texts apart; a null text reads as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def chosen(nodes: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each draw: rows that take part, and their place. One place each, and with probability 1 / threshold - 1 a second."""
    seed = nodes.astype(np.uint64)
    first = mix(seed ^ _U(0x243F6A8885A308D3)) % _U(PLACES)
    second = (first + _U(1) + mix(seed ^ _U(0x13198A2E03707344)) % _U(PLACES - 1)) % _U(PLACES)
    draw = mix(seed ^ _U(0xA4093822299F31D0)).astype(np.float64) / 2.0**64
    extra = np.flatnonzero(draw < 1 / threshold - 1)
    return [(np.arange(len(nodes)), first.astype(np.int64)), (extra, second[extra].astype(np.int64))]


def child(nodes: np.ndarray, place: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Name of a child: its run in the top bits, so the smallest common leaf of two texts is one of their first common run."""
    low = _U((1 << (63 - RUN_BITS)) - 1)
    run = nodes.astype(np.uint64) & ~low
    own = mix(mix(nodes.astype(np.uint64)) ^ (place.astype(np.uint64) << _U(32)) ^ token.astype(np.uint64))
    return (run | (own & low)).astype(np.int64)


def _token_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), PLACES)


def _roots(texts: DataFrame, runs: range, threshold: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            matrix = _token_matrix(batch.column(1))
            for r in runs:
                start = np.full(1, r << (63 - RUN_BITS), dtype=np.int64)
                for rows, place in chosen(start, threshold):
                    for p in place[: len(rows)]:
                        nodes = child(np.full(len(batch), start[0]), np.full(len(batch), p), matrix[:, p])
                        yield pa.RecordBatch.from_arrays([pa.array(nodes), batch.column(0), pa.array(np.full(len(batch), -1, dtype=np.int64))], names=["node", "key", "above"])

    return texts.select("key", "tokens").mapInArrow(run, "node bigint, key binary, above bigint")


def _split(rows: DataFrame, threshold: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            nodes, matrix = batch.column(0).to_numpy(), _token_matrix(batch.column(3))
            for take, place in chosen(nodes, threshold):
                if len(take):
                    own = child(nodes[take], place, matrix[take, place])
                    yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(1).take(pa.array(take)), batch.column(2).take(pa.array(take))], names=["node", "key", "above"])

    return rows.select("node", "key", F.col("size").alias("above"), "tokens").mapInArrow(run, "node bigint, key binary, above bigint")


def met_within(depth: int, threshold: float, agree: float | None = None) -> float:
    """Probability that a pair is still together after so many splits of one run, given the share of places where it agrees
    (the threshold if not given)."""
    extra, alive = 1 / threshold - 1, 1.0
    for _ in range(depth):
        keep = (threshold if agree is None else agree) * alive
        alive = (1 - extra) * keep + extra * (1 - (1 - keep) ** 2)
    return alive


def runs_needed(depth: int, threshold: float, recall: float) -> int:
    met = met_within(max(depth, 1), threshold)
    return math.ceil(math.log(1 - recall) / math.log(1 - met)) if met < recall else 1


def missed(depth: int, threshold: float, runs: int) -> float:
    """Probability that a pair at the threshold is met in none of some runs that draw from the same places."""
    share = lambda a: math.comb(PLACES, a) * threshold**a * (1 - threshold) ** (PLACES - a)
    return sum(share(a) * (1 - met_within(max(depth, 1), threshold, a / PLACES)) ** runs for a in range(PLACES + 1))


def next_round(depth: int, threshold: float, recall: float, rounds: list[int]) -> int:
    """Runs to make with new places after rounds of so many runs each; 0 if the recall is reached."""
    left = math.prod(missed(depth, threshold, r) for r in rounds)
    if left <= 1 - recall:
        return 0
    wanted = (1 - recall) / left
    runs = runs_needed(depth, threshold, 1 - wanted)
    while runs < FIRST_RUNS and missed(depth, threshold, runs) > wanted:
        runs += 1
    return min(runs, FIRST_RUNS)


def _leaves(texts: DataFrame, runs: range, threshold: float) -> tuple[list[DataFrame], int]:
    """Written leaf rows (node, key) of some runs, nodes of one text left out, and the depth reached."""
    found, depth = [], 1
    level = materialise(_roots(texts, runs, threshold), "paths")
    while True:
        sizes = materialise(level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        hot, others = uneven(level, sizes, "node", "size", level.count())
        sized = materialise(hot.dropDuplicates(["node", "key"]).unionByName(others.dropDuplicates(["node", "key"])), "paths")
        ends = (F.col("size") <= LEAF) | ((F.col("above") > 0) & (F.col("size") >= DENSE * threshold * F.col("above")))
        found.append(sized.where(ends).select("node", "key"))
        rest = sized.where(~ends)
        if rest.isEmpty():
            return found, depth
        level = materialise(_split(rest.join(texts.select("key", "tokens"), "key"), threshold), "paths")
        depth += 1


def _cross(table_: pa.Table) -> np.ndarray:
    """Pairs of rows that a group compares: all, or those between the two tiles of a tile pair."""
    if table_["low"][0].as_py() == table_["high"][0].as_py():
        return np.triu(np.ones((len(table_), len(table_)), dtype=bool), 1)
    side = table_["tile"].to_numpy() == table_["low"][0].as_py()
    return side[:, None] & ~side[None, :]


def _first_common(leaves: list, i: np.ndarray, j: np.ndarray, node: int) -> np.ndarray:
    """Whether ``node`` is the smallest leaf that rows i and j share."""
    return np.fromiter((min(leaves[a] & leaves[b], default=node) == node for a, b in zip(i.tolist(), j.tolist())), bool, len(i))


def _screen(threshold: float):
    least = PLACES * threshold - 4.5 * math.sqrt(PLACES * threshold * (1 - threshold))

    def screen(group: pa.Table) -> pa.RecordBatch | None:
        n = len(group)
        if n < 2:
            return None
        short = np.frombuffer(b"".join(group["short"].to_pylist()), dtype=np.uint8).reshape(n, PLACES)
        wanted = _cross(group)
        left, right = [], []
        for i in range(n):
            others = np.flatnonzero(wanted[i])
            if len(others):
                near = others[(short[others] == short[i]).sum(axis=1) >= least]
                left.append(np.full(len(near), i))
                right.append(near)
        i, j = np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])
        if not len(i):
            return None
        leaves = [set(x) for x in group["leaves"].to_pylist()]
        good = _first_common(leaves, i, j, group["node"][0].as_py())
        rows = np.unique(np.concatenate([i[good], j[good]]))
        part = group.select(["node", "low", "high", "tile", "key", "leaves"]).take(pa.array(rows)).combine_chunks()
        return part.to_batches()[0] if len(rows) else None

    return screen


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 columns, of only those shingles that two sets have."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    value, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = times > 1
    number = np.cumsum(twice) - 1
    use = twice[where]
    column, row = number[where][use], owner[use]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((n, n), dtype=np.float32)
    for low in range(0, int(twice.sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        block = np.zeros((n, 4096), dtype=np.float32)
        block[row[a:b], column[a:b] - low] = 1
        out += block @ block.T
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric link matrix."""
    n = len(linked)
    seen = np.zeros(n, dtype=bool)
    edges = []
    for start in range(n):
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(linked[at] & ~seen)
            seen[new] = True
            edges += [(at, int(k)) for k in new]
            queue += new.tolist()
    return edges


def _verify(threshold: float):
    def verify(group: pa.Table) -> pa.RecordBatch | None:
        if len(group) < 2:
            return None
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        common = shared_counts(sets).astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - common
        hit = (common >= threshold * union - 1e-9) & _cross(group)
        i, j = np.nonzero(hit)
        leaves = [set(x) for x in group["leaves"].to_pylist()]
        good = _first_common(leaves, i, j, group["node"][0].as_py())
        linked = np.zeros_like(hit)
        linked[i[good], j[good]] = True
        linked |= linked.T
        count = linked @ group["copies"].to_numpy()
        keys = group["key"].to_pylist()
        edges = forest(linked)
        a = [keys[x] for x, _ in edges]
        b = [keys[y] for _, y in edges]
        rows = np.flatnonzero(count).tolist()
        pad = len(edges)
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[r] for r in rows] + a, pa.binary()), pa.array([None] * len(rows) + b, pa.binary()), pa.array(count[rows].tolist() + [0] * pad, pa.int64())],
            names=["key", "other", "links"])

    return verify


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, key (of its text), class_id, n_links, kept.

    Two documents are linked if the Jaccard similarity of their shingle sets reaches ``threshold``; ``n_links`` counts all
    others linked to a document, equal texts included. ``class_id`` is the smallest id reached by links; one row of
    each class is kept, that with the smallest id (null ids last). Repeated ids and rows are documents of their own.
    A document without words (or null) links with nothing and is its own class. An empty table gives no rows.
    """
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    drawn = named.select("doc_id", text_key(F.col("text")).alias("key"), _sketch(F.col("text")).alias("sketch"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(drawn.select("doc_id", "key", "row", "sketch.n_shingles", "sketch.tokens"), "sketches")
    texts = rows.where("n_shingles > 0").groupBy("key").agg(F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"))
    texts = materialise(texts, "texts")

    parts, rounds, depth, drawn_for = [], [], 0, texts
    wanted = FIRST_RUNS
    while wanted:
        done = sum(rounds)
        if done + wanted > 1 << RUN_BITS:
            raise ValueError(f"recall {recall} at threshold {threshold} needs over {1 << RUN_BITS} runs")
        if rounds:
            again = named.select(text_key(F.col("text")).alias("key"), _tokens(len(rounds))(F.col("text")).alias("tokens"))
            drawn_for = materialise(again.where("tokens IS NOT NULL").groupBy("key").agg(F.first("tokens").alias("tokens")), "tokens")
        found, reached = _leaves(drawn_for, range(done, done + wanted), threshold)
        parts += found
        depth = max(depth, reached)
        rounds.append(wanted)
        wanted = next_round(depth, threshold, recall, rounds)
    leaves = parts[0]
    for p in parts[1:]:
        leaves = leaves.union(p)

    sized = leaves.join(texts.select("key", "n_shingles"), "key").groupBy("node").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight"))
    cuts = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("weight") * 8 / TILE_BYTES)).cast("int")
    tiles = materialise(sized.select("node", "size", cuts.alias("tiles")), "tiles")
    # Leaves learn their number of tiles while their rows are short; a text then has all its leaves in one row.
    hot, others = uneven(leaves, tiles, "node", "size", leaves.count())
    of_key = hot.unionByName(others).groupBy("key").agg(F.collect_list(F.struct("node", "tiles")).alias("at"))

    @arrow_udf(BinaryType())
    def low_bytes(column: pa.Array) -> pa.Array:
        matrix = (_token_matrix(column) & 255).astype(np.uint8) if len(column) else []
        return pa.array([m.tobytes() for m in matrix], pa.binary())

    members = of_key.join(texts.select("key", low_bytes(F.col("tokens")).alias("short")), "key").select("key", F.col("at.node").alias("leaves"), "short", F.explode("at").alias("own"))
    tiled = members.select("key", "leaves", "short", "own.node", "own.tiles").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    paired = tiled.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "node", F.least("tile", "mate").alias("low"), F.greatest("tile", "mate").alias("high"), "tile", "key", "leaves", "short")
    place = ["node", "low", "high"]
    screened = map_groups(paired, place, _screen(threshold), "node bigint, low int, high int, tile int, key binary, leaves array<bigint>")
    screened = materialise(screened, "screened")

    # One document of each text wanted is looked up by id and text, so copies of a text do not gather in one task.
    one = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    needed = screened.select("key").distinct().join(one, "key").select(F.col("key").alias("wanted"), F.col("doc_id").alias("holder"))
    keyed = named.withColumn("key", text_key(F.col("text")))
    sets = keyed.join(needed, (F.col("key") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("holder")), "left_semi")
    sets = sets.groupBy("key").agg(F.first("text").alias("text")).select("key", _sets(F.col("text")).alias("shingles"))
    full = screened.join(sets, "key").join(texts.select("key", "copies"), "key")
    links = materialise(map_groups(full, place, _verify(threshold), "key binary, other binary, links bigint"), "links")

    degree = links.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    group = components(links.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    return _classes(rows, texts, degree, group)


def _classes(rows: DataFrame, texts: DataFrame, degree: DataFrame, group: DataFrame) -> DataFrame:
    known = texts.select("key", "copies").join(degree, "key", "left").join(group.withColumnRenamed("vertex", "key"), "key", "left").select(
        "key", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    own = rows.where("n_shingles > 0").groupBy("key").agg(F.min(first).alias("head"))
    known = materialise(known.join(own, "key"), "known")
    linked = known.where("component IS NOT NULL")
    heads = linked.groupBy("component").agg(F.min("head").alias("head"))
    by_text = salted(linked.drop("head"), heads, "component", "key").select("key", "copies", "n_links", "head").unionByName(
        known.where("component IS NULL").select("key", "copies", "n_links", "head"))
    by_text = materialise(by_text, "facts")
    plain = rows.select("doc_id", "key", "row", "n_shingles")
    hot, others = uneven(plain.where("n_shingles > 0"), by_text, "key", "copies", by_text.agg(F.sum("copies")).first()[0] or 0)
    worded = hot.unionByName(others).select("doc_id", "key", F.col("head.doc_id").alias("class_id"), "n_links", (F.col("row") == F.col("head.row")).alias("kept"))
    bare = plain.where("n_shingles = 0").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("kept"))
    return worded.unionByName(bare)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Rows of ``docs`` (all their columns) without the linked ones that :func:`similar_groups` does not keep.

    Of equal rows, and of rows with equal id and text, one stays where their class keeps them.
    """
    judged = materialise(similar_groups(docs, doc_id, text, threshold, recall), "classes")
    pairs = judged.groupBy("doc_id", "key").agg(F.sum(F.col("kept").cast("int")).alias("keep"), F.count("*").alias("rows"))
    stay = pairs.where("keep > 0").select(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"), (F.col("rows") > F.col("keep")).alias("again"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(whole.alias("row"), F.col(f"`{doc_id}`").alias("row_id"), text_key(F.col(f"`{text}`")).alias("row_key"))
    joined = keyed.join(stay, (F.col("row_key") == F.col("own_key")) & F.col("row_id").eqNullSafe(F.col("own_id")))
    once = joined.where(~F.col("again")).select("row.*")
    again = joined.where("again").groupBy("own_id", "own_key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return once.unionByName(again)


@query("op3_jaccard_chosen_path")
def op3(spark, folder):
    return similar_groups(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "kept")
