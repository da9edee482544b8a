"""Ordinal regression of graded quality on hashed text: one weight vector, ordered thresholds (cumulative logits)."""
from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from ..session import materialise
from .registry import query, table
from .sampling import labelled_sample

BITS = 20
#: Labelled documents fitted on, at most, and their features together, at most.
FIT_ROWS = 4000
FIT_FEATURES = 6_000_000
ROUNDS = 100
PENALTY = 1.0
#: Rows that a feature must be in to have a weight.
LEAST_ROWS = 5
KEPT_CHUNKS = 300_000
#: Chance of the best grade from which a document is selected.
LEAST_CHANCE = 0.5
EDGES = ".,;:!?()[]{}\"'«»„“”#*$%&|<>~^=_-"


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) & ((1 << BITS) - 1)


def chunk_names(chunk: str) -> list[str]:
    """Features of a stretch without white space: its word, and the signs around it."""
    word = chunk.strip(EDGES)
    out = ["w:" + word.lower()] if word else []
    tail = chunk[len(chunk.rstrip(EDGES)) :]
    if len(tail) > 1 or tail and tail not in ".,;:!?":
        out.append("t:" + tail[:4])
    if len(word) > 1 and word.isupper():
        out.append("upper")
    return out


def text_names(chunks: list[str], distinct: int, upper: int, signs: int) -> list[str]:
    """Features of a whole text: rounded shares, and its length as a power of two."""
    n = max(1, len(chunks))
    return [f"length:{len(chunks).bit_length()}", f"distinct:{10 * distinct // n}", f"upper:{10 * upper // n}", f"signs:{10 * signs // n}"]


def shares(chunks: list[str], counts: Counter) -> tuple[int, int, int]:
    upper = signs = 0
    for chunk, n in counts.items():
        if chunk.isupper() and len(chunk) > 1:
            upper += n
        if not chunk[-1].isalnum() and chunk[-2:] != chunk[-1:] and (len(chunk) > 1 and not chunk[-2].isalnum() or chunk[-1] in "#*$%&|<>"):
            signs += n
    return len(counts), upper, signs


def features(text: str | None) -> np.ndarray:
    chunks = (text or "").split()
    counts = Counter(chunks)
    names = {name for c in counts for name in chunk_names(c)}
    names.update(text_names(chunks, *shares(chunks, counts)))
    return np.array(sorted({bucket(n) for n in names}), dtype=np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def minimise(loss, x: np.ndarray, rounds: int, memory: int = 12) -> np.ndarray:
    """A smooth function's minimum by limited-memory quasi-Newton steps that must go down (Armijo)."""
    value, slope = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, used = -slope, []
        for s, y, r in reversed(steps):
            a = r * (s @ way)
            way = way - a * y
            used.append(a)
        if steps:
            s, y, r = steps[-1]
            way = way / (r * (y @ y))
        else:
            way = way / max(1.0, float(np.abs(way).max()))
        for (s, y, r), a in zip(steps, reversed(used)):
            way = way + (a - r * (y @ way)) * s
        fall, size = float(slope @ way), 1.0
        while True:
            new = x + size * way
            new_value, new_slope = loss(new)
            if new_value <= value + 1e-4 * size * fall:
                break
            size /= 2
            if size < 1e-10:
                return x
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1.0 / float(s @ y))] if len(steps) >= memory else [*steps, (s, y, 1.0 / float(s @ y))]
        done = value - new_value <= 1e-5 * max(1.0, abs(value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


class OrdinalModel:
    """P(grade > k) = sigmoid(score - thresholds[k]) with ascending thresholds; grades are 0 .. len(thresholds)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.kept: dict[str, tuple[float, ...]] = {}

    def __getstate__(self):
        used = np.flatnonzero(self.weights)
        return used.astype(np.int32), self.weights[used], len(self.weights), self.thresholds

    def __setstate__(self, state):
        used, values, size, thresholds = state
        weights = np.zeros(size, dtype=np.float32)
        weights[used] = values
        self.__init__(weights, thresholds)

    @staticmethod
    def learn(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = ROUNDS, penalty: float = PENALTY, least_rows: int = LEAST_ROWS) -> OrdinalModel:
        """Greatest penalised likelihood over all rows; features of fewer than ``least_rows`` rows have no weight."""
        size = 1 << BITS
        if not len(rows):
            return OrdinalModel(np.zeros(size, dtype=np.float32), np.arange(n_grades - 1, dtype=float))
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        place = np.concatenate(rows)
        often = np.bincount(place, minlength=size) >= least_rows
        owner, place = owner[often[place]], place[often[place]]
        used, place = np.unique(place, return_inverse=True)
        n, d, each = len(rows), len(used), np.arange(len(rows))
        below = np.array([(grades <= k).mean() for k in range(n_grades - 1)])
        start = np.maximum.accumulate(np.log((below + 1e-3) / (1 - below + 1e-3)))

        # A feature counts by how far its share among the best grade is from its share among the rest, so that the
        # penalty weighs on chance features, not on telling ones.
        best = grades == n_grades - 1
        with_best = np.bincount(place, weights=best[owner].astype(float), minlength=d)
        with_rest = np.bincount(place, minlength=d) - with_best
        scale = np.abs(np.log((with_best + 1) / (best.sum() + 2)) - np.log((with_rest + 1) / ((~best).sum() + 2)))
        value = scale[place]

        def thresholds(tail):
            # The first, and the logarithms of the gaps, which keeps them ascending.
            return tail[0] + np.concatenate([[0], np.cumsum(np.exp(tail[1:]))])

        def loss(x):
            weight, tail = x[:d], x[d:]
            cuts = thresholds(tail)
            beyond = sigmoid(np.bincount(owner, weights=weight[place] * value, minlength=n)[:, None] - cuts[None, :])  # P(grade > k)
            upper = np.concatenate([np.ones((n, 1)), beyond], axis=1)[each, grades]
            lower = np.concatenate([beyond, np.zeros((n, 1))], axis=1)[each, grades]
            own = np.maximum(upper - lower, 1e-12)
            slope = np.concatenate([np.zeros((n, 1)), beyond * (1 - beyond), np.zeros((n, 1))], axis=1)
            up, down = slope[each, grades] / own, slope[each, grades + 1] / own
            g = np.empty_like(x)
            g[:d] = penalty * weight - np.bincount(place, weights=(up - down)[owner] * value, minlength=d)
            by_cut = np.array([up[grades == k + 1].sum() - down[grades == k].sum() for k in range(n_grades - 1)])
            g[d:] = np.concatenate([[by_cut.sum()], [by_cut[k + 1 :].sum() * math.exp(tail[k + 1]) for k in range(n_grades - 2)]])
            return -np.log(own).sum() + 0.5 * penalty * weight @ weight, g

        x = minimise(loss, np.concatenate([np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 0.1))]), rounds)
        weights = np.zeros(size, dtype=np.float32)
        weights[used] = x[:d] * scale
        return OrdinalModel(weights, thresholds(x[d:]))

    def _chunk(self, chunk: str) -> tuple[tuple[int, float], ...]:
        return tuple((b, float(w)) for b in {bucket(n) for n in chunk_names(chunk)} if (w := self.weights[b]))

    def score(self, text: str | None) -> float:
        chunks = (text or "").split()
        counts, kept, seen = Counter(chunks), self.kept, {}
        for c in counts:
            found = kept.get(c)
            if found is None:
                found = self._chunk(c)
                if len(kept) < KEPT_CHUNKS and len(c) <= 64:
                    kept[c] = found
            if found:
                seen.update(found)
        for name in text_names(chunks, *shares(chunks, counts)):
            seen[bucket(name)] = float(self.weights[bucket(name)])
        return math.fsum(seen.values())

    def chances(self, score: float) -> np.ndarray:
        """P(grade > k) for every threshold."""
        return sigmoid(score - self.thresholds)

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, doc_id: str = "doc_id", label_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES) -> OrdinalModel:
        """Fitted on at most ``fit_rows`` labelled documents: those with the smallest id hashes, up to the first whose features
        do not fit into ``fit_features`` together with those before, whatever the partitions. ``grade`` is a column over
        ``labels`` (0 the worst); a null grade is no label. Without labels all weights are 0."""
        marked = labels.select(F.col(f"`{label_id}`").alias("doc"), grade.cast("int").alias("grade")).where(F.col("grade").between(0, n_grades - 1))
        texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        hashed = arrow_udf(lambda a: pa.array([features(t.as_py()).tobytes() for t in a], pa.binary()), "binary")
        got = labelled_sample(texts, marked, "doc_id", "doc", fit_rows).select("fit_doc", "grade", hashed(F.col("text").cast("string")).alias("features"))
        got = materialise(got.withColumn("order", F.xxhash64("fit_doc")).withColumn("size", F.length("features") / 4), "features")
        upto = F.sum("size").over(Window.orderBy("order", "fit_doc"))  # over at most fit_rows short rows
        chosen = got.select("fit_doc", "order", "size").withColumn("upto", upto).where(F.col("upto") <= fit_features).select("fit_doc")
        rows = [(r["fit_doc"], r["grade"], np.frombuffer(r["features"], dtype=np.int32)) for r in got.join(chosen, "fit_doc", "left_semi").toLocalIterator()]
        rows.sort(key=lambda r: (str(r[0]), r[1]))
        grades = np.array([r[1] for r in rows], dtype=np.int64)
        return OrdinalModel.learn([r[2] for r in rows], grades, n_grades)


def grade_texts(text: Column, model: OrdinalModel, spark) -> Column:
    """Struct (expected_grade, tail_probability): the mean grade and the chance of the best one. A null text reads as empty;
    repeated rows get equal grades, an empty table none."""
    shipped = spark.sparkContext.broadcast(model)

    @arrow_udf("struct<expected_grade:double,tail_probability:double>")
    def run(texts: pa.Array) -> pa.Array:
        own = shipped.value
        chances = [own.chances(own.score(t.as_py())) for t in texts]
        return pa.StructArray.from_arrays([pa.array([float(c.sum()) for c in chances], pa.float64()), pa.array([float(c[-1]) for c in chances], pa.float64())], names=["expected_grade", "tail_probability"])

    return run(text.cast("string"))


def label_grade() -> Column:
    """0 to 2: one for good quality, one for not being toxic."""
    return F.col("quality") + 1 - F.col("toxic")


@query("op10_quality_ordinal")
def op10(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = OrdinalModel.fit(docs, table(spark, folder, "labels"), label_grade(), 3)
    graded = docs.select("doc_id", grade_texts(F.col("text"), model, spark).alias("g"))
    return graded.select("doc_id", "g.expected_grade", "g.tail_probability", (F.col("g.tail_probability") >= LEAST_CHANCE).alias("kept"))
