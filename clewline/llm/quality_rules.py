"""Learned decision lists over text statistics: sequential covering that grows and prunes threshold conjunctions."""
from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from .registry import query, release, table
from .sampling import labelled_sample

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b"!?|~^=_"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_marks", "n_digits")
#: Labelled rows that a list is learned from, at most.
FIT_ROWS = 8000


def repeat_words(places: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three words found twice or more; words are given as numbers below ``distinct``."""
    n = len(places)
    if n < 4:
        return 0
    if distinct < 2_000_000:
        key = (places[:-2] * distinct + places[1:-1]) * distinct + places[2:]
    else:  # numbers of pairs first, lest the product overflow
        pairs = np.unique(places[:-2] * distinct + places[1:-1], return_inverse=True)[1]
        key = pairs * distinct + places[2:]
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    again = np.unique(again)
    hit = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
    inside = np.zeros(n, dtype=bool)
    inside[:-2] |= hit
    inside[1:-1] |= hit
    inside[2:] |= hit
    return int(inside.sum())


def count_text(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "replace")
    without = lambda letters: len(raw) - len(raw.translate(None, letters))
    words = raw.split()
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    places = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text or "") - without(SPACE), without(SYMBOLS), len(lines) - len(set(lines)), repeat_words(places, len(number)),
            len(lines), len(number), without(UPPER), without(MARKS), without(DIGITS))


@arrow_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def _stats(texts: pa.Array) -> pa.Array:
    rows = np.array([count_text(t.as_py()) for t in texts], dtype=np.int64).reshape(len(texts), len(COUNTS))
    release()
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(COUNTS))], names=list(COUNTS))


def text_stats(text: Column) -> Column:
    """Struct of counts over a whole text; a null text has none (all 0)."""
    return _stats(text.cast("string"))


def rates(stats: str) -> dict[str, Column]:
    """What rules speak of, from a column of :func:`text_stats`; 0 where the base is 0."""
    of = lambda name: F.col(f"`{stats}`.{name}").cast("double")
    share = lambda part, base: F.when(of(base) > 0, of(part) / of(base)).otherwise(F.lit(0.0))
    return {
        "words": of("n_words"), "word_length": share("word_chars", "n_words"), "symbol_rate": share("n_symbols", "word_chars"),
        "dup_line_rate": share("n_dup_lines", "n_lines"), "repeat_rate": share("n_repeat_words", "n_words"),
        "distinct_rate": share("n_distinct_words", "n_words"), "upper_rate": share("n_upper", "word_chars"),
        "mark_rate": share("n_marks", "word_chars"), "digit_rate": share("n_digits", "word_chars"), "line_words": share("n_words", "n_lines")}


def base_failed(stats: str) -> Column:
    of = lambda name: F.col(f"`{stats}`.{name}")
    return (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words"))


@dataclasses.dataclass(frozen=True)
class Rule:
    """``verdict`` for rows that meet every (name, is_above, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]
    verdict: bool

    def covers(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(columns.values()))), dtype=bool)
        for name, above, at in self.conditions:
            hit &= columns[name] > at if above else columns[name] <= at
        return hit

    def expression(self, columns: dict[str, Column]) -> Column:
        test = F.lit(True)
        for name, above, at in self.conditions:
            test &= columns[name] > F.lit(at) if above else columns[name] <= F.lit(at)
        return test

    def __str__(self):
        return " and ".join(f"{n} {'>' if up else '<='} {at:.6g}" for n, up, at in self.conditions) + f" -> {'keep' if self.verdict else 'drop'}"


def _gain(p0, n0, p1, n1):
    with np.errstate(divide="ignore", invalid="ignore"):
        got = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p0 / (p0 + n0)))
    return np.where(p1 > 0, got, -np.inf)


def _grow(columns, bad, inside, most_conditions, cuts):
    conditions: list[tuple[str, bool, float]] = []
    while len(conditions) < most_conditions and (bad & inside).any() and (~bad & inside).any():
        p0, n0 = float((bad & inside).sum()), float((~bad & inside).sum())
        best = (1e-9, None)
        for name, values in columns.items():
            seen = np.unique(values[inside])
            if len(seen) < 2:
                continue
            middle = (seen[1:] + seen[:-1]) / 2
            at = middle[np.unique(np.linspace(0, len(middle) - 1, min(cuts, len(middle))).astype(int))]
            p_low = np.searchsorted(np.sort(values[bad & inside]), at, side="right").astype(float)
            n_low = np.searchsorted(np.sort(values[~bad & inside]), at, side="right").astype(float)
            for above, p1, n1 in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                gain = _gain(p0, n0, p1, n1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (name, above, float(at[k])))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside = inside & Rule((best[1],), False).covers(columns)
    return conditions


def learn(columns: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 16, most_conditions: int = 3, cuts: int = 256, least_cover: int = 8, least_precision: float = 0.95) -> list[Rule]:
    """Ordered rules that drop rows: each is grown on two thirds of the rows still open, pruned on the other third, and
    taken if it covers ``least_cover`` bad rows with ``least_precision`` on all open rows. Empty where a class is missing."""
    rules: list[Rule] = []
    n = len(bad)
    held = np.arange(n) % 3 == 2
    open_ = np.ones(n, dtype=bool)
    while len(rules) < most_rules:
        conditions = _grow(columns, bad, open_ & ~held, most_conditions, cuts)
        if not conditions:
            break

        def worth(c):
            hit = Rule(tuple(c), False).covers(columns) & open_ & held
            p, m = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - m) / (p + m) if p + m else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        rule = Rule(tuple(conditions), False)
        hit = rule.covers(columns) & open_
        good, all_ = int((hit & bad).sum()), int(hit.sum())
        if good < least_cover or good < least_precision * all_:
            break
        rules.append(rule)
        open_ &= ~hit
    return rules


class QualityRules:
    """An ordered decision list; rows that no rule covers are kept."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", fit_rows: int = FIT_ROWS) -> QualityRules:
        """Learned from at most ``fit_rows`` labelled documents that pass the base rules; ``quality`` 0 is what rules drop, a null label is no label; without labels there is no rule."""
        marked = labels.where(F.col(f"`{quality}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{quality}`").alias("mark"))
        texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        rows = labelled_sample(texts, marked, "doc_id", "doc", fit_rows).select("fit_doc", "mark", text_stats(F.col("text")).alias("stats"))
        named = rates("stats")
        got = rows.where(~base_failed("stats")).select("fit_doc", "mark", *[c.alias(n) for n, c in named.items()]).toPandas()
        got = got.sort_values(list(got.columns), kind="stable").sample(frac=1.0, random_state=7)
        return QualityRules(learn({n: got[n].to_numpy(dtype=float) for n in named}, got["mark"].to_numpy() == 0) if len(got) else [])

    def verdict(self, stats: str) -> Column:
        columns, out = rates(stats), None
        for rule in self.rules:
            test = rule.expression(columns)
            out = F.when(test, F.lit(rule.verdict)) if out is None else out.when(test, F.lit(rule.verdict))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def judge(self, docs: DataFrame, text: str = "text", stats: str = "quality_stats") -> DataFrame:
        """``docs`` with columns ``stats`` (struct), base_failed and kept; input columns of these names give way. Repeated rows
        are judged alike, an empty table stays empty."""
        held = docs.withColumn(stats, text_stats(F.col(f"`{text}`"))).withColumn("base_failed", base_failed(stats))
        return held.withColumn("kept", ~F.col("base_failed") & self.verdict(stats))


@query("op2_quality_decision_list")
def op2(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = QualityRules.fit(docs, table(spark, folder, "labels")).judge(docs)
    return judged.select("doc_id", *[F.col(f"quality_stats.{c}").alias(c) for c in COUNTS], "base_failed", "kept")
