"""Language identification: log frequencies of known words, shorter and shorter letter groups for the rest."""
from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..session import materialise
from .registry import query, release, table
from .sampling import sampled_ids

NONE = "und"
#: Labelled documents that the frequencies come from, at most; and entries of the model, at most.
FIT_ROWS = 2000
MOST_ENTRIES = 100_000
LONGEST_GROUP = 4
#: A text fits its language if its share of known words, counted with PRIOR words of the usual share, reaches the part
#: LEAST_PART of what all but LOWEST of the held-out documents of that language reach.
PRIOR, LEAST_PART, LOWEST = 2, 0.5, 0.01
#: Held-out documents of a language without which nothing is said about what fits it.
LEAST_HELD = 20
#: Words whose scores a worker keeps.
KEPT_WORDS = 150_000
LETTERS = re.compile(r"[^\W\d_]+")


def groups(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def count_part(texts, langs) -> Counter:
    """Counts of one batch by (kind, entry, lang), where kind 0 is a word and kind k a group of k letters."""
    words: Counter = Counter()
    for text, lang in zip(texts, langs):
        words.update(zip(LETTERS.findall((text or "").lower()), repeat(lang)))
    found: Counter = Counter()
    for (word, lang), n in words.items():
        found[0, word, lang] = n
        for k in range(1, LONGEST_GROUP + 1):
            for g in groups(word, k):
                found[k, g, lang] += n
    return found


class LanguageModel:
    """``tables[k]``: entry -> row of ``weights`` (log probability by language); ``langs`` in order of name.

    ``fitting``: language -> (usual share of known words, least share of a text that fits); from :meth:`calibrated`.
    """

    def __init__(self, langs: list[str], tables: list[dict[str, int]], weights: np.ndarray, fitting: dict[str, tuple[float, float]] | None = None):
        self.langs, self.tables, self.weights, self.fitting = langs, tables, weights, fitting or {}
        self.plain: list[list[float]] = weights.tolist()
        self.kept: dict[str, int] = {}
        self.rows = np.zeros((1024, len(langs) + 2))

    def __getstate__(self):
        return self.langs, self.tables, self.weights, self.fitting

    def __setstate__(self, state):
        self.__init__(*state)

    def word_score(self, word: str) -> list[float]:
        """Score by language, whether the word is known, and one."""
        at = self.tables[0].get(word)
        if at is not None:
            return [*self.plain[at], 1.0, 1.0]
        padded = f" {word} "
        for k in range(LONGEST_GROUP, 0, -1):
            get = self.tables[k].get
            known = [self.plain[r] for i in range(len(padded) - k + 1) if (r := get(padded[i : i + k])) is not None]
            if known:
                return [*[sum(column) / len(known) for column in zip(*known)], 0.0, 1.0]
        return [*[0.0] * len(self.langs), 0.0, 1.0]

    def word_row(self, word: str) -> int:
        """Place in ``rows`` of a word's score; the last place holds that of a word that is not kept."""
        at = len(self.kept) if len(self.kept) < KEPT_WORDS and len(word) <= 64 else -1
        if at >= 0:
            self.kept[word] = at
            if at >= len(self.rows) - 1:
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.word_score(word)
        return at

    def text_score(self, text: str) -> np.ndarray:
        """Sum over the words of a text, by language, of known ones, and of all."""
        counts = Counter(LETTERS.findall(text.lower()))
        get, extra = self.kept.get, np.zeros(len(self.langs) + 2)
        places, times = [], []
        for word, n in counts.items():
            at = get(word)
            if at is None:
                at = self.word_row(word)
                if at < 0:
                    extra += n * self.rows[-1]
                    continue
            places.append(at)
            times.append(n)
        return np.array(times, dtype=float) @ self.rows[places] + extra if places else extra

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, share of known words, and whether the text fits the language."""
        score = self.text_score(text or "")
        if not score[-1] or not self.langs:
            return NONE, 0.0, 0.0, not self.langs
        best = int(np.argmax(score[:-2]))
        # The chance of the language given one average word of the text, lest every longer text get 1.
        odds = np.exp((score[:-2] - score[best]) / score[-1])
        usual, least = self.fitting.get(self.langs[best], (0.0, 0.0))
        fits = (score[-2] + PRIOR * usual) / (score[-1] + PRIOR) >= least
        return self.langs[best], float(1 / odds.sum()), float(score[-2] / score[-1]), bool(fits)

    def calibrated(self, docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS) -> LanguageModel:
        """This model with bounds on what fits, from at most ``fit_rows`` documents with a language that it has not learned from.
        A language seen in fewer than ``LEAST_HELD`` of them has none."""
        rows = labelled(docs, text, lang, doc_id, fit_rows).select("lang", identify(F.col("text"), self, docs.sparkSession).alias("found"))
        shares: dict[str, list[float]] = {}
        for r in rows.where("found.lang_pred = lang").select("lang", "found.known").collect():  # at most fit_rows numbers
            shares.setdefault(r[0], []).append(r[1])
        fitting = {name: (float(np.median(x)), LEAST_PART * float(np.quantile(x, LOWEST))) for name, x in shares.items() if len(x) >= LEAST_HELD}
        return LanguageModel(self.langs, self.tables, self.weights, fitting)

    @staticmethod
    def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS, most_entries: int = MOST_ENTRIES) -> LanguageModel:
        """Counted over at most ``fit_rows`` documents with a language. Entries rarer than the count that leaves
        ``most_entries`` are left to the shorter groups, so the model has a bounded size."""
        rows = labelled(docs, text, lang, doc_id, fit_rows).select("text", "lang")

        def run(batches):
            for batch in batches:
                for low in range(0, len(batch), 256):
                    part = batch.slice(low, 256)
                    found = count_part(part.column(0).to_pylist(), part.column(1).to_pylist())
                    keys = list(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())],
                        names=["kind", "entry", "lang", "n"])

        counts = rows.mapInArrow(run, "kind int, entry string, lang string, n bigint").groupBy("kind", "entry", "lang").agg(F.sum("n").alias("n"))
        counts = materialise(counts, "languages")
        totals = {(r["kind"], r["lang"]): (r["total"], r["entries"]) for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("total"), F.count("*").alias("entries")).collect()}
        # Totals hold all entries; those met once are left to the shorter groups.
        counts = counts.where(F.col("n") > 1)
        steps = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()
        room, least = most_entries, 1 << 62
        for r in steps:
            room -= r["count"]
            if room < 0:
                break
            least = 1 << r["step"]
        langs = sorted({k[1] for k in totals})
        tables: list[dict[str, int]] = [{} for _ in range(LONGEST_GROUP + 1)]
        found = counts.where(F.col("n") >= least).toPandas()
        number = {name: i for i, name in enumerate(langs)}
        for k, e in zip(found["kind"], found["entry"]):
            tables[k][e] = 0
        row = 0
        for t in tables:
            for e in sorted(t):
                t[e] = row
                row += 1
        # A half is added to every count, so an entry unseen in a language is unlikely there but not impossible.
        seen = np.full((row, len(langs)), 0.5)
        kinds = np.zeros(row, dtype=int)
        for k, e, name, n in zip(found["kind"], found["entry"], found["lang"], found["n"]):
            seen[tables[k][e], number[name]] += n
            kinds[tables[k][e]] = k
        base = np.array([[totals.get((k, name), (0, 0))[0] + 0.5 * (totals.get((k, name), (0, 0))[1] + 1) for name in langs] for k in range(LONGEST_GROUP + 1)]).reshape(LONGEST_GROUP + 1, len(langs))
        return LanguageModel(langs, tables, (np.log(seen) - np.log(base[kinds])).astype(np.float32))


def labelled(docs: DataFrame, text: str, lang: str, doc_id: str, bound: int) -> DataFrame:
    """(doc_id, text, lang) of at most ``bound`` ids with a language, those with the smallest hashes; of rows that repeat an
    id the one with the smallest language and text."""
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where(F.col("lang").isNotNull())
    chosen = F.broadcast(sampled_ids(named, "doc_id", bound))  # an id list of bounded length
    rows = named.join(chosen, F.col("doc_id") == F.col("fit_key"), "left_semi")
    return rows.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select("doc_id", "row.text", "row.lang")


def identify(text: Column, model: LanguageModel, spark) -> Column:
    """Struct (lang_pred, score, known, fits). The model has a bounded size and travels as a broadcast variable.

    ``score`` is the chance of the language by the mean log score of a word, ``known`` the share of words that the model
    has met. Null, empty and letterless texts are ``und`` with score 0 and fit nothing; of languages with equal scores the
    first by name is taken; a model without training documents says ``und`` for all and holds nothing against any text.
    Rows are judged one by one: repeated rows alike, and an empty table gives none.
    """
    shipped = spark.sparkContext.broadcast(model)

    @arrow_udf("struct<lang_pred:string,score:double,known:double,fits:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        got = [shipped.value.predict(t.as_py()) for t in texts]
        release()
        kinds = {"lang_pred": pa.string(), "score": pa.float64(), "known": pa.float64(), "fits": pa.bool_()}
        return pa.StructArray.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    return run(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Every fifth document by a hash of its id (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@query("op9_language_word_backoff")
def op9(spark, folder):
    docs = table(spark, folder, "documents")
    model = LanguageModel.fit(docs.where(~held_out(F.col("doc_id"))))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(F.col("text"), model, spark).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
