"""Corpus pipeline: language identification, quality rules, near-duplicate removal, packing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clewline.llm import jaccard_join, language, packing, quality_rules
from clewline.llm.registry import bounded_batches
from clewline.session import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _filtered(docs: DataFrame, name: str, value: Column, keep) -> DataFrame:
    """Rows of ``docs`` for which ``keep`` of a column with that value is true, with the columns of ``docs``."""
    name = _free(docs, name)
    return docs.withColumn(name, value).where(keep(name)).drop(name)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose words are too rarely known for any learned language.

    Words are learned from the documents with a ``lang`` outside the held-out fifth; how rare is too rare comes from that
    fifth (:meth:`LanguageModel.calibrated`). Where no document has a ``lang``, nothing is known and all are kept. Null and
    empty texts go; repeated rows fare alike; an empty table stays empty; the columns are those of ``docs``.
    """
    bounded_batches(spark)
    held = language.held_out(F.col("doc_id"))
    model = language.LanguageModel.fit(docs.where(~held)).calibrated(docs.where(held))
    return _filtered(docs, "language", language.identify(F.col("text"), model, spark), lambda name: F.col(f"`{name}`.fits"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or a learned rule.

    Without labels there is no learned rule. A null text has no words and goes; repeated rows fare alike; an empty table
    stays empty; the columns are those of ``docs``.
    """
    bounded_batches(spark)
    rules = quality_rules.QualityRules.fit(docs, _table(spark, sf_dir, "labels"))
    return _filtered(docs, "stats", quality_rules.text_stats(F.col("text")), lambda name: ~quality_rules.base_failed(name) & rules.verdict(name))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts linked by shingle similarity (of repeated rows one; of null texts one).

    An empty table stays empty; the columns are those of ``docs``.
    """
    bounded_batches(spark)
    return jaccard_join.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end token; null and repeated ids are documents of their own; other columns are not read;
    an empty table gives no pieces.
    """
    bounded_batches(spark)
    return packing.digest(packing.pack(docs))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("jaccard_join", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Learned models and tokenisation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of :func:`pack_sequences` for what the stages keep of ``documents``; odd rows fare as each stage says."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
