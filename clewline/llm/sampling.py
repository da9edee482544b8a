"""Bounded samples of labelled rows for fitting; nothing else reads a sample."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def sampled_ids(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` distinct keys, those with the smallest hash; the same ones whatever the partitions."""
    keys = rows.select(F.col(f"`{key}`").alias("fit_key")).where(F.col("fit_key").isNotNull())
    order: list[Column] = [F.xxhash64("fit_key"), F.col("fit_key")]
    return keys.groupBy("fit_key").agg(F.lit(1).alias("one")).orderBy(*order).limit(bound).select("fit_key")


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, label_id: str, bound: int) -> DataFrame:
    """Documents with the columns of their labels, for at most ``bound`` labelled ids (that bound lets the id list be broadcast).

    Of rows that repeat an id the smallest is taken on either side, so there is one row for each id.
    """
    chosen = sampled_ids(labels, label_id, bound)

    def one(rows: DataFrame, key: str, name: str) -> DataFrame:
        # The key goes under another name; where it is not among the columns, it is kept.
        others = [c for c in rows.columns if c != key]
        own = rows.select(F.col(f"`{key}`").alias(name), *[F.col(f"`{c}`") for c in others])
        own = own.join(F.broadcast(chosen), F.col(name) == F.col("fit_key"), "left_semi")
        return own.groupBy(name).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias("fit_row")).select(name, "fit_row.*") if others else own.distinct()

    marks, kept = one(labels, label_id, "fit_label"), one(docs, doc_id, "fit_doc")
    return kept.join(marks, F.col("fit_doc") == F.col("fit_label"))
