"""Joins whose rows mostly lack the key."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def left_lookup(df: DataFrame, side: DataFrame, key: str, side_key: str) -> DataFrame:
    """Left join of ``key`` on ``side_key``; rows without the key find nothing and are dealt out by their content.

    In a plain left join they all go to one task, as they have the same (no) key.
    """
    spread = (-1 - F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))).cast(df.schema[key].dataType)
    placed = df.withColumn("_place", F.coalesce(F.col(key), spread))
    return placed.join(side, (F.col("_place") == F.col(side_key)) & F.col(key).isNotNull(), "left").drop("_place")
