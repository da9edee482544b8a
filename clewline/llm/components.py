"""Connected components of a link table, by hooking to the smallest neighbour and pointer doubling."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .grouped import salted


def components(links: DataFrame) -> DataFrame:
    """(vertex, component) for every end of ``links`` (a, b); the component is its smallest vertex.

    Each round hooks every root to its smallest neighbour, doubles pointers until they reach a root and keeps only links
    between different roots, until none is left. Every step is written to the shared scratch folder. Links with a null
    end or from a vertex to itself say nothing about others; the latter still name their vertex.
    """
    spark = links.sparkSession
    given = links.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b").distinct()
    open_ = given = materialise(given, "links")
    labels = None
    while True:
        both = open_.select("a", "b").union(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "roots")
        while True:
            above = up.select(F.col("v").alias("root"), F.col("root").alias("next")).join(up.select("root").distinct(), "root")
            jumped = salted(up, above, "root", "v").select("v", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
            jumped = materialise(jumped, "roots")
            up = jumped.select("v", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = up
        else:
            # Few vertices are still open: their new roots go to each old root once, and from there to all its rows.
            above = labels.select("root").distinct().join(up.select(F.col("v").alias("root"), F.col("root").alias("next")), "root", "left")
            labels = materialise(salted(labels, above, "root", "v").select("v", F.coalesce("next", "root").alias("root")), "labels")
        ends = up.select(F.col("v").alias("a"), F.col("root").alias("ra"))
        other = up.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        rest = open_.join(ends, "a").join(other, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        open_ = materialise(rest, "links")
        if open_.isEmpty():
            return labels.select(F.col("v").alias("vertex"), F.col("root").alias("component"))
