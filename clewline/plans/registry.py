"""Query registry: a name, a Spark callable over the given tables, and the SQL answer to compare with."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixtures import FIXTURES, closure

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
         "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: An Arrow batch may hold whole pages, so it is bounded by bytes; every task of an executor holds some at a time.
BATCH_BYTES = "4m"


class Tables:
    """Lazy access to the given tables and to the relations derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in FIXTURES:
            return self.derived(name)
        raise AttributeError(name)

    def derived(self, name: str) -> DataFrame:
        return self.sql(FIXTURES[name][1], FIXTURES[name][0])

    def sql(self, text: str, fixtures: str = "") -> DataFrame:
        """SQL over the given tables, with derived relations as common table expressions."""
        for t in GIVEN:
            if t in text or any(t in FIXTURES[f][1] for f in closure(fixtures)):
                getattr(self, t).createOrReplaceTempView(t)
        return self.spark.sql(with_fixtures(text, fixtures))


def with_fixtures(select: str, fixtures: str = "", *ctes: str) -> str:
    parts = [f"{n} AS ({FIXTURES[n][1].strip()})" for n in closure(fixtures)] + [c.strip() for c in ctes]
    return (f"WITH {', '.join(parts)} " if parts else "") + select.strip()


def _plain_types(df: DataFrame) -> DataFrame:
    """Integers as BIGINT so both engines report one type for counts and positions."""
    cols = [F.col(f"`{n}`").cast("bigint").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes]
    return df.select(cols)


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
            return _plain_types(fn(Tables(spark, folder)))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
