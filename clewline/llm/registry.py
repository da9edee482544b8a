"""Names of the queries of this package and the SQL answers they are compared with."""
from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: An Arrow batch holds whole texts, so it is bounded by bytes; Spark's default of 64 MB is met by every task several times.
BATCH_BYTES, BATCH_ROWS = "4m", "1000"


def bounded_batches(spark: SparkSession) -> None:
    """Settings of this session under which texts travel to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def release() -> None:
    """Gives memory of Arrow batches that are done with back to the system; a worker lives through many stages."""
    pa.default_memory_pool().release_unused()


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            bounded_batches(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
