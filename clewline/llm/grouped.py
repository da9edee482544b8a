"""Groups of rows handed to a function in tasks that hold many small groups."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A key that more than one row in so many has is joined map-side; there are fewer of them than this.
HOT = 1000
SALTS = 16


def map_groups(rows: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over every group of equal ``keys`` (integers). Unlike a grouped Pandas call, a task reads its sorted rows as
    a stream, so many tiny groups cost little; a group is held whole, hence must be bounded by whoever makes the keys."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(len(batch) - 1, dtype=bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            starts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
            for low, high in zip(starts, starts[1:]):
                own = tuple(c[low] for c in columns)
                if last is not None and own != last:
                    out = fn(pa.Table.from_batches(held))
                    held = []
                    if out is not None and len(out):
                        yield out
                held.append(batch.slice(low, high - low))
                last = own
        if held:
            out = fn(pa.Table.from_batches(held))
            if out is not None and len(out):
                yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def uneven(rows: DataFrame, facts: DataFrame, key: str, times: str, total: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` inner joined with ``facts``, which has a row per key and in ``times`` how many of the ``total`` rows have it:
    first those of the few keys that very many rows have (at most ``HOT``, so broadcast), then the others, shuffled."""
    many = F.col(times) * HOT > total
    hot = facts.where(many)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(~many), key)
    return rows.join(F.broadcast(hot), key), others


def salted(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` inner joined with ``facts`` (a short row per key); rows of one key are dealt over ``SALTS`` tasks by the column
    ``by``. Never broadcast: Spark's estimate of the repeated side does not know that it is repeated."""
    spread = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread, [key, "__salt"]).drop("__salt")
