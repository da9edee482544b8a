"""Three-valued logic and canonical-form helpers.

``True`` = observed, ``False`` = observed not, ``NULL`` = could not tell.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def any3(flag: Column) -> Column:
    """Aggregate: any true -> true; else any null -> null; else false (needs >= 1 row)."""
    return (
        F.when(F.bool_or(flag), F.lit(True))
        .when(F.count_if(flag.isNull()) > 0, F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )


def not3(flag: Column) -> Column:
    return F.when(flag.isNotNull(), ~flag)


def first_true(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Ordered rule chain: the value of the first rule whose condition is true."""
    out = None
    for cond, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def canonical_json(*cols: str) -> Column:
    """JSON text with sorted keys and explicit nulls."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


def content_hash(*cols: str) -> Column:
    return F.sha2(canonical_json(*cols), 256)


def joined(values: Column, sep: str = ",") -> Column:
    """Flat text of a sorted array, NULL when the array is empty."""
    arr = F.array_sort(values)
    return F.when(F.size(arr) > 0, F.array_join(arr, sep))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used there."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))
