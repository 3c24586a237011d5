"""Whole numbers of any size, held as decimal text; Arrow-batched."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quiver.functions.expr import col


def _of(fn, *args) -> Column:
    names = [f"c{i}" for i in range(len(args))]

    @F.pandas_udf("string")
    def run(rows: pd.DataFrame) -> pd.Series:
        some = rows.notna().all(axis=1)
        out = [str(fn(*map(int, x))) if ok else None for ok, *x in zip(some, *(rows[n] for n in names))]
        return pd.Series(out, index=rows.index, dtype=object)

    return run(F.struct(*[col(a).cast("string").alias(n) for a, n in zip(args, names)]))


def add(a, b) -> Column:
    return _of(lambda x, y: x + y, a, b)


def subtract(a, b) -> Column:
    return _of(lambda x, y: x - y, a, b)


def multiply(a, b) -> Column:
    return _of(lambda x, y: x * y, a, b)


def power(a, n) -> Column:
    return _of(lambda x, y: x**y, a, n)


def quotient(a, b) -> Column:
    """Floored quotient; null for a zero divisor."""
    return _of(lambda x, y: x // y, a, F.when(col(b).cast("string") != "0", col(b)))


def remainder(a, b) -> Column:
    return _of(lambda x, y: x % y, a, F.when(col(b).cast("string") != "0", col(b)))


def factorial(n) -> Column:
    import math

    return _of(math.factorial, n)
