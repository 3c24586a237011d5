"""Seeded draws: uniform numbers, rolls and deals, that depend on a seed and a key
alone, so that reruns and other partitionings draw the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.functions.expr import col
from quiver.operators.cells import index


def digest(seed: int, key) -> Column:
    """32 hex digits of a seed and a key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), col(key).cast("string")).cast("binary"))


def uniform(seed: int, key) -> Column:
    """A double in [0, 1): the first 52 bits of the digest."""
    return F.conv(F.substring(digest(seed, key), 1, 13), 16, 10).cast("double") / 2.0**52


def roll(m: int, seed: int, key) -> Column:
    """Integers 0 .. m-1, independent."""
    return F.floor(uniform(seed, key) * m).cast("long")


def rolls(shape: list[int], m: int, seed: int, key) -> Column:
    """A list, or for two dimensions a list of lists, of rolls."""
    key = col(key).cast("string")
    row = lambda i: F.transform(index(F.lit(shape[-1])), lambda j: roll(m, seed, F.concat_ws(",", key, *([i.cast("string")] if i is not None else []), j.cast("string"))))
    return row(None) if len(shape) == 1 else F.transform(index(F.lit(shape[0])), row)


def deal(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` distinct rows in a random order that depends on seed and ``key`` alone."""
    return df.orderBy(digest(seed, key), key).limit(n)
