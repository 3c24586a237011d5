"""Dictionaries: map cells, which keep the order of their entries, and tables as
dictionaries of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.functions.expr import col
from quiver.operators.cells import index, let


def make(pairs) -> Column:
    """Dictionary of a list of (key, value) pairs; the last of equal keys stands, in
    the place of the first."""
    field = lambda p, i: p.getField(("key", "value")[i])

    def made(ps):
        names = F.array_distinct(F.transform(ps, lambda p: field(p, 0)))
        last = lambda k: F.element_at(F.filter(ps, lambda p: field(p, 0) == k), -1)
        return F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), field(last(k), 1).alias("value"))))

    return let(col(pairs), made)


def zipped(keys, values) -> Column:
    """Dictionary of a list of keys and one of values; the last of equal keys stands."""
    return make(F.zip_with(col(keys), col(values), lambda k, v: F.struct(k.alias("key"), v.alias("value"))))


def unmake(d) -> Column:
    """List of (key, value) pairs."""
    return F.map_entries(col(d))


def keys(d) -> Column:
    return F.map_keys(col(d))


def values(d) -> Column:
    return F.map_values(col(d))


def get(d, key, default=None) -> Column:
    """Value of a key; the default, or null, where there is none."""
    out = F.try_element_at(col(d), F.lit(key) if isinstance(key, (int, str)) else key)
    return out if default is None else F.coalesce(out, F.lit(default))


def get_all(d, wanted) -> Column:
    """Values of a list of keys, null where there is none."""
    return F.transform(col(wanted), lambda k: F.try_element_at(col(d), k))


def put(d, key, value) -> Column:
    """Dictionary with a key set: in its place, or behind the others."""
    d, key = col(d), F.lit(key) if isinstance(key, (int, str)) else key
    entry = F.struct(key.alias("key"), col(value).alias("value"))
    return make(F.concat(F.map_entries(d), F.array(entry)))


def update(d, key, f) -> Column:
    """Value of a key replaced by what ``f`` makes of it; other entries stay."""
    key = F.lit(key) if isinstance(key, (int, str)) else key
    return F.transform_values(col(d), lambda k, v: F.when(k == key, f(v)).otherwise(v))


def each(f, d) -> Column:
    """``f`` of every value."""
    return F.transform_values(col(d), lambda _, v: f(v))


def delete(d, *gone) -> Column:
    """Dictionary without some keys."""
    return F.map_filter(col(d), lambda k, _: ~k.isin(*gone))


def join(a, b) -> Column:
    """Entries of both; b's value stands where both have a key."""
    return make(F.concat(F.map_entries(col(a)), F.map_entries(col(b))))


def group(a) -> Column:
    """Dictionary from each distinct item of a list to its positions."""
    a = col(a)
    places = lambda u: F.filter(F.transform(a, lambda x, i: F.when(x == u, i)), lambda i: i.isNotNull())
    return F.map_from_entries(F.transform(F.array_distinct(a), lambda u: F.struct(u.alias("key"), places(u).alias("value"))))


def by_value(d) -> Column:
    """Entries by rising value, as a list of pairs."""
    swapped = F.transform(F.map_entries(col(d)), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key")))
    return F.transform(F.array_sort(swapped), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


# ---- tables ------------------------------------------------------------------------


def columns(df: DataFrame) -> list[str]:
    """Keys of a table as a dictionary of columns."""
    return df.columns


def to_table(d, keys_: str = "key", value: str = "value", at: str = "pos"):
    """Columns that list a dictionary's entries with their places: explode them."""
    return F.posexplode(F.map_entries(col(d))).alias(at, "entry")


def rows_of(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Each row as a dictionary of the named columns, all of one type."""
    pairs = [x for c in wanted for x in (F.lit(c), F.col(c))]
    return df.withColumn("dict", F.create_map(*pairs))


def enumerated(n) -> Column:
    """Dictionary 0 .. n-1 to itself."""
    return F.map_from_arrays(index(n), index(n))
