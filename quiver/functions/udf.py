"""Functions as values: valence, projections, composition, grouped folds and
row-generating functions over Python code."""

from __future__ import annotations

import functools
import inspect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.plans.session import signal

#: Marks an argument that a projection leaves open.
OPEN = object()


def valence(fn) -> int:
    return len(inspect.signature(fn).parameters)


def project(fn, *args):
    """A function of the arguments left ``OPEN``; all others are bound."""
    holes = [i for i, a in enumerate(args) if a is OPEN] + list(range(len(args), valence(fn)))

    def rest(*given):
        if len(given) > len(holes):
            signal("valence", str(len(given)))
        full = list(args) + [OPEN] * (valence(fn) - len(args))
        for i, a in zip(holes, given):
            full[i] = a
        return project(fn, *full) if any(a is OPEN for a in full) else fn(*full)

    return rest


def compose(*fns):
    """compose(f, g)(x) is f(g(x))."""
    return functools.reduce(lambda f, g: lambda *x: f(g(*x)), fns)


def column(fn, kind: str, vector: bool = False):
    """A Python function of one or more columns as an Arrow-batched Column function:
    of whole pandas Series with ``vector``, else of items; a null item gives null."""

    def apply(*cols) -> Column:
        names = [f"c{i}" for i in range(len(cols))]

        @F.pandas_udf(kind)
        def run(rows: pd.DataFrame) -> pd.Series:
            parts = [rows[n] for n in names]
            if vector:
                return fn(*parts)
            some = rows.notna().all(axis=1)
            return pd.Series([fn(*x) if ok else None for ok, *x in zip(some, *parts)], index=rows.index, dtype=object)

        return run(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(cols, names)]))

    return apply


def fold_groups(df: DataFrame, keys: list[str], value: str, order: str, fn, start, kind: str, out: str = "folded") -> DataFrame:
    """An ordered fold per group by a Python function; a group is one task's."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + f", {out} {kind}"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        acc = functools.reduce(fn, pdf.sort_values(order)[value], start)
        return pd.DataFrame([[*key, acc]], columns=[*keys, out])

    return df.groupBy(*keys).applyInPandas(run, schema)


def fold_parts(df: DataFrame, keys: list[str], value: str, fn, merge, start, kind: str, out: str = "folded") -> DataFrame:
    """A fold per group by a Python function whose parts can be merged: each task folds
    what it reads, and one row per task and group is shuffled, so no group is hot."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + f", {out} {kind}"

    def part(batches):
        held: dict = {}
        for pdf in batches:
            for key, rows in pdf.groupby(keys, dropna=False, sort=False)[value]:
                held[key] = functools.reduce(fn, rows.tolist(), held.get(key, start))
        yield pd.DataFrame([[*k, v] for k, v in held.items()], columns=[*keys, out])

    def whole(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, functools.reduce(merge, pdf[out].tolist())]], columns=[*keys, out])

    return df.select(*keys, value).mapInPandas(part, schema).groupBy(*keys).applyInPandas(whole, schema)


def expand(df: DataFrame, fn, schema: str) -> DataFrame:
    """Rows that ``fn`` (one row as a dict to a list of tuples) makes of each row."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([t for r in pdf.to_dict("records") for t in fn(r)], columns=names)

    return df.mapInPandas(run, schema)


def dumps(fn) -> bytes:
    """A function with the values it captures, as bytes."""
    from pyspark import cloudpickle

    return cloudpickle.dumps(fn)


def loads(data: bytes):
    """A function that :func:`dumps` wrote; only for bytes one trusts."""
    from pyspark import cloudpickle

    return cloudpickle.loads(data)


class Memo:
    """A function that keeps what it has worked out, by its arguments; sent to a
    worker, it starts empty there."""

    def __init__(self, fn):
        self.fn, self.known = fn, {}

    def __call__(self, *args):
        if args not in self.known:
            self.known[args] = self.fn(*args)
        return self.known[args]

    def __getstate__(self):
        return {"fn": self.fn, "known": {}}


def memo(fn) -> Memo:
    return Memo(fn)


def native(library: str, symbol: str, kinds: list[str], returns: str):
    """A C function of numbers as a Column function: looked up by each worker in a
    library that it has, ``kinds`` and ``returns`` being double, float, int or long."""
    import ctypes

    types = {"double": ctypes.c_double, "float": ctypes.c_float, "int": ctypes.c_int32, "long": ctypes.c_int64}

    def call(*args):
        fn = _LINKED.get((library, symbol))
        if fn is None:
            fn = getattr(ctypes.CDLL(library), symbol)
            fn.argtypes, fn.restype = [types[k] for k in kinds], types[returns]
            _LINKED[library, symbol] = fn
        return fn(*args)

    return column(call, returns)


_LINKED: dict = {}
