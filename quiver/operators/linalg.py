"""Matrices: coordinate tables (i, j, v) for products at scale, and cells of
nested arrays for decompositions of small ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.functions.expr import col

#: A pivot or singular value that counts as zero, and noise of a result.
EPS, NOISE = 1e-12, 2.220446049250313e-16 * 1e6


def mul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of coordinate tables: join on the inner index, sum by cell."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def flip(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def coordinates(df: DataFrame, row: str, cells: str) -> DataFrame:
    return df.select(F.col(row).alias("i"), F.posexplode(cells).alias("j", "v"))


# ---- decompositions ----------------------------------------------------------


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P', L, U) with P' L U = a, pivots of largest magnitude."""
    u, n = a.astype(float).copy(), len(a)
    low, order = np.eye(n), np.arange(n)
    for k in range(min(u.shape)):
        p = k + int(np.abs(u[k:, k]).argmax())
        if p != k:
            u[[k, p]], order[[k, p]] = u[[p, k]], order[[p, k]]
            low[[k, p], :k] = low[[p, k], :k]
        if abs(u[k, k]) > 0:
            f = u[k + 1 :, k] / u[k, k]
            low[k + 1 :, k] = f
            u[k + 1 :] -= np.outer(f, u[k])
    return np.eye(n)[order].T, low, u


def ldu(a: np.ndarray):
    p, low, u = lu(a)
    d = np.diag(u).copy()
    safe = np.where(d == 0, 1, d)
    return p, low, np.diag(d), u / safe[:, None]


def svd(a: np.ndarray):
    """(U, S, V') by falling singular values, the first entry of each column of U
    that is not zero being positive."""
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    some = np.abs(u) > EPS
    sign = np.sign(u[some.argmax(axis=0), np.arange(u.shape[1])])
    sign[sign == 0] = 1
    return u * sign, np.diag(s), vt * sign[:, None]


def rref(a: np.ndarray) -> np.ndarray:
    m, row = a.astype(float).copy(), 0
    for j in range(m.shape[1]):
        if row == len(m):
            break
        p = row + int(np.abs(m[row:, j]).argmax())
        if abs(m[p, j]) <= EPS:
            m[row:, j] = 0
            continue
        m[[row, p]] = m[[p, row]]
        m[row] /= m[row, j]
        others = np.arange(len(m)) != row
        m[others] -= np.outer(m[others, j], m[row])
        row += 1
    return m


def det(a: np.ndarray) -> float:
    d = float(np.linalg.det(a))
    return 0.0 if abs(d) < EPS else d


def lsq(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares; a singular value of at most EPS makes every result NaN, and
    noise is zero."""
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    if (s <= EPS).any():
        return np.full(a.shape[1], np.nan)
    x = vt.T @ ((u.T @ y) / s)
    return np.where(np.abs(x) < NOISE, 0.0, x)


def fit(df: DataFrame, keys: list[str], terms: list[Column], y: Column, out: str = "solution") -> DataFrame:
    """Least squares per group from sums of products of the terms: what is shuffled
    is one row a group, whatever the group's size."""
    k = len(terms)
    sums = {f"__a{i}_{j}": F.sum(terms[i] * terms[j]) for i in range(k) for j in range(i, k)} | {f"__b{i}": F.sum(terms[i] * y) for i in range(k)}
    got = df.groupBy(*keys).agg(*[c.cast("double").alias(n) for n, c in sums.items()])
    square = F.array(*[F.array(*[F.col(f"__a{min(i, j)}_{max(i, j)}") for j in range(k)]) for i in range(k)])
    return got.select(*keys, solve(square, F.array(*[F.col(f"__b{i}") for i in range(k)])).alias(out))


_FORMS = {
    "lu": lambda a: lu(a), "ldu": lambda a: ldu(a), "qr": lambda a: np.linalg.qr(a, mode="complete"), "svd": lambda a: svd(a),
    "inv": lambda a: (np.linalg.inv(a),), "rref": lambda a: (rref(a),), "det": lambda a: (np.array([[det(a)]]),),
}


def decompose(kind: str, a) -> Column:
    """The factors of a matrix cell, as an array of matrices, by an Arrow UDF."""

    @F.pandas_udf("array<array<array<double>>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda m: [x.tolist() for x in _FORMS[kind](np.array([list(r) for r in m], float))], na_action="ignore")

    return run(col(a))


def solve(a, y) -> Column:
    @F.pandas_udf("array<double>")
    def run(m: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([lsq(np.array([list(r) for r in x], float), np.array(list(w), float)).tolist() for x, w in zip(m, v)])

    return run(col(a), col(y))


def matmul(a, b) -> Column:
    """Product of two matrix cells."""

    @F.pandas_udf("array<array<double>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([(np.array([list(r) for r in p], float) @ np.array([list(r) for r in q], float)).tolist() for p, q in zip(x, y)])

    return run(col(a), col(b))


def nearest(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL does, a half away from zero; no zero is negative.  What lies under
    a half by no more than the noise of a product counts as one, which is held to a
    millionth of the last digit."""
    scale, noise = 10.0**digits, 8 * len(x) * np.finfo(float).eps * np.abs(x).max(initial=0)
    y = np.abs(x) * scale
    low = np.floor(y)
    up = y - low >= 0.5 - min(noise * scale, 1e-6)
    return np.copysign((low + up) / scale, x) + 0.0


def rebuilt(kind: str, a, digits: int = 15) -> Column:
    """Product of the factors of a matrix, rounded."""

    @F.pandas_udf("array<array<double>>")
    def run(s: pd.Series) -> pd.Series:
        def product(m):
            out, *parts = _FORMS[kind](np.array([list(r) for r in m], float))
            for p in parts:
                out = out @ p
            return nearest(out, digits).tolist()

        return s.map(product, na_action="ignore")

    return run(col(a))
