"""Integers: gcd and lcm as Column folds, primality, factors and inverses as
Arrow UDFs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quiver.functions.expr import col

LONG_MAX = 2**63 - 1
#: Bases that decide primality of every 64-bit number.
WITNESSES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def is_prime(n: int) -> bool:
    if n < 2:
        return False
    for p in WITNESSES:
        if n % p == 0:
            return n == p
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in WITNESSES:
        x = pow(a, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def factors(n: int) -> list[int]:
    """Prime factors with repeats, in order."""
    if n < 2:
        return [n]
    out, todo = [], [n]
    while todo:
        m = todo.pop()
        if m == 1:
            continue
        small = next((p for p in WITNESSES if m % p == 0), None)
        if small or is_prime(m):
            out.append(small or m)
            todo.append(m // (small or m))
            continue
        d = _split(m)
        todo += [d, m // d]
    return sorted(out)


def _split(m: int) -> int:
    """A proper divisor of a composite, by cycle detection of x*x + c."""
    for c in range(1, m):
        slow = fast = 2
        product, steps = 1, 0
        while True:
            slow = (slow * slow + c) % m
            fast = (fast * fast + c) % m
            fast = (fast * fast + c) % m
            steps += 1
            d = math.gcd(abs(slow - fast), m)
            if d > 1:
                break
        if d != m:
            return d
    return m


def _known(fn, kind: str, a) -> Column:
    """fn of every distinct number of a batch; numbers come as text, so that nulls
    among them cost no digits."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        known = {v: fn(int(v)) for v in s.dropna().unique()}
        return s.map(lambda v: known.get(v), na_action="ignore").astype(object)

    return run(col(a).cast("long").cast("string"))


def prime(a) -> Column:
    return _known(lambda n: int(is_prime(n)), "int", a)


def factor(a) -> Column:
    return _known(factors, "array<long>", a)


def gcd(a, b) -> Column:
    """Greatest common divisor by a bounded Euclid fold (92 steps suffice for longs)."""
    start = F.struct(F.abs(col(a).cast("long")).alias("x"), F.abs(col(b).cast("long")).alias("y"))
    step = lambda acc, _: F.when(acc["y"] == 0, acc).otherwise(F.struct(acc["y"].alias("x"), (acc["x"] % acc["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["x"]


def lcm(a, b) -> Column:
    """Least common multiple; beyond a long, the largest long."""
    x, y, g = F.abs(col(a).cast("long")), F.abs(col(b).cast("long")), gcd(a, b)
    part = F.call_function("div", x, F.when(g != 0, g))
    over = part > F.call_function("div", F.lit(LONG_MAX), F.when(y != 0, y))
    return F.when(x.isNull() | y.isNull(), None).when((x == 0) | (y == 0), F.lit(0).cast("long")).when(over, F.lit(LONG_MAX)).otherwise(part * y)


def modinv(a, m) -> Column:
    """Inverse of a modulo m; -1 where there is none.  A bounded Euclid fold."""
    a, m = col(a).cast("long"), col(m).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    start = F.struct(m.alias("r"), F.pmod(a, F.when(m > 0, m)).alias("s"), zero.alias("t"), one.alias("u"))

    def step(acc, _):
        q = F.call_function("div", acc["r"], acc["s"])
        nxt = F.struct(acc["s"].alias("r"), (acc["r"] - q * acc["s"]).alias("s"), acc["u"].alias("t"), (acc["t"] - q * acc["u"]).alias("u"))
        return F.when(acc["s"] == 0, acc).otherwise(nxt)

    from quiver.operators.cells import let

    got = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)
    value = let(got, lambda x: F.when(x["r"] == 1, F.pmod(x["t"], m)).otherwise(F.lit(-1).cast("long")))
    return F.when(a.isNull() | m.isNull(), None).when(m <= 0, F.lit(-1).cast("long")).otherwise(value)
