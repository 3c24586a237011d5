"""Element-wise arithmetic and predicates.

``strict`` forms follow the vector notation where Spark differs: division by zero
gives infinities, NaN equals NaN and sorts below everything, the modulus takes the
sign of the divisor, shifts take any count.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def divide(a, b) -> Column:
    """Float quotient; x/0 is an infinity of x's sign (0/0 NaN), a negative zero
    divisor turns the sign."""
    a, b = col(a).cast("double"), col(b).cast("double")
    inf = F.when(b.cast("string").startswith("-"), F.lit(-INF)).otherwise(F.lit(INF))
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, inf).otherwise(-inf)
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, zero).otherwise(a / b)


def reciprocal(a) -> Column:
    return divide(F.lit(1.0), a)


def modulo(a, b) -> Column:
    """Floored modulus, sign of the divisor; modulus 0 is null."""
    a, b = col(a), col(b)
    r = a % F.when(b != 0, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def int_divide(a, b) -> Column:
    """Quotient cut toward zero.  A zero divisor gives the largest long with the
    sign of the numerator, 0 by 0 null; the least long by -1 is a range error."""
    a, b = col(a).cast("long"), col(b).cast("long")
    zero = F.when(a > 0, F.lit(2**63 - 1)).when(a < 0, F.lit(-(2**63) + 1))
    over = F.raise_error(F.lit("range")).cast("long")
    whole = F.call_function("div", a, F.when(b != 0, b))
    return F.when(b == 0, zero).when((b == -1) & (a == F.lit(-(2**63))), over).otherwise(whole)


def less(a, b) -> Column:
    """1 where a < b, NaN counting as least."""
    a, b = col(a), col(b)
    return F.when(F.isnan(b), 0).when(F.isnan(a), 1).otherwise((a < b).cast("int"))


def more(a, b) -> Column:
    return less(b, a)


def equal(a, b) -> Column:
    return (col(a) == col(b)).cast("int")


def match(a, b) -> Column:
    """Null-safe equality as 0/1."""
    return col(a).eqNullSafe(col(b)).cast("int")


def minimum(a, b) -> Column:
    """Lesser of two, NaN counting as least."""
    a, b = col(a), col(b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.least(a, b))


def maximum(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def not_(a) -> Column:
    return (col(a) == 0).cast("int")


def floor(a) -> Column:
    return F.floor(col(a)).cast("long")


def floor_float(a) -> Column:
    return F.floor(col(a)).cast("double")


def trunc(a) -> Column:
    a = col(a)
    return F.signum(a) * F.floor(F.abs(a))


def round_down(step: float, a) -> Column:
    """Largest multiple of a positive step not above a; smallest not below for a
    negative one.  A quotient within a few units in the last place of a whole
    number counts as that number."""
    q = col(a).cast("double") / abs(step)
    near = F.rint(q)
    whole = F.floor(q) if step > 0 else F.ceil(q)
    return F.when(F.abs(q - near) <= F.abs(q) * 4.5e-16, near).otherwise(whole.cast("double")) * abs(step)


def rounded(a, digits: int) -> Column:
    """Rounded to decimal digits as SQL does in doubles: scaled, a half away from
    zero, scaled back.  Spark rounds the shortest text of a double instead, which
    can end in a 5 that the scaled double misses, or the other way round."""
    scale = F.lit(10.0**digits)
    return F.round(col(a).cast("double") * scale, 0) / scale


def round_even(step, a) -> Column:
    """Nearest multiple, halves to even."""
    return col(step) * F.rint(col(a) / col(step))


def power(a, b) -> Column:
    """Float power; a negative base with a fractional exponent is a domain error."""
    a, b = col(a).cast("double"), col(b).cast("double")
    bad = (a < 0) & (b != F.floor(b))
    return F.when(bad, F.raise_error(F.lit("domain")).cast("double")).otherwise(F.pow(a, b))


def log(a) -> Column:
    """Natural logarithm; -inf at zero, NaN below."""
    a = col(a).cast("double")
    return F.when(a == 0, F.lit(-INF)).when(a < 0, F.lit(float("nan"))).otherwise(F.log(a))


def shift(a, n, bits: int = 64) -> Column:
    """Left shift, or right for a negative count, modulo the width, of longs or of
    32-bit ints."""
    a, n = col(a).cast("long" if bits == 64 else "int"), col(n).cast("int")
    return F.when(n < 0, F.call_function("shiftright", a, (-n) % bits)).otherwise(F.call_function("shiftleft", a, n % bits))


def rotate_bits(a, n, bits: int = 64) -> Column:
    """Rotation to the left of longs or of 32-bit ints."""
    a, k = col(a).cast("long" if bits == 64 else "int"), F.pmod(col(n).cast("int"), F.lit(bits))
    right = F.call_function("shiftrightunsigned", a, (bits - k) % bits)
    return F.when(k == 0, a).otherwise(F.call_function("shiftleft", a, k).bitwiseOR(right))


def choose(n, k) -> Column:
    """Binomial coefficient as a double."""
    n, k = col(n).cast("double"), col(k).cast("int")
    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (n - k + i) / i)


def cond(*args) -> Column:
    """cond(c1, v1, c2, v2, ..., default): first true condition's value."""
    *pairs, default = args
    out = None
    for c, v in zip(pairs[::2], pairs[1::2]):
        out = F.when(c, v) if out is None else out.when(c, v)
    return out.otherwise(default)


def _vector(fn):
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore").astype(float)

    return run


def _gamma(x: float) -> float:
    return math.nan if x <= 0 and x == math.floor(x) else math.gamma(x) if x < 171.7 else math.inf


def _lgamma(x: float) -> float:
    return math.nan if x <= 0 and x == math.floor(x) else math.lgamma(x)


def erf(a) -> Column:
    return _vector(math.erf)(col(a))


def erfc(a) -> Column:
    return _vector(math.erfc)(col(a))


def gamma(a) -> Column:
    return _vector(_gamma)(col(a))


def lgamma(a) -> Column:
    return _vector(_lgamma)(col(a))


#: Type codes of atoms by Spark type; a list of atoms is the negative.
TYPE_CODES = {"int": 1, "double": 2, "string": 4, "bigint": 8, "float": 9}


def type_code(df, column: str) -> int:
    """Type code of a column, known when the plan is made: positive for atoms,
    negative for lists of atoms, 5 for maps, 6 for null, 0 for other lists."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("array<"):
        return -TYPE_CODES.get(kind[6:-1], 0)
    return 5 if kind.startswith(("map<", "struct<")) else 6 if kind == "void" else TYPE_CODES.get(kind, 0)


def is_atom(df, column: str) -> int:
    """1 for a column of atoms, 0 for one of lists or maps."""
    return int(not dict(df.dtypes)[column].startswith(("array<", "map<", "struct<")))
