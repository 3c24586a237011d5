"""Strings: glob matching and search, replacement, padding, formats, casts,
positional numerals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quiver.functions.expr import col


def glob(pattern: str) -> str:
    """Regular expression of a glob: ``*``, ``?``, ``[abc]``, ``[a-z]``, ``[^a]``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 1)
        if c == "[" and end > i:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + f"[{body}]", end
        else:
            out += "(?s:.*)" if c == "*" else "(?s:.)" if c == "?" else re.sub(r"([^\w\s])", r"\\\1", c)
        i += 1
    return out


def matches(a, pattern: str) -> Column:
    """1 where the whole string matches the glob."""
    return F.regexp_like(col(a), F.lit(f"^{glob(pattern)}$")).cast("int")


def find_all(a, pattern: str, word: bool = False) -> Column:
    """Start positions, from 0, of the non-overlapping matches of a glob; with
    ``word`` only of whole words."""
    from quiver.operators.cells import let, running

    rx = rf"(?<!\w){glob(pattern)}(?!\w)" if word else glob(pattern)
    found = F.regexp_extract_all(col(a), F.lit(f"({rx})"), F.lit(1))

    def starts(found: Column) -> Column:
        gaps = F.slice(F.split(col(a), rx, -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), lambda x, y: x + y)
        return F.zip_with(ends, found, lambda e, m: e - F.length(m))

    return let(found, starts)


def find_first(a, needle: str) -> Column:
    """Position of the first occurrence, from 0; -1 without one."""
    return F.locate(needle, col(a)) - 1


def replace(a, pattern: str, by) -> Column:
    """Every match of a glob replaced by a string, or by what a Python function
    makes of it (an Arrow UDF)."""
    rx = glob(pattern)
    if isinstance(by, str):
        return F.regexp_replace(col(a), rx, by.replace("\\", "\\\\").replace("$", "\\$"))
    py = re.compile(rx)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: py.sub(lambda m: by(m[0]), t), na_action="ignore")

    return run(col(a))


def pad(n: int, a) -> Column:
    """Right-justified in n columns (left for a negative n); longer text keeps
    its tail, or its head for a negative n."""
    a, w = col(a), abs(n)
    if n >= 0:
        return F.when(F.length(a) > w, F.substring(a, -w, w) if w else F.lit("")).otherwise(F.lpad(a, w, " "))
    return F.rpad(a, w, " ")


def number(width: int, digits: int, a) -> Column:
    """Fixed-point in a field; a number too wide is all ``*``."""
    s = F.format_string(f"%.{digits}f", col(a).cast("double"))
    return F.when(F.length(s) > width, F.lit("*" * width)).otherwise(F.lpad(s, width, " "))


def exponential(width: int, digits: int, a) -> Column:
    s = F.format_string(f"%.{digits}e", col(a).cast("double"))
    return F.when(F.length(s) > width, F.lit("*" * width)).otherwise(F.lpad(s, width, " "))


def parse(a, kind: str, strict: bool = False) -> Column:
    """Text to int, long, double or float; bad text is null, or a domain error."""
    a = F.trim(col(a))
    out = a.try_cast(kind)
    return F.when(out.isNull() & a.isNotNull() & (a != ""), F.raise_error(F.lit("domain")).cast(kind)).otherwise(out) if strict else out


def char_code(a) -> Column:
    return F.ascii(col(a))


def char_codes(a) -> Column:
    return F.transform(F.filter(F.split(col(a), ""), lambda c: c != ""), lambda c: F.ascii(c))


def from_codes(codes) -> Column:
    return F.array_join(F.transform(col(codes), lambda c: F.char(c)), "")


def encode_base(base: int, a, width: int = 1) -> Column:
    """Digits of a non-negative number, highest first, at least ``width`` of them; a
    negative number is a domain error."""
    a = col(a).cast("long")
    powers = F.array(*[F.lit(base**i).cast("long") for i in range(64) if base**i < 2**63])
    need = F.greatest(F.lit(width), F.size(F.filter(powers, lambda p: p <= a)))
    digit = lambda i: F.coalesce(F.call_function("div", a, F.get(powers, i)) % base, F.lit(0).cast("long"))
    digits = F.transform(F.sequence(need - 1, F.lit(0)), digit)
    return F.when(a < 0, F.raise_error(F.lit("domain"))).otherwise(digits)


def decode_base(base, digits) -> Column:
    """Value of digits, highest first, in a base or in a mixed radix (list)."""
    if isinstance(base, int):
        return F.aggregate(col(digits), F.lit(0).cast("long"), lambda acc, d: acc * base + d)
    pairs = F.arrays_zip(col(digits).alias("d"), F.array(*[F.lit(b) for b in base]).alias("b"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, x: acc * x["b"] + x["d"])


def encode_mixed(bases: list[int], a) -> Column:
    """Digits in a mixed radix; the first base is not bounded."""
    out, rest = [], col(a)
    for b in reversed(bases[1:]):
        out.append((rest % b).cast("long"))
        rest = F.floor(rest / b)
    return F.array(*[rest.cast("long"), *reversed(out)])


def each(a, digits: int = 7) -> Column:
    """Items of a list as text, numbers to ``digits`` significant digits, nulls empty."""
    return F.transform(col(a), lambda x: F.coalesce(significant(x, digits), F.lit("")))


def significant(a, digits: int = 7) -> Column:
    """A number to so many significant digits, without trailing zeros."""
    a = col(a).cast("double")
    size = F.floor(F.log10(F.abs(a))).cast("int")
    fixed = F.format_string("%s", F.bround(a.cast("decimal(38,18)"), 18))
    plain = F.array(*[F.format_string(f"%.{k}f", a) for k in range(digits + 5)])
    text = F.coalesce(F.get(plain, F.greatest(F.lit(digits - 1) - size, F.lit(0))), fixed)
    trimmed = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    science = F.regexp_replace(F.format_string(f"%.{digits - 1}e", a), r"\.?0*e", "e")
    return F.when(a == 0, F.lit("0")).when((size < -4) | (size >= digits), science).otherwise(trimmed)


#: Roman numerals, greatest first.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def to_roman(a) -> Column:
    """Roman numeral of a positive number."""
    rest, out = col(a).cast("int"), []
    for n, letters in ROMAN:
        out.append(F.repeat(F.lit(letters), F.floor(rest / n).cast("int")))
        rest = rest % n
    return F.concat(*out)


def from_roman(a) -> Column:
    """Value of a Roman numeral: a letter below the one after it counts against."""
    value = F.create_map(*[x for n, t in ROMAN if len(t) == 1 for x in (F.lit(t), F.lit(n))])
    digits = F.transform(F.filter(F.split(col(a), ""), lambda c: c != ""), lambda c: F.element_at(value, c))
    signed = F.transform(digits, lambda d, i: F.when(d < F.coalesce(F.get(digits, i + 1), F.lit(0)), -d).otherwise(d))
    return F.aggregate(signed, F.lit(0), lambda x, y: x + y)


def between_quotes(a) -> Column:
    """Texts between quotes."""
    return F.regexp_extract_all(col(a), F.lit('"([^"]*)"'), F.lit(1))
