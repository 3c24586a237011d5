"""Calendar days and clock seconds counted from 2035-01-01."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiver.functions.expr import col

#: Day zero, and its seconds since 1970.
DAY_ZERO, EPOCH = "2035-01-01", 2051222400


def day_number(yyyymmdd) -> Column:
    """Days from 2035-01-01 of a YYYYMMDD integer."""
    return F.datediff(F.to_date(col(yyyymmdd).cast("string"), "yyyyMMdd"), F.lit(DAY_ZERO).cast("date"))


def from_day(n) -> Column:
    """YYYYMMDD integer of a day number."""
    return F.date_format(F.date_add(F.lit(DAY_ZERO).cast("date"), col(n).cast("int")), "yyyyMMdd").cast("int")


def yyyymmdd(ts) -> Column:
    return F.date_format(col(ts), "yyyyMMdd").cast("int")


def seconds(ts) -> Column:
    """Seconds from the start of 2035 of a timestamp."""
    return F.unix_timestamp(col(ts)) - F.lit(EPOCH)


def clock(n) -> Column:
    """(YYYYMMDD, HHMMSS) of seconds since the start of 2035, GMT."""
    t = F.timestamp_seconds(col(n) + F.lit(EPOCH))
    return F.struct(yyyymmdd(t).alias("day"), F.date_format(t, "HHmmss").cast("int").alias("time"))


def to_local(n, zone: str) -> Column:
    """Seconds of GMT to seconds of a zone's wall clock."""
    return seconds(F.from_utc_timestamp(F.timestamp_seconds(col(n) + F.lit(EPOCH)), zone))


def to_gmt(n, zone: str) -> Column:
    return seconds(F.to_utc_timestamp(F.timestamp_seconds(col(n) + F.lit(EPOCH)), zone))


def leap(year) -> Column:
    y = col(year)
    return (((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)).cast("int")


def days_in_month(ts) -> Column:
    return F.dayofmonth(F.last_day(col(ts)))


def now() -> Column:
    """(YYYYMMDD, HHMMSS) of the present moment, GMT; one for a whole query."""
    t = F.current_timestamp()
    return F.struct(yyyymmdd(t).alias("day"), F.date_format(t, "HHmmss").cast("int").alias("time"))
