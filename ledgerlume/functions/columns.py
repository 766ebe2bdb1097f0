"""Small column expressions; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000

#: Added to denominators of ratios.
EPSILON = 1e-9


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without zone (session zone UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def is_blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def ratio(a: Column, b: Column) -> Column:
    return a / (b + F.lit(EPSILON))


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def capped(c: Column, most: float = 1.0) -> Column:
    return F.least(F.lit(most), c)


def one_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(one_if(condition)), F.lit(0)).cast("long")


def ordered(value: Column, *by: str) -> Column:
    """Aggregate: value of every row, in the order of `by`."""
    keyed = F.sort_array(F.collect_list(F.struct(*by, value.alias("__v"))))
    return F.transform(keyed, lambda x: x["__v"])


def half_up(c: str | Column, digits: int) -> Column:
    """Rounded to so many digits, halves upwards, in plain double arithmetic."""
    value = F.col(c) if isinstance(c, str) else c
    return F.floor(value * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)
