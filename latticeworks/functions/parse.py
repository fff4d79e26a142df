"""Tolerant parsing of text columns. Whatever cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_float(c: Column, finite: bool = True) -> Column:
    """A number in text, blanks around it allowed. ``nan`` and ``inf`` are read only if ``finite`` is off."""
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    if finite:
        return number
    low = F.lower(text)
    special = F.when(low == "nan", F.lit(float("nan"))).when(low.isin("inf", "+inf", "infinity"), F.lit(float("inf"))).when(low.isin("-inf", "-infinity"), F.lit(float("-inf")))
    return F.coalesce(number, special)


def to_int(c: Column) -> Column:
    """A whole number in text; a fraction is cut towards zero, as ``17.9`` gives 17."""
    return to_float(c).try_cast("bigint")


def to_int_digits(c: Column) -> Column:
    """``to_int``, or else the first run of digits."""
    return F.coalesce(to_int(c), F.nullif(F.regexp_extract(c.cast("string"), r"(\d+)", 1), F.lit("")).try_cast("bigint"))


def to_bool(c: Column) -> Column:
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("1", "true", "t", "yes"), True).when(text.isin("0", "false", "f", "no"), False)


def decade(year: Column) -> Column:
    """``1970s`` of 1977; ``unknown`` of null."""
    return F.coalesce(F.concat((F.floor(year / 10) * 10).cast("int").cast("string"), F.lit("s")), F.lit("unknown"))


def last_of(values: Column) -> Column:
    """The last element of an array, null of an empty one."""
    return F.when(F.size(values) > 0, F.element_at(values, -1))


def rescale(x: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """Maps low..high onto to_low..to_high; the middle where low = high."""
    return F.when(high == low, F.lit((to_low + to_high) / 2)).otherwise(F.lit(to_low) + (x - low) / F.nullif(high - low, F.lit(0.0)) * (to_high - to_low))
