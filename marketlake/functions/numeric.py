"""Null-safe numbers: NaN is missing at every boundary, division by zero is null, rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(col: Column) -> Column:
    """NaN to null, so that comparisons and aggregates skip it."""
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the divisor is zero or null."""
    return F.try_divide(top, F.when(bottom != 0, bottom))


def to_float(text: Column) -> Column:
    """A number, or null for text that is none."""
    return F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double")


def flag_one(text: Column) -> Column:
    """True for the text 1 alone; any other text, also true, is false."""
    return F.coalesce(F.trim(text) == "1", F.lit(False))


def text_or_null(text: Column) -> Column:
    return F.nullif(F.btrim(text, F.lit(" \t\n\x0b\f\r")), F.lit(""))


def half_even(col: Column, digits: int = 0) -> Column:
    """The scaled double rounded to the nearest whole, ties to even, and scaled back; without negative zero."""
    scale = float(10**digits)
    return F.rint(col * scale) / scale + F.lit(0.0)


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))
