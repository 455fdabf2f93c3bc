"""Tolerant number reading: text, blanks and non-finite values become NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """The value as double, or NULL when it is blank, text, NaN or infinite."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def truncated_int(value: Column) -> Column:
    """Number text -> whole number by dropping the fraction, NULL when not a number."""
    return finite(value).try_cast("long")


def first_finite(frame: DataFrame, names: Sequence[str], default: float = 0.0) -> Column:
    """First usable number among the columns that exist."""
    present = [finite(F.col(name)) for name in names if name in frame.columns]
    return F.coalesce(*present, F.lit(float(default)))


def present_text(value: Column) -> Column:
    """Trimmed text, blank as NULL."""
    text = F.trim(value.cast("string"))
    return F.when(text != "", text)
