"""Ratios and conditional aggregates that never raise on a zero denominator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double; null when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def safe_divide(numerator: Column, denominator: Column, alternate: float = 0.0) -> Column:
    """BI-style division: the alternate result replaces a null or x/0."""
    return F.coalesce(ratio(numerator, denominator), F.lit(alternate))


def relative_change(before: Column, after: Column) -> Column:
    return ratio(after - before, before)


def pct(value: Column, digits: int) -> Column:
    """A fraction as a rounded percentage."""
    return F.round(value * 100, digits)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_if(column: str, condition: Column) -> Column:
    return F.sum(F.when(condition, F.col(column)))


def mean_if(column: str, condition: Column) -> Column:
    return F.avg(F.when(condition, F.col(column)))


def round_columns(df, digits: dict[str, int]):
    """``df`` with each named double column rounded to its number of digits."""
    return df.withColumns({name: F.round(name, d) for name, d in digits.items()})
