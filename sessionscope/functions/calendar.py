"""Dates, period strings and date-range predicates.

Range predicates compare the raw ``timestamp`` with literals, so both bounds
reach the Parquet scan, and repeat the range on ``date`` so that a table
partitioned by ``date`` is pruned as well.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value: str | date) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)


def shift(value: str | date, days: int) -> date:
    return as_date(value) + timedelta(days=days)


def date_lit(value: str | date) -> Column:
    return F.lit(as_date(value))


def _midnight(value: str | date) -> Column:
    return F.lit(f"{as_date(value)} 00:00:00").cast("timestamp_ntz")


def in_days(first: str | date, last: str | date) -> Column:
    """Sessions from ``first`` to ``last``, both days included."""
    ts = F.col("timestamp")
    whole_days = (ts >= _midnight(first)) & (ts < _midnight(shift(last, 1)))
    return whole_days & F.col("date").between(date_lit(first), date_lit(last))


def until_day(last: str | date) -> Column:
    """Sessions up to and including ``last``."""
    return (F.col("timestamp") < _midnight(shift(last, 1))) & (F.col("date") <= date_lit(last))


def week_start(day: Column) -> Column:
    """Monday of the week; date arithmetic only, so no session time zone."""
    return F.date_sub(day, F.weekday(day))


def calendar_sql(timestamp: str) -> dict[str, str]:
    """The derived columns of a timestamp as SQL text.

    ``week`` is ``Monday/Sunday`` in ISO dates, ``month`` is ``yyyy-MM``.
    """
    day = f"to_date({timestamp})"
    monday = f"date_sub({day}, weekday({day}))"
    return {
        "date": day,
        "week": f"concat_ws('/', CAST({monday} AS STRING), CAST(date_add({monday}, 6) AS STRING))",
        "month": f"date_format({day}, 'yyyy-MM')",
        "hour": f"hour({timestamp})",
    }
