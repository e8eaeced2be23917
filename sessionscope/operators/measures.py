"""BI measures: ratios of sums in any grouping, zero-safe and unrounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.functions.calendar import as_date, date_lit, in_days, shift
from sessionscope.functions.rates import count_if, safe_divide, sum_if
from sessionscope.schema import LAUNCH_DATE, TRACKER_HALF_WINDOW


def _shown(df: DataFrame, name: str, digits: int | None) -> DataFrame:
    return df if digits is None else df.withColumn(name, F.round(name, digits))


def measure_cr(sessions: DataFrame, by: tuple = (), digits: int | None = None) -> DataFrame:
    """Conversion rate in the given filter context; no ``by`` gives the overall rate."""
    out = sessions.groupBy(*by).agg(
        safe_divide(F.sum("converted"), F.count("*")).alias("conversion_rate")
    )
    return _shown(out, "conversion_rate", digits)


def measure_rps(sessions: DataFrame, by: tuple = (), digits: int | None = None) -> DataFrame:
    out = sessions.groupBy(*by).agg(
        safe_divide(F.sum("revenue"), F.count("*")).alias("revenue_per_session")
    )
    return _shown(out, "revenue_per_session", digits)


def measure_cr_vs_baseline(sessions: DataFrame, by: tuple = ("date",), digits: int | None = None) -> DataFrame:
    """Rate of each group relative to the rate of everything.

    The total is one row of the same grouped rows, attached to each of them.
    """
    groups = sessions.groupBy(*by).agg(F.count("*").alias("n"), F.sum("converted").alias("c"))
    current = safe_divide(F.col("c"), F.col("n"))
    total = groups.agg(safe_divide(F.sum("c"), F.sum("n")).alias("_baseline"))
    baseline = F.col("_baseline")
    out = groups.crossJoin(F.broadcast(total)).select(
        *by,
        current.alias("conversion_rate"),
        safe_divide(current - baseline, baseline).alias("cr_vs_baseline"),
    )
    return _shown(_shown(out, "conversion_rate", digits), "cr_vs_baseline", digits)


def measure_cr_7d_calendar(sessions: DataFrame, days: int = 7, digits: int | None = None) -> DataFrame:
    """Ratio of sums over the last ``days`` calendar days; missing days stay missing."""
    daily = sessions.groupBy("date").agg(F.count("*").alias("n"), F.sum("converted").alias("c"))
    recent = Window.orderBy(F.unix_date("date")).rangeBetween(1 - days, 0)
    rolling = safe_divide(F.sum("c").over(recent), F.sum("n").over(recent))
    out = daily.select("date", rolling.alias("cr_7d_rolling_avg"))
    return _shown(out, "cr_7d_rolling_avg", digits).orderBy("date")


def measure_launch_lift(
    sessions: DataFrame,
    launch_date=LAUNCH_DATE,
    half_window: int = TRACKER_HALF_WINDOW,
    digits: int | None = None,
) -> DataFrame:
    """Relative lift of the rate after a launch inside the tracker window."""
    launch = as_date(launch_date)
    before = F.col("date") < date_lit(launch)
    totals = sessions.where(in_days(shift(launch, -half_window), shift(launch, half_window))).agg(
        safe_divide(sum_if("converted", before), count_if(before)).alias("pre"),
        safe_divide(sum_if("converted", ~before), count_if(~before)).alias("post"),
    )
    lift = safe_divide(F.col("post") - F.col("pre"), F.col("pre"))
    return _shown(totals.select(lift.alias("launch_lift")), "launch_lift", digits)
