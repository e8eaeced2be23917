"""Daily KPIs, rolling z-scores, anomaly boards and the feeds built on them.

Windows without partitions run on daily tables only: one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.functions.calendar import as_date, date_lit, in_days, shift, until_day
from sessionscope.functions.rates import count_if, mean_if, pct, ratio
from sessionscope.functions.rows import document_fields, stack_rows
from sessionscope.labels import (
    ANOMALY_FLAG,
    AT_RISK,
    CR_ALERT,
    DROP,
    HEALTHY,
    NO_ALERT,
    POST_LAUNCH,
    PRE_LAUNCH,
    RPS_ALERT,
    SPIKE,
)
from sessionscope.schema import (
    LAUNCH_DATE,
    MAX_BOUNCE_RATE,
    MAX_LOAD_MS,
    MIN_CONVERSION_RATE,
    ROLLING_WINDOW,
    TRACKER_HALF_WINDOW,
    Z_THRESHOLD,
)


def _beyond(z: Column, threshold: float) -> Column:
    """A missing z-score is never an anomaly."""
    return F.coalesce(F.abs(z) > threshold, F.lit(False))


def _zscore(value: Column, mean: Column, std: Column) -> Column:
    return F.round(ratio(value - mean, std), 3)


# --- inclusive rule: the window contains the day itself -------------------


def daily_kpis(
    sessions: DataFrame,
    window: int = ROLLING_WINDOW,
    z_threshold: float = Z_THRESHOLD,
    money_dp: int = 2,
    load_dp: int = 1,
    ma_dp: int | None = None,
) -> DataFrame:
    """One row per day: volumes, ratios, rolling means, spreads, z-scores, flags.

    Rolling values use unrounded inputs; ``ma_dp`` rounds them for comparison.
    """
    totals = sessions.groupBy("date").agg(
        F.count("*").alias("sessions"),
        F.sum("converted").alias("conversions"),
        F.sum("revenue").alias("total_revenue"),
        F.avg("page_load_ms").alias("avg_page_load_ms"),
        F.sum("bounced").alias("bounce_count"),
        F.avg("steps_completed").alias("avg_steps"),
    )
    n = F.col("sessions")
    daily = totals.withColumns(
        {
            "conversion_rate": ratio(F.col("conversions"), n),
            "bounce_rate": ratio(F.col("bounce_count"), n),
            "revenue_per_session": ratio(F.col("total_revenue"), n),
        }
    )
    days = Window.orderBy("date").rowsBetween(1 - window, 0)
    averaged = ("conversion_rate", "revenue_per_session", "avg_page_load_ms", "bounce_rate")
    spread = ("conversion_rate", "revenue_per_session")
    rolling = daily.withColumns(
        {f"{name}_7d_ma": F.avg(name).over(days) for name in averaged}
        | {f"{name}_7d_std": F.stddev_samp(name).over(days) for name in spread}
    )
    scored = rolling.withColumns(
        {
            short: _zscore(F.col(name), F.col(f"{name}_7d_ma"), F.col(f"{name}_7d_std"))
            for short, name in (("cr_zscore", spread[0]), ("rps_zscore", spread[1]))
        }
    )

    def shown(name: str) -> Column:
        return F.col(name) if ma_dp is None else F.round(name, ma_dp).alias(name)

    return scored.select(
        "date",
        "sessions",
        "conversions",
        F.round("total_revenue", 2).alias("total_revenue"),
        F.round("avg_page_load_ms", load_dp).alias("avg_page_load_ms"),
        "bounce_count",
        F.round("conversion_rate", 6).alias("conversion_rate"),
        F.round("bounce_rate", 6).alias("bounce_rate"),
        F.round("revenue_per_session", money_dp).alias("revenue_per_session"),
        shown("avg_steps"),
        *[shown(f"{name}_7d_ma") for name in averaged],
        *[shown(f"{name}_7d_std") for name in spread],
        "cr_zscore",
        "rps_zscore",
        _beyond(F.col("cr_zscore"), z_threshold).alias("cr_anomaly"),
        _beyond(F.col("rps_zscore"), z_threshold).alias("rps_anomaly"),
    ).orderBy("date")


def events_of(kpis: DataFrame) -> DataFrame:
    """The flagged days of a daily KPI table."""
    return kpis.where(F.col("cr_anomaly") | F.col("rps_anomaly")).select(
        "date", "conversion_rate", "cr_zscore", "total_revenue", "rps_zscore"
    )


def anomaly_events_inclusive(sessions: DataFrame, **params) -> DataFrame:
    return events_of(daily_kpis(sessions, **params)).orderBy("date")


def tracker_of(kpis: DataFrame, launch_date=LAUNCH_DATE, half_window: int = TRACKER_HALF_WINDOW) -> DataFrame:
    """Days around a launch out of a daily KPI table, rolling means untouched."""
    launch = as_date(launch_date)
    around = F.col("date").between(
        date_lit(shift(launch, -half_window)), date_lit(shift(launch, half_window))
    )
    return kpis.where(around).select(
        "date",
        "conversion_rate",
        "conversion_rate_7d_ma",
        "sessions",
        "total_revenue",
        F.when(F.col("date") < date_lit(launch), PRE_LAUNCH).otherwise(POST_LAUNCH).alias("period"),
    )


def launch_tracker(
    sessions: DataFrame,
    launch_date=LAUNCH_DATE,
    half_window: int = TRACKER_HALF_WINDOW,
    window: int = ROLLING_WINDOW,
    ma_dp: int | None = None,
) -> DataFrame:
    """Rolling mean first, filter second: the first day keeps its full window.

    Frames count day rows, so a gap can reach back any number of dates: days
    after the window are never read, days before it are.
    """
    known = sessions.where(until_day(shift(launch_date, half_window)))
    return tracker_of(daily_kpis(known, window, ma_dp=ma_dp), launch_date, half_window).orderBy("date")


def digest_of(kpis: DataFrame, digits: int | None = None) -> DataFrame:
    """Per week since the first day: means, revenue, CR-anomaly days, baselines."""
    everything = Window.partitionBy()
    numbered = kpis.withColumns(
        {
            "week_num": (
                F.floor(F.datediff("date", F.min("date").over(everything)) / F.lit(7)) + 1
            ).cast("int"),
            "baseline_cr": F.avg("conversion_rate").over(everything),
            "baseline_rps": F.avg("revenue_per_session").over(everything),
        }
    )
    flagged = F.when(F.col("cr_anomaly"), F.col("date").cast("string"))
    weekly = numbered.groupBy("week_num").agg(
        F.min("date").alias("week_start"),
        F.max("date").alias("week_end"),
        (F.avg("conversion_rate") * 100).alias("avg_cr_pct"),
        F.avg("revenue_per_session").alias("avg_rps"),
        F.round(F.sum("total_revenue"), 2).alias("total_revenue"),
        F.avg("avg_page_load_ms").alias("avg_load_ms"),
        F.count(flagged).alias("anomaly_days"),
        # At most seven dates.
        F.array_join(F.array_sort(F.collect_list(flagged)), ",").alias("anomaly_dates"),
        (F.first("baseline_cr") * 100).alias("overall_avg_cr_pct"),
        F.first("baseline_rps").alias("overall_avg_rps"),
    )
    means = ("avg_cr_pct", "avg_rps", "avg_load_ms", "overall_avg_cr_pct", "overall_avg_rps")
    if digits is not None:
        weekly = weekly.withColumns({name: F.round(name, digits) for name in means})
    return weekly.orderBy("week_num")


def weekly_digest(sessions: DataFrame, digits: int | None = None, **params) -> DataFrame:
    return digest_of(daily_kpis(sessions, **params), digits)


def flag_days(kpis: DataFrame, events: DataFrame) -> DataFrame:
    """Marks each KPI day by whether the event table holds its date."""
    hit = events.select("date").distinct().withColumn("_hit", F.lit(True))
    flag = F.when(F.col("_hit"), ANOMALY_FLAG).otherwise(NO_ALERT)
    return kpis.join(hit, "date", "left").withColumn("has_anomaly", flag).drop("_hit")


def has_anomaly(sessions: DataFrame, **params) -> DataFrame:
    """KPI days with their event mark.

    Both join sides come from the same daily table with the same columns, so
    the day aggregation runs once and its exchange is reused.
    """
    kpis = daily_kpis(sessions, **params)
    return (
        flag_days(kpis, events_of(kpis))
        .select("date", "conversion_rate", "cr_zscore", "rps_zscore", "has_anomaly")
        .orderBy("date")
    )


# --- exclusive rule: the window ends the day before ------------------------


def _exclusive_scores(sessions: DataFrame, money_dp: int, load_dp: int) -> DataFrame:
    """Scores against the six days before, on values rounded first."""
    daily = sessions.groupBy("date").agg(
        F.count("*").alias("sessions"),
        pct(F.avg("converted"), 6).alias("cr_pct"),
        F.round(F.avg("revenue"), money_dp).alias("rps_inr"),
        F.round(F.avg("page_load_ms"), load_dp).alias("avg_load_ms"),
    )
    before = Window.orderBy("date").rowsBetween(1 - ROLLING_WINDOW, -1)

    def score(name: str) -> Column:
        return _zscore(F.col(name), F.avg(name).over(before), F.stddev_samp(name).over(before))

    return daily.withColumns(
        {
            "cr_rolling_mean": F.avg("cr_pct").over(before),
            "cr_zscore": score("cr_pct"),
            "rps_zscore": score("rps_inr"),
        }
    )


def anomaly_status(
    sessions: DataFrame,
    z_threshold: float = Z_THRESHOLD,
    money_dp: int = 2,
    load_dp: int = 1,
    ma_dp: int | None = None,
) -> DataFrame:
    """Every day with its scores and alert; conversion outranks revenue."""
    scored = _exclusive_scores(sessions, money_dp, load_dp)
    alert = (
        F.when(_beyond(F.col("cr_zscore"), z_threshold), CR_ALERT)
        .when(_beyond(F.col("rps_zscore"), z_threshold), RPS_ALERT)
        .otherwise(NO_ALERT)
    )
    mean = F.col("cr_rolling_mean")
    return scored.select(
        "date",
        "sessions",
        "cr_pct",
        (mean if ma_dp is None else F.round(mean, ma_dp)).alias("cr_rolling_mean"),
        "cr_zscore",
        "rps_inr",
        "rps_zscore",
        alert.alias("alert_status"),
    ).orderBy("date")


def anomaly_events(sessions: DataFrame, z_threshold: float = Z_THRESHOLD) -> DataFrame:
    """Only the days whose conversion score passes the threshold, DROP or SPIKE."""
    z = F.col("cr_zscore")
    return (
        _exclusive_scores(sessions, 2, 1)
        .where(_beyond(z, z_threshold))
        .select(
            "date",
            "sessions",
            "cr_pct",
            z.alias("cr_z"),
            F.when(z < 0, DROP).otherwise(SPIKE).alias("anomaly_type"),
        )
        .orderBy("date")
    )


def launch_tracker_sql(
    sessions: DataFrame,
    launch_date=LAUNCH_DATE,
    days: tuple = ("2024-04-10", "2024-05-31"),
    window: int = ROLLING_WINDOW,
    ma_dp: int | None = None,
) -> DataFrame:
    """Filter first, rolling mean second: the mean starts cold on the first day."""
    daily = sessions.where(in_days(*days)).groupBy("date").agg(F.avg("converted").alias("rate"))
    rolling = F.avg("rate").over(Window.orderBy("date").rowsBetween(1 - window, 0)) * 100
    return daily.select(
        "date",
        pct(F.col("rate"), 4).alias("daily_cr_pct"),
        (rolling if ma_dp is None else F.round(rolling, ma_dp)).alias("cr_7d_ma_pct"),
        F.when(F.col("date") >= date_lit(launch_date), 1).otherwise(0).alias("post_launch"),
    ).orderBy("date")


# --- driver health ----------------------------------------------------------


def driver_health(
    sessions: DataFrame, category: str = "Electronics", money_dp: int = 2, load_dp: int = 0, steps_dp: int = 2
) -> DataFrame:
    """One aggregate row turned into ``(driver, metric, value, unit, status)``."""

    def rate_where(column: str, value: str) -> Column:
        return pct(mean_if("converted", F.col(column) == value), 3)

    organic = F.col("traffic_source") == "organic_search"
    totals = sessions.agg(
        F.avg("converted").alias("cr"),
        F.avg("page_load_ms").alias("load"),
        F.avg("bounced").alias("bounce"),
        F.round(F.avg("revenue"), money_dp).alias("rps"),
        rate_where("device", "mobile").alias("mobile"),
        rate_where("product_category", category).alias("category"),
        pct(ratio(count_if(organic), F.count("*")), 1).alias("organic"),
        rate_where("traffic_source", "paid_search").alias("paid"),
        F.round(F.avg("steps_completed"), steps_dp).alias("steps"),
    )
    slow = F.when(F.col("load") > MAX_LOAD_MS, AT_RISK).otherwise(HEALTHY)
    bouncing = F.when(F.col("bounce") > MAX_BOUNCE_RATE, AT_RISK).otherwise(HEALTHY)
    converting = F.when(F.col("cr") >= MIN_CONVERSION_RATE, HEALTHY).otherwise(AT_RISK)
    page, price, discovery = "Page Experience", "Price & Value", "Discovery"
    rows = [
        ("Conversion Rate", "conversion_rate", pct(F.col("cr"), 3), "%", converting),
        (page, "page_load_speed", F.round("load", load_dp), "ms", slow),
        (page, "bounce_rate", pct(F.col("bounce"), 2), "%", bouncing),
        (page, "mobile_experience", F.col("mobile"), "%", HEALTHY),
        (price, "revenue_per_session", F.col("rps"), "₹", HEALTHY),
        (price, f"{category.lower()}_cr", F.col("category"), "%", HEALTHY),
        (discovery, "organic_share", F.col("organic"), "%", HEALTHY),
        (discovery, "paid_cr", F.col("paid"), "%", HEALTHY),
        ("Product Quality", "avg_steps_completed", F.col("steps"), "steps", HEALTHY),
    ]
    return stack_rows(totals, ["driver", "metric", "value", "unit", "status"], rows)


# The names of the branches in the health document.
HEALTH_BRANCHES = {
    "page_experience": "Page Experience",
    "price_value": "Price & Value",
    "discovery": "Discovery",
    "product_quality": "Product Quality",
}


def driver_health_document(health: DataFrame) -> DataFrame:
    """The nine health rows as one document row: the north star and a branch per driver.

    Load time decides the status of its branch.
    """
    detail = F.struct("value", "unit", "status")

    def branch(name: str) -> Column:
        own = F.col("driver") == name
        status = F.max(F.when(own & (F.col("metric") == "page_load_speed"), F.col("status")))
        found = F.sort_array(F.collect_list(F.when(own, F.struct("metric", detail.alias("detail")))))
        return F.struct(
            F.lit(name).alias("name"),
            F.coalesce(status, F.lit(HEALTHY)).alias("status"),
            F.map_from_entries(found).alias("sub_drivers"),
        )

    star = F.max(F.when(F.col("metric") == "conversion_rate", F.struct(F.col("driver").alias("name"), "value", "unit", "status")))
    return health.agg(star.alias("north_star"), *[branch(name).alias(key) for key, name in HEALTH_BRANCHES.items()])


def driver_health_fields(sessions: DataFrame, **params) -> DataFrame:
    """Every field of the health document: ``path, text, number``; parameters as in ``driver_health``."""
    return document_fields(driver_health_document(driver_health(sessions, **params)))
