"""The conversion-rate north star, its drivers and the metrics tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.functions.rates import count_if, mean_if, pct, ratio, sum_if
from sessionscope.functions.rows import document_fields, stack_rows
from sessionscope.functions.stats import correlation_t, student_p
from sessionscope.labels import AT_RISK_LABEL, BAD_MARK, GOOD_MARK, HEALTHY_LABEL
from sessionscope.operators.rollup import dimension_rollup
from sessionscope.schema import (
    MAX_BOUNCE_RATE,
    MAX_LOAD_MS,
    MAX_MOBILE_GAP,
    MIN_ORGANIC_SHARE_PCT,
    MIN_REVENUE_PER_SESSION,
    ROLLING_WINDOW,
)

# The branches of the metrics tree.
STAR = "North Star"
PAGE = "Page Experience"
PRICE = "Price & Value"
DISCOVERY = "Discovery"
QUALITY = "Product Quality"


def mark(good: Column) -> Column:
    return F.when(good, GOOD_MARK).otherwise(BAD_MARK)


def north_star(sessions: DataFrame, money_dp: int = 2) -> DataFrame:
    """One row: volume, conversion rate and revenue over everything."""
    return sessions.agg(
        F.lit("North Star Metric").alias("metric_name"),
        F.count("*").alias("total_sessions"),
        F.sum("converted").alias("total_conversions"),
        pct(F.avg("converted"), 3).alias("conversion_rate_pct"),
        F.round(F.sum("revenue"), 2).alias("total_revenue_inr"),
        F.round(F.avg("revenue"), money_dp).alias("revenue_per_session_inr"),
    )


def north_star_daily_stats(sessions: DataFrame) -> DataFrame:
    """One row: overall rate beside the mean and spread of the daily rates."""
    daily = sessions.groupBy("date").agg(
        F.count("*").alias("n"), F.sum("converted").alias("c"), F.sum("revenue").alias("r")
    )
    rate = ratio(F.col("c"), F.col("n"))
    return daily.agg(
        F.lit("Conversion Rate").alias("north_star_metric"),
        pct(ratio(F.sum("c"), F.sum("n")), 3).alias("overall_cr"),
        pct(F.avg(rate), 3).alias("avg_daily_cr"),
        pct(F.stddev_samp(rate), 4).alias("cr_std"),
        F.sum("n").alias("total_sessions"),
        F.sum("c").alias("total_conversions"),
        F.round(F.sum("r"), 2).alias("total_revenue_inr"),
    )


def daily_cr(sessions: DataFrame, window: int = ROLLING_WINDOW) -> DataFrame:
    """One row per day with a rolling mean of the daily rates.

    The unpartitioned window sees one row per calendar day, never sessions.
    """
    daily = sessions.groupBy("date").agg(
        F.count("*").alias("sessions"),
        F.sum("converted").alias("conversions"),
        F.avg("converted").alias("rate"),
        F.sum("revenue").alias("revenue"),
    )
    rolling = Window.orderBy("date").rowsBetween(1 - window, 0)
    return daily.select(
        "date",
        "sessions",
        "conversions",
        pct(F.col("rate"), 4).alias("cr_pct"),
        F.round("revenue", 2).alias("daily_revenue"),
        pct(F.avg("rate").over(rolling), 4).alias("cr_7d_rolling_avg_pct"),
    ).orderBy("date")


def driver_page_experience(sessions: DataFrame, load_dp: int = 1) -> DataFrame:
    mobile = mean_if("converted", F.col("device") == "mobile")
    desktop = mean_if("converted", F.col("device") == "desktop")
    return sessions.agg(
        F.lit(PAGE).alias("driver"),
        F.round(F.avg("page_load_ms"), load_dp).alias("avg_page_load_ms"),
        pct(F.avg("bounced"), 3).alias("bounce_rate_pct"),
        pct(mobile, 4).alias("mobile_cr_pct"),
        pct(desktop, 4).alias("desktop_cr_pct"),
        pct(desktop - mobile, 4).alias("mobile_gap_pp"),
    )


def _correlation(sessions: DataFrame) -> DataFrame:
    both = F.col("page_load_ms").isNotNull() & F.col("converted").isNotNull()
    # `corr` raises on a constant column in ANSI mode; this form gives null.
    spread = F.stddev_pop("page_load_ms") * F.stddev_pop("converted")
    r = ratio(F.covar_pop("page_load_ms", "converted"), spread)
    return sessions.where(both).agg(r.alias("r"), F.count("*").alias("n"))


def load_cr_correlation(sessions: DataFrame, digits: int = 4) -> DataFrame:
    """Pearson r of load time and conversion, with its two-sided p value."""
    r, n = F.col("r"), F.col("n")
    return _correlation(sessions).select(
        F.round(r, digits).alias("correlation_with_cr"),
        F.round(student_p(correlation_t(r, n), n - 2), 6).alias("p_value"),
        n.alias("sessions"),
    )


def driver_discovery(sessions: DataFrame) -> DataFrame:
    """Traffic mix: one row per source with its share of all sessions."""
    by_source = sessions.groupBy("traffic_source").agg(
        F.count("*").alias("sessions"),
        F.avg("converted").alias("rate"),
        F.sum("revenue").alias("revenue"),
    )
    total = F.sum("sessions").over(Window.partitionBy())
    return by_source.select(
        "traffic_source",
        "sessions",
        pct(ratio(F.col("sessions"), total), 2).alias("traffic_share_pct"),
        pct(F.col("rate"), 4).alias("cr_pct"),
        F.round("revenue", 2).alias("revenue"),
    ).orderBy(F.desc("sessions"), "traffic_source")


def paid_vs_organic(sessions: DataFrame) -> DataFrame:
    source = F.col("traffic_source")
    paid = mean_if("converted", source == "paid_search")
    organic = mean_if("converted", source == "organic_search")
    share = pct(ratio(count_if(source == "organic_search"), F.count("*")), 2)
    return sessions.agg(
        share.alias("organic_share_pct"),
        mark(share >= MIN_ORGANIC_SHARE_PCT).alias("organic_status"),
        pct(paid, 3).alias("paid_cr_pct"),
        pct(organic, 3).alias("organic_cr_pct"),
        pct(paid - organic, 3).alias("paid_vs_organic_pp"),
    )


def driver_product_quality(sessions: DataFrame, money_dp: int = 2) -> DataFrame:
    """Per category: conversion rate and mean revenue of the converted."""
    return (
        sessions.groupBy("product_category")
        .agg(
            F.count("*").alias("sessions"),
            F.sum("converted").alias("conversions"),
            pct(F.avg("converted"), 4).alias("cr_pct"),
            F.round(mean_if("revenue", F.col("converted") == 1), money_dp).alias("avg_order_value_inr"),
        )
        .orderBy(F.desc("cr_pct"), "product_category")
    )


def funnel(sessions: DataFrame) -> DataFrame:
    """Rows per funnel depth, their share, and the change against the depth before."""
    by_step = sessions.groupBy("steps_completed").agg(F.count("*").alias("users_at_step"))
    n = F.col("users_at_step")
    previous = F.lag(n).over(Window.orderBy("steps_completed"))
    return by_step.select(
        "steps_completed",
        "users_at_step",
        pct(ratio(n, F.sum(n).over(Window.partitionBy())), 2).alias("pct_of_sessions"),
        pct(ratio(n - previous, previous), 2).alias("pct_change_vs_prev_step"),
    ).orderBy("steps_completed")


def driver_price(sessions: DataFrame, money_dp: int = 2) -> DataFrame:
    """Long form: revenue per session, order value by category, rate by source."""
    rollup = dimension_rollup(
        sessions,
        ("product_category", "traffic_source"),
        n=F.count("*"),
        c=F.sum("converted"),
        revenue=F.sum("revenue"),
        sold=sum_if("revenue", F.col("converted") == 1),
    )
    aov = ratio(F.col("sold"), F.col("c"))
    rps = ratio(F.col("revenue"), F.col("n"))
    dim = F.col("dimension")
    by_category = dim == "product_category"
    value = (
        F.when(dim == "all", F.round(rps, money_dp))
        .when(by_category, F.round(aov, money_dp))
        .otherwise(pct(ratio(F.col("c"), F.col("n")), 3))
    )
    metric = (
        F.when(dim == "all", "revenue_per_session")
        .when(by_category, "category_aov")
        .otherwise("traffic_source_cr")
    )
    status = F.when(dim == "all", mark(rps >= MIN_REVENUE_PER_SESSION))
    return rollup.where(~by_category | aov.isNotNull()).select(
        metric.alias("metric"),
        F.when(dim != "all", F.col("key")).alias("key"),
        value.alias("value"),
        status.alias("status"),
    )


def _visitor_totals(sessions: DataFrame) -> DataFrame:
    """One row: sessions and conversions of returning and of single visitors.

    Users collapse to one row each (map-side first), so a user who owns a
    large share of all sessions costs a single row per map task.
    """
    per_user = sessions.groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum("converted").alias("c")
    )
    returning = F.col("user_id").isNotNull() & (F.col("n") > 1)
    return per_user.agg(
        sum_if("n", returning).alias("returning_sessions"),
        sum_if("c", returning).alias("returning_conversions"),
        sum_if("n", ~returning).alias("new_sessions"),
        sum_if("c", ~returning).alias("new_conversions"),
    )


def _visitor_rates() -> tuple[Column, Column]:
    return (
        ratio(F.col("returning_conversions"), F.col("returning_sessions")),
        ratio(F.col("new_conversions"), F.col("new_sessions")),
    )


def return_visitor_cr(sessions: DataFrame) -> DataFrame:
    """Conversion rate of users seen more than once against the others."""
    returning, new = _visitor_rates()
    return _visitor_totals(sessions).select(
        F.coalesce("returning_sessions", F.lit(0)).alias("returning_sessions"),
        F.coalesce("new_sessions", F.lit(0)).alias("new_sessions"),
        pct(returning, 3).alias("returning_cr_pct"),
        pct(new, 3).alias("new_visitor_cr_pct"),
        pct(returning - new, 3).alias("loyalty_lift_pp"),
    )


def returning_semi_anti(sessions: DataFrame) -> DataFrame:
    """The same split by semi and anti join on the set of returning users.

    Sessions are reduced to one row per user before the joins.  The joins compare all three columns, which
    for one row per user is the same as comparing users: all four inputs are then the same
    aggregation, scanned and shuffled once.
    """
    per_user = sessions.groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum("converted").alias("c")
    )
    names = {"user_id": "seen_user", "n": "seen_n", "c": "seen_c"}
    # A test of the id alone, or a plain equality of ids, would be moved below the aggregation of one input only.
    returning = F.when(F.col("user_id").isNotNull(), F.col("n")) > 1
    seen_again = per_user.where(returning).withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(seen)) for name, seen in names.items()])

    def side(label: str, how: str) -> DataFrame:
        return per_user.join(seen_again, same, how).agg(
            F.lit(label).alias("visitor_type"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("sessions"),
            F.coalesce(F.sum("c"), F.lit(0)).alias("conversions"),
            pct(ratio(F.sum("c"), F.sum("n")), 4).alias("cr_pct"),
        )

    return side("returning", "left_semi").unionByName(side("new", "left_anti"))


def _entry(driver: str, metric: str, key: Column | str, value: Column, status: Column | None = None):
    text = "string"
    return F.struct(
        F.lit(driver).alias("driver"),
        F.lit(metric).alias("metric"),
        (F.lit(key) if isinstance(key, str) else key).cast(text).alias("key"),
        value.cast("double").alias("value"),
        (F.lit(None) if status is None else status).cast(text).alias("status"),
    )


def _rollup_entries(sessions: DataFrame, money_dp: int) -> DataFrame:
    """Everything that adds up: one rollup pass, days included."""
    rollup = dimension_rollup(
        sessions,
        together=("device", "traffic_source", "product_category", "steps_completed"),
        alone=("date",),
        n=F.count("*"),
        c=F.sum("converted"),
        revenue=F.sum("revenue"),
        load=F.sum("page_load_ms"),
        bounced=F.sum("bounced"),
        sold=sum_if("revenue", F.col("converted") == 1),
        moments=("page_load_ms", "converted"),
    )
    everything = Window.partitionBy()
    dim, key = F.col("dimension"), F.col("key")
    n, rate = F.col("n"), ratio(F.col("c"), F.col("n"))

    def overall(value: Column, dimension: str, name: str | None = None) -> Column:
        here = (dim == dimension) if name is None else (dim == dimension) & (key == name)
        return F.max(F.when(here, value)).over(everything)

    day_rate = F.when(dim == "date", rate)
    # The window covers the rollup: one row per dimension value and per day.
    facts = rollup.withColumns(
        {
            "total": overall(n, "all"),
            "daily_mean": F.avg(day_rate).over(everything),
            "daily_std": F.stddev_samp(day_rate).over(everything),
            "mobile": overall(rate, "device", "mobile"),
            "desktop": overall(rate, "device", "desktop"),
            "organic": overall(rate, "traffic_source", "organic_search"),
            "paid": overall(rate, "traffic_source", "paid_search"),
            "organic_n": F.coalesce(overall(n, "traffic_source", "organic_search"), F.lit(0)),
        }
    )
    share = pct(ratio(n, F.col("total")), 2)
    gap = F.col("desktop") - F.col("mobile")
    wide_gap = F.coalesce(gap > MAX_MOBILE_GAP, F.lit(False))
    load, bounce = ratio(F.col("load"), n), ratio(F.col("bounced"), n)
    rps = ratio(F.col("revenue"), n)
    organic_share = pct(ratio(F.col("organic_n"), n), 2)

    # The rollup is small, and only its total has moments.
    correlated, r = F.col("n_xy"), ratio(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))
    facts = facts.withColumn("r", F.when(dim == "all", r))
    facts = facts.withColumn("p", student_p(correlation_t(F.col("r"), correlated), correlated - 2))

    all_entries = F.array(
        _entry(PAGE, "page_load_speed", "correlation_with_cr", F.round("r", 4)),
        _entry(PAGE, "page_load_speed", "p_value", F.round("p", 6)),
        _entry(STAR, "overall_cr", "", pct(rate, 3)),
        _entry(STAR, "avg_daily_cr", "", pct(F.col("daily_mean"), 3)),
        _entry(STAR, "cr_std", "", pct(F.col("daily_std"), 4)),
        _entry(STAR, "total_sessions", "", n),
        _entry(STAR, "total_conversions", "", F.col("c")),
        _entry(STAR, "total_revenue_inr", "", F.round("revenue", 2)),
        _entry(PAGE, "page_load_speed", "avg_ms", F.round(load, money_dp), mark(load <= MAX_LOAD_MS)),
        _entry(PAGE, "bounce_rate", "pct", pct(bounce, 2), mark(bounce <= MAX_BOUNCE_RATE)),
        _entry(PAGE, "mobile_experience", "mobile_cr", pct(F.col("mobile"), 3)),
        _entry(PAGE, "mobile_experience", "desktop_cr", pct(F.col("desktop"), 3)),
        _entry(PAGE, "mobile_experience", "gap_vs_desktop", pct(gap, 3), mark(~wide_gap)),
        _entry(PRICE, "revenue_per_session", "", F.round(rps, money_dp), mark(rps >= MIN_REVENUE_PER_SESSION)),
        _entry(DISCOVERY, "organic_share", "", organic_share, mark(organic_share >= MIN_ORGANIC_SHARE_PCT)),
        _entry(DISCOVERY, "paid_efficiency", "paid_cr", pct(F.col("paid"), 3)),
        _entry(DISCOVERY, "paid_efficiency", "organic_cr", pct(F.col("organic"), 3)),
        _entry(DISCOVERY, "paid_efficiency", "paid_vs_organic", pct(F.col("paid") - F.col("organic"), 3)),
    )
    source_entries = F.array(
        _entry(PRICE, "traffic_source_cr", key, pct(rate, 3)),
        _entry(DISCOVERY, "traffic_mix", key, share),
    )
    category_entries = F.array(
        _entry(PRICE, "category_aov", key, F.round(ratio(F.col("sold"), F.col("c")), money_dp)),
        _entry(QUALITY, "category_conversion_rates", key, pct(rate, 3)),
    )
    step_entries = F.array(_entry(QUALITY, "funnel_steps_distribution", key, share))
    entries = (
        F.when(dim == "all", all_entries)
        .when(dim == "traffic_source", source_entries)
        .when(dim == "product_category", category_entries)
        .when(dim == "steps_completed", step_entries)
    )
    return facts.select(F.inline(entries)).where(
        (F.col("metric") != "category_aov") | F.col("value").isNotNull()
    )


def _visitor_entries(sessions: DataFrame) -> DataFrame:
    returning, new = _visitor_rates()
    return _visitor_totals(sessions).select(
        F.inline(
            F.array(
                _entry(QUALITY, "return_visitor_cr", "returning_cr", pct(returning, 3)),
                _entry(QUALITY, "return_visitor_cr", "new_visitor_cr", pct(new, 3)),
                _entry(QUALITY, "return_visitor_cr", "loyalty_lift", pct(returning - new, 3)),
            )
        )
    )


def metrics_tree(sessions: DataFrame, money_dp: int = 2) -> DataFrame:
    """North star and all drivers as ``(driver, metric, key, value, status)``.

    One rollup pass feeds every sum, rate and the correlation.  One more narrow pass reads
    ``(user_id, converted)`` for the visitor split.
    """
    return _rollup_entries(sessions, money_dp).unionByName(_visitor_entries(sessions))


def north_star_report(sessions: DataFrame) -> DataFrame:
    """The north star and one key metric per driver as text rows.

    Values are computed, benchmarks are the thresholds of the tree, and a metric is
    healthy if it meets the benchmark beside it; without a value it has no health.
    """
    entries = metrics_tree(sessions, 4)

    def pick(metric: str, key: str = "", column: str = "value") -> Column:
        here = (F.col("metric") == metric) & (F.col("key") == key)
        return F.max(F.when(here, F.col(column)))

    picked = entries.agg(
        *[
            pick(name).alias(name)
            for name in ("overall_cr", "avg_daily_cr", "cr_std", "total_sessions", "total_conversions")
        ],
        pick("total_revenue_inr").alias("revenue"),
        pick("page_load_speed", "avg_ms").alias("load"),
        pick("revenue_per_session").alias("rps"),
        pick("organic_share").alias("organic"),
        pick("return_visitor_cr", "loyalty_lift").alias("lift"),
        pick("page_load_speed", "avg_ms", "status").alias("load_mark"),
        pick("revenue_per_session", column="status").alias("rps_mark"),
        pick("organic_share", column="status").alias("organic_mark"),
    )
    count = F.format_number

    def health(mark_or_good: Column) -> Column:
        return F.when(mark_or_good, HEALTHY_LABEL).when(~mark_or_good, AT_RISK_LABEL)

    def marked(name: str) -> Column:
        return health(F.col(f"{name}_mark") == GOOD_MARK)

    summary = "North Star Metric"
    rows = [
        (summary, "Overall Conversion Rate", F.format_string("%.3f%%", "overall_cr"), None, None),
        (summary, "Avg Daily Conv. Rate", F.format_string("%.3f%%", "avg_daily_cr"), None, None),
        (summary, "Daily CR Std Dev", F.format_string("%.4f%%", "cr_std"), None, None),
        (summary, "Total Sessions", count("total_sessions", 0), None, None),
        (summary, "Total Conversions", count("total_conversions", 0), None, None),
        (summary, "Total Revenue", F.format_string("₹%.2fM", F.col("revenue") / 1e6), None, None),
        (PAGE, "Avg Page Load", F.format_string("%.0fms", "load"), f"< {MAX_LOAD_MS:.0f}ms", marked("load")),
        (
            PRICE,
            "Revenue/Session",
            F.format_string("₹%.2f", "rps"),
            f"> ₹{MIN_REVENUE_PER_SESSION:.0f}",
            marked("rps"),
        ),
        (
            DISCOVERY,
            "Organic Share",
            F.format_string("%.1f%%", "organic"),
            f"> {MIN_ORGANIC_SHARE_PCT:.0f}%",
            marked("organic"),
        ),
        (QUALITY, "Return Visitor Lift", F.format_string("%+.3fpp", "lift"), "> 0pp", health(F.col("lift") > 0)),
    ]
    numbered = [(order, *row) for order, row in enumerate(rows, start=1)]
    names = ["ord", "section", "metric", "value", "benchmark", "health"]
    return stack_rows(picked, names, numbered).orderBy("ord")


def _read_tree(tree: DataFrame) -> DataFrame:
    """The long tree as one wide row: a value, a mark or a map per metric."""

    def here(metric: str, key: str) -> Column:
        return (F.col("metric") == metric) & (F.col("key") == key)

    def values(metric: str) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("metric") == metric, F.struct("key", "value")))))

    single = {
        "load": ("page_load_speed", "avg_ms"),
        "r": ("page_load_speed", "correlation_with_cr"),
        "p": ("page_load_speed", "p_value"),
        "bounce": ("bounce_rate", "pct"),
        "mobile": ("mobile_experience", "mobile_cr"),
        "desktop": ("mobile_experience", "desktop_cr"),
        "gap": ("mobile_experience", "gap_vs_desktop"),
        "rps": ("revenue_per_session", ""),
        "organic_share": ("organic_share", ""),
        "paid": ("paid_efficiency", "paid_cr"),
        "organic": ("paid_efficiency", "organic_cr"),
        "paid_gap": ("paid_efficiency", "paid_vs_organic"),
        "returning": ("return_visitor_cr", "returning_cr"),
        "new": ("return_visitor_cr", "new_visitor_cr"),
        "lift": ("return_visitor_cr", "loyalty_lift"),
        **{name: (name, "") for name in STAR_METRICS},
    }
    marks = ("load", "bounce", "gap", "rps", "organic_share")
    return tree.agg(
        *[F.max(F.when(here(*where), F.col("value"))).alias(name) for name, where in single.items()],
        *[F.max(F.when(here(*single[name]), F.col("status"))).alias(f"{name}_mark") for name in marks],
        *[values(name).alias(name) for name in MAP_METRICS],
    )


# The metrics of the document that have no key of their own, and those that are maps.
STAR_METRICS = ("overall_cr", "avg_daily_cr", "cr_std", "total_sessions", "total_conversions", "total_revenue_inr")
MAP_METRICS = (
    "category_aov",
    "traffic_source_cr",
    "traffic_mix",
    "category_conversion_rates",
    "funnel_steps_distribution",
)


def metrics_tree_document(tree: DataFrame) -> DataFrame:
    """The long tree as one document row, in the shape its readers expect.

    ``north_star`` holds numbers; each of ``level1_drivers`` has ``driver``, ``health`` and ``level2``, whose
    metrics carry a formatted value, the benchmark it is held to and the mark.  All drivers share one type:
    in JSON, where nulls are left out, each shows its own metrics only.  A driver's health is the mark of its benchmark.
    """

    def shown(pattern: str, name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.format_string(pattern, name))

    def judged(pattern: str, name: str, benchmark: str, *more: Column) -> Column:
        return F.struct(
            shown(pattern, name).alias("value"), F.lit(benchmark).alias("benchmark"), F.col(f"{name}_mark").alias("status"), *more
        )

    level2 = {
        "page_load_speed": (
            PAGE,
            judged("%.0fms avg", "load", f"< {MAX_LOAD_MS:.0f}ms", F.col("r").alias("correlation_with_cr"), F.col("p").alias("p_value")),
        ),
        "bounce_rate": (PAGE, judged("%.2f%%", "bounce", f"< {MAX_BOUNCE_RATE:.0%}")),
        "mobile_experience": (
            PAGE,
            F.struct(
                shown("%.3f%%", "mobile").alias("mobile_cr"),
                shown("%.3f%%", "desktop").alias("desktop_cr"),
                shown("%.3fpp", "gap").alias("gap_vs_desktop"),
                F.col("gap_mark").alias("status"),
            ),
        ),
        "revenue_per_session": (PRICE, judged("₹%.2f", "rps", f"> ₹{MIN_REVENUE_PER_SESSION:.0f}")),
        "category_aov": (PRICE, F.col("category_aov")),
        "traffic_source_cr": (PRICE, F.col("traffic_source_cr")),
        "traffic_mix": (DISCOVERY, F.col("traffic_mix")),
        "organic_share": (DISCOVERY, judged("%.1f%%", "organic_share", f"> {MIN_ORGANIC_SHARE_PCT:.0f}%")),
        "paid_efficiency": (
            DISCOVERY,
            F.struct(
                shown("%.3f%%", "paid").alias("paid_cr"),
                shown("%.3f%%", "organic").alias("organic_cr"),
                shown("%+.3fpp", "paid_gap").alias("paid_vs_organic"),
            ),
        ),
        "category_conversion_rates": (QUALITY, F.col("category_conversion_rates")),
        "funnel_steps_distribution": (QUALITY, F.col("funnel_steps_distribution")),
        "return_visitor_cr": (
            QUALITY,
            F.struct(
                shown("%.3f%%", "returning").alias("returning_cr"),
                shown("%.3f%%", "new").alias("new_visitor_cr"),
                shown("%+.3fpp", "lift").alias("loyalty_lift"),
            ),
        ),
    }

    def health(good: Column) -> Column:
        return F.when(good, HEALTHY_LABEL).when(~good, AT_RISK_LABEL)

    healths = {
        PAGE: health(F.col("load_mark") == GOOD_MARK),
        PRICE: health(F.col("rps_mark") == GOOD_MARK),
        DISCOVERY: health(F.col("organic_share_mark") == GOOD_MARK),
        QUALITY: health(F.col("lift") > 0),
    }
    never = F.lit(None).cast("boolean")
    branches = [
        F.struct(
            F.lit(driver).alias("driver"),
            healths[driver].alias("health"),
            F.struct(*[F.when(F.lit(True) if owner == driver else never, column).alias(name) for name, (owner, column) in level2.items()]).alias("level2"),
        )
        for driver in healths
    ]
    counts = ("total_sessions", "total_conversions")
    star = [F.lit("Conversion Rate").alias("north_star_metric")]
    star += [(F.col(name).cast("long") if name in counts else F.col(name)).alias(name) for name in STAR_METRICS]
    return _read_tree(tree).select(F.struct(*star).alias("north_star"), F.array(*branches).alias("level1_drivers"))


def metrics_tree_fields(sessions: DataFrame, money_dp: int = 2) -> DataFrame:
    """Every field of the tree's document: ``path, text, number``."""
    return document_fields(metrics_tree_document(metrics_tree(sessions, money_dp)), name="driver")
