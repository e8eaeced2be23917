"""Is a conversion drop real, where and when did it happen, what did it cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.calendar import as_date, date_lit, in_days, shift
from sessionscope.functions.rates import (
    count_if,
    mean_if,
    pct,
    ratio,
    relative_change,
    sum_if,
)
from sessionscope.functions.rows import stack_rows
from sessionscope.functions.stats import normal_p, pooled_z
from sessionscope.labels import (
    BASELINE,
    CATEGORY_CAUSE,
    CATEGORY_HYPOTHESIS,
    DROP_DAY,
    LIKELY_NOISE,
    MOBILE_CAUSE,
    MOBILE_HYPOTHESIS,
    REAL_DROP,
)
from sessionscope.operators.rollup import dimension_rollup
from sessionscope.schema import (
    ALPHA,
    BASELINE_DAYS,
    DROP_DATE,
    DROP_DAYS,
    SLICE_DIMENSIONS,
)

# Dimensions whose number of values is not fixed by the data model.
WIDE_DIMENSIONS = ("location",)


class DropWindow:
    """The days around a drop: baseline, the day before, the drop day, the drop window."""

    def __init__(self, drop_date=DROP_DATE, drop_days: int = DROP_DAYS, baseline_days: int = BASELINE_DAYS):
        self.day = as_date(drop_date)
        self.baseline_start = shift(self.day, -baseline_days)
        self.previous = shift(self.day, -1)
        self.last = shift(self.day, drop_days - 1)

    def through_drop_day(self) -> Column:
        return in_days(self.baseline_start, self.day)

    def through_window(self) -> Column:
        return in_days(self.baseline_start, max(self.last, self.day))

    # Labels inside an already filtered window, on the plain date column.
    def is_baseline(self) -> Column:
        return F.col("date") < date_lit(self.day)

    def is_drop_day(self) -> Column:
        return F.col("date") == date_lit(self.day)

    def is_previous(self) -> Column:
        return F.col("date") == date_lit(self.previous)

    def in_drop(self) -> Column:
        return F.col("date").between(date_lit(self.day), date_lit(self.last))


def drop_verify_union(sessions: DataFrame, **window) -> DataFrame:
    """Two rows, baseline and drop day, from one pass and without a union."""
    w = DropWindow(**window)
    totals = sessions.where(w.through_drop_day()).agg(
        *[c.alias(name) for name, c in _period_sums(w).items()]
    )
    return stack_rows(
        totals,
        ["period", "sessions", "conversions", "cr_pct"],
        [
            (BASELINE, F.col("n_base"), F.col("c_base"), pct(_base_rate(), 4)),
            (DROP_DAY, F.col("n_drop"), F.col("c_drop"), pct(_drop_rate(), 4)),
        ],
    )


def _period_sums(w: DropWindow) -> dict[str, Column]:
    base, drop = w.is_baseline(), w.is_drop_day()
    return {
        "n_base": count_if(base),
        "c_base": sum_if("converted", base),
        "n_drop": count_if(drop),
        "c_drop": sum_if("converted", drop),
    }


def _base_rate() -> Column:
    return ratio(F.col("c_base"), F.col("n_base"))


def _drop_rate() -> Column:
    return ratio(F.col("c_drop"), F.col("n_drop"))


def _change_pct() -> Column:
    return pct(relative_change(_base_rate(), _drop_rate()), 2)


def _verdict(p_value: Column, alpha: float) -> Column:
    return F.when(p_value < alpha, REAL_DROP.format(alpha=alpha)).otherwise(LIKELY_NOISE)


def _drop_z() -> Column:
    return pooled_z(F.col("c_base"), F.col("n_base"), F.col("c_drop"), F.col("n_drop"))


def drop_verify_ztest(sessions: DataFrame, alpha: float = ALPHA, **window) -> DataFrame:
    """Two-proportion z-test of the drop day against its baseline."""
    w = DropWindow(**window)
    tested = (
        sessions.where(w.through_drop_day())
        .agg(*[c.alias(name) for name, c in _period_sums(w).items()])
        .withColumn("z", _drop_z())
        .withColumn("p", normal_p(F.col("z")))
    )
    return tested.select(
        pct(_base_rate(), 4).alias("baseline_cr"),
        pct(_drop_rate(), 4).alias("drop_day_cr"),
        _change_pct().alias("relative_drop"),
        pct(_drop_rate() - _base_rate(), 4).alias("absolute_drop"),
        F.col("n_base").alias("baseline_sessions"),
        F.col("n_drop").alias("drop_day_sessions"),
        F.round("z", 4).alias("z_statistic"),
        F.round("p", 8).alias("p_value"),
        (F.col("p") < alpha).alias("is_significant"),
        _verdict(F.col("p"), alpha).alias("verdict"),
    )


def _slice(sessions: DataFrame, dimension: str, w: DropWindow) -> DataFrame:
    return (
        sessions.where(w.through_drop_day())
        .groupBy(dimension)
        .agg(
            mean_if("converted", w.is_baseline()).alias("base"),
            mean_if("converted", w.is_drop_day()).alias("drop"),
            count_if(w.is_drop_day()).alias("drop_day_sessions"),
        )
        .withColumn("baseline_cr_pct", pct(F.col("base"), 4))
        .withColumn("drop_day_cr_pct", pct(F.col("drop"), 4))
    )


def slice_device(sessions: DataFrame, **window) -> DataFrame:
    """Baseline and drop-day rate per device; the change is rounded before scaling."""
    change = F.round(F.round(F.col("drop") - F.col("base"), 6) * 100, 4)
    return (
        _slice(sessions, "device", DropWindow(**window))
        .select("device", "baseline_cr_pct", "drop_day_cr_pct", change.alias("absolute_change_pp"))
        .orderBy("absolute_change_pp", "device")
    )


def slice_location(sessions: DataFrame, **window) -> DataFrame:
    return (
        _slice(sessions, "location", DropWindow(**window))
        .select("location", "baseline_cr_pct", "drop_day_cr_pct")
        .orderBy("drop_day_cr_pct", "location")
    )


def slice_category(sessions: DataFrame, **window) -> DataFrame:
    return (
        _slice(sessions, "product_category", DropWindow(**window))
        .select("product_category", "baseline_cr_pct", "drop_day_cr_pct", "drop_day_sessions")
        .orderBy("drop_day_cr_pct", "product_category")
    )


def _dimension_changes(sessions: DataFrame, w: DropWindow, dimensions) -> DataFrame:
    """Every value of every dimension that occurs on both sides, in one scan."""
    alone = tuple(d for d in dimensions if d in WIDE_DIMENSIONS)
    together = tuple(d for d in dimensions if d not in WIDE_DIMENSIONS)
    rollup = dimension_rollup(
        sessions.where(w.through_drop_day()), together, alone, total=False, **_period_sums(w)
    )
    both = F.col("key").isNotNull() & (F.col("n_base") > 0) & (F.col("n_drop") > 0)
    return rollup.where(both)


def slice_all_dims(sessions: DataFrame, dimensions=SLICE_DIMENSIONS, **window) -> DataFrame:
    return (
        _dimension_changes(sessions, DropWindow(**window), dimensions)
        .select(
            "dimension",
            F.col("key").alias("value"),
            pct(_base_rate(), 4).alias("baseline_cr"),
            pct(_drop_rate(), 4).alias("drop_cr"),
            pct(_drop_rate() - _base_rate(), 4).alias("absolute_change_pp"),
            _change_pct().alias("relative_change_pct"),
        )
        .orderBy("dimension", "value")
    )


def worst_segment(sessions: DataFrame, dimensions=("device", "traffic_source"), **window) -> DataFrame:
    """Per dimension the value with the lowest relative change; ties go to the first name."""
    changes = _dimension_changes(sessions, DropWindow(**window), dimensions).withColumn(
        "change", _change_pct()
    )
    worst = F.min(F.struct("change", "key"))
    return (
        changes.where(F.col("change").isNotNull())
        .groupBy("dimension")
        .agg(worst.alias("worst"))
        .select(
            "dimension",
            F.col("worst.key").alias("worst_value"),
            F.col("worst.change").alias("relative_change_pct"),
        )
        .orderBy("dimension")
    )


def drop_hourly(sessions: DataFrame, load_dp: int = 1, **window) -> DataFrame:
    """Hour by hour on the drop day."""
    w = DropWindow(**window)
    return (
        sessions.where(in_days(w.day, w.day))
        .groupBy("hour")
        .agg(
            F.count("*").alias("sessions"),
            F.sum("converted").alias("conversions"),
            pct(F.avg("converted"), 4).alias("cr_pct"),
            F.round(F.avg("page_load_ms"), load_dp).alias("avg_load_ms"),
        )
        .orderBy("hour")
    )


def _hour_deltas(sessions: DataFrame, w: DropWindow) -> DataFrame:
    """Hours seen on both days; rates are rounded first, as the comparison uses them."""
    by_hour = (
        sessions.where(in_days(w.previous, w.day))
        .groupBy("hour")
        .agg(
            count_if(w.is_drop_day()).alias("n_drop"),
            count_if(w.is_previous()).alias("n_prev"),
            pct(mean_if("converted", w.is_drop_day()), 4).alias("cr_drop"),
            pct(mean_if("converted", w.is_previous()), 4).alias("cr_prev"),
        )
        .where((F.col("n_drop") > 0) & (F.col("n_prev") > 0))
    )
    return by_hour.withColumn("delta", F.round(F.col("cr_drop") - F.col("cr_prev"), 4))


def hourly_vs_prev(sessions: DataFrame, **window) -> DataFrame:
    """Drop day against the day before, hour by hour."""
    return (
        _hour_deltas(sessions, DropWindow(**window))
        .select(
            "hour",
            F.col("n_drop").alias("sessions_drop"),
            F.col("n_prev").alias("sessions_prev"),
            "cr_drop",
            "cr_prev",
            "delta",
        )
        .orderBy("hour")
    )


def biggest_drop_hour(sessions: DataFrame, **window) -> DataFrame:
    """The hour with the lowest delta; ties go to the earlier hour."""
    worst = F.min(F.struct("delta", "hour"))
    return (
        _hour_deltas(sessions, DropWindow(**window))
        .where(F.col("delta").isNotNull())
        .agg(worst.alias("worst"))
        .select(F.col("worst.hour").alias("biggest_drop_hour"), F.col("worst.delta").alias("delta_pp"))
    )


def _device_change(name: str) -> Column:
    here = (F.col("dimension") == "device") & (F.col("key") == name)
    return F.max(F.when(here, relative_change(_base_rate(), _drop_rate())))


def _worst_category() -> Column:
    change = relative_change(_base_rate(), _drop_rate())
    candidate = F.struct(F.round(change, 12).alias("change"), F.col("key").alias("name"))
    here = (F.col("dimension") == "product_category") & F.col("key").isNotNull() & change.isNotNull()
    return F.min(F.when(here, candidate))


def _is_mobile_issue(mobile: Column, desktop: Column, factor: float) -> Column:
    return F.coalesce(F.abs(mobile) > F.abs(desktop) * factor, F.lit(False))


def _cause(mobile: Column, desktop: Column, category: Column, factor: float) -> Column:
    return F.when(_is_mobile_issue(mobile, desktop, factor), MOBILE_CAUSE).otherwise(
        F.concat(F.lit(CATEGORY_CAUSE), category)
    )


def _hypothesis(mobile: Column, desktop: Column, category: Column, factor: float) -> Column:
    mobile_text = F.format_string(MOBILE_HYPOTHESIS, mobile * 100, desktop * 100)
    category_text = F.format_string(CATEGORY_HYPOTHESIS, category)
    return F.when(_is_mobile_issue(mobile, desktop, factor), mobile_text).otherwise(category_text)


def root_cause(sessions: DataFrame, factor: float = 1.5, **window) -> DataFrame:
    """Mobile against desktop change; unless mobile stands out, the worst category."""
    w = DropWindow(**window)
    rollup = dimension_rollup(
        sessions.where(w.through_drop_day()), ("device", "product_category"), total=False, **_period_sums(w)
    )
    summary = rollup.agg(
        _device_change("mobile").alias("mobile"),
        _device_change("desktop").alias("desktop"),
        _worst_category().alias("worst"),
    )
    mobile, desktop, category = F.col("mobile"), F.col("desktop"), F.col("worst.name")
    return summary.select(
        pct(mobile, 2).alias("mobile_delta_pct"),
        pct(desktop, 2).alias("desktop_delta_pct"),
        category.alias("worst_category"),
        _cause(mobile, desktop, category, factor).alias("root_cause_category"),
        _hypothesis(mobile, desktop, category, factor).alias("primary_hypothesis"),
    )


def _impact_sums(w: DropWindow) -> dict[str, Column]:
    drop, base = w.in_drop(), w.is_baseline()
    return {
        "n_window": count_if(drop),
        "c_window": sum_if("converted", drop),
        "rev_window": sum_if("revenue", drop),
        "n_baseline": count_if(base),
        "c_baseline": sum_if("converted", base),
        "rev_baseline": sum_if("revenue", base),
    }


def _expected_revenue() -> Column:
    return ratio(F.col("rev_baseline"), F.col("n_baseline")) * F.col("n_window")


def _missed_conversions() -> Column:
    gap = ratio(F.col("c_baseline"), F.col("n_baseline")) - ratio(F.col("c_window"), F.col("n_window"))
    return gap * F.col("n_window")


def _impact(sessions: DataFrame, w: DropWindow) -> DataFrame:
    return sessions.where(w.through_window()).agg(
        *[c.alias(name) for name, c in _impact_sums(w).items()]
    )


def business_impact(sessions: DataFrame, **window) -> DataFrame:
    """Revenue lost in the drop window against the baseline revenue per session."""
    return _impact(sessions, DropWindow(**window)).select(
        F.col("n_window").alias("sessions"),
        F.round("rev_window", 2).alias("actual_revenue_inr"),
        F.round(_expected_revenue(), 2).alias("expected_revenue_inr"),
        F.round(_expected_revenue() - F.col("rev_window"), 2).alias("lost_revenue_inr"),
    )


def business_impact_missed(sessions: DataFrame, money_dp: int = 2, **window) -> DataFrame:
    """The same with baseline revenue per session and truncated missed conversions."""
    w = DropWindow(**window)
    return _impact(sessions, w).select(
        F.lit((w.last - w.day).days + 1).alias("drop_window_days"),
        F.col("n_window").alias("sessions_during_drop"),
        F.round(ratio(F.col("rev_baseline"), F.col("n_baseline")), money_dp).alias("baseline_rps_inr"),
        F.round("rev_window", 2).alias("actual_revenue_inr"),
        F.round(_expected_revenue(), 2).alias("expected_revenue_inr"),
        F.round(_expected_revenue() - F.col("rev_window"), 2).alias("lost_revenue_inr"),
        F.round(_missed_conversions(), 6).cast("bigint").alias("missed_conversions"),
    )


def diagnosis_report(sessions: DataFrame, alpha: float = ALPHA, factor: float = 1.5, **window) -> DataFrame:
    """All five steps as ``(ord, step, section, metric, value)`` text rows.

    One rollup pass over the drop window carries every sum the steps need; the
    rest works on its few dozen rows.
    """
    w = DropWindow(**window)
    previous = w.is_previous()
    rollup = dimension_rollup(
        sessions.where(w.through_window()),
        ("device", "traffic_source", "product_category", "hour"),
        **_period_sums(w),
        **_impact_sums(w),
        n_prev=count_if(previous),
        c_prev=sum_if("converted", previous),
    )
    dim, key = F.col("dimension"), F.col("key")
    hour_delta = F.round(
        pct(_drop_rate(), 4) - pct(ratio(F.col("c_prev"), F.col("n_prev")), 4), 4
    )

    def total(name: str) -> Column:
        return F.max(F.when(dim == "all", F.col(name)))

    def lowest(dimension: str, change: Column, label: Column) -> Column:
        here = (dim == dimension) & key.isNotNull() & change.isNotNull()
        return F.min(F.when(here, F.struct(change.alias("change"), label.alias("name"))))["name"]

    sums = [*_period_sums(w), *_impact_sums(w)]
    facts = (
        rollup.agg(
            *[total(name).alias(name) for name in sums],
            lowest("device", _change_pct(), key).alias("worst_device"),
            lowest("traffic_source", _change_pct(), key).alias("worst_source"),
            lowest("hour", hour_delta, key.try_cast("int")).alias("drop_hour"),
            _worst_category()["name"].alias("worst_category"),
            _device_change("mobile").alias("mobile"),
            _device_change("desktop").alias("desktop"),
        )
        .withColumn("z", _drop_z())
        .withColumn("p", normal_p(F.col("z")))
    )

    def text(fmt: str, *values: Column) -> Column:
        return F.format_string(fmt, *values)

    mobile, desktop, category = F.col("mobile"), F.col("desktop"), F.col("worst_category")
    lost = _expected_revenue() - F.col("rev_window")
    verify, slices, timeline = "Verify drop", "Dimension slicing", "Timeline"
    cause, impact = "Root cause", "Business impact"
    rows = [
        (1, verify, "Baseline CR", text("%.4f%%", pct(_base_rate(), 4))),
        (1, verify, "Drop day CR", text("%.4f%%", pct(_drop_rate(), 4))),
        (1, verify, "Relative drop", text("%.2f%%", _change_pct())),
        (1, verify, "Absolute drop", text("%.4fpp", pct(_drop_rate() - _base_rate(), 4))),
        (1, verify, "Z statistic", text("%.4f", F.round("z", 4))),
        (1, verify, "P value", text("%.8f", F.round("p", 8))),
        (1, verify, "Significant", F.when(F.col("p") < alpha, "YES").otherwise("NO")),
        (1, verify, "Verdict", _verdict(F.col("p"), alpha)),
        (2, slices, "Worst device", F.col("worst_device")),
        (2, slices, "Worst source", F.col("worst_source")),
        (3, timeline, "Biggest drop hour", text("%02d:00", F.col("drop_hour"))),
        (4, cause, "Mobile CR change", text("%.2f%%", pct(mobile, 2))),
        (4, cause, "Desktop CR change", text("%.2f%%", pct(desktop, 2))),
        (4, cause, "Root cause", _cause(mobile, desktop, category, factor)),
        (4, cause, "Primary hypothesis", _hypothesis(mobile, desktop, category, factor)),
        (5, impact, "Sessions during drop", F.format_number("n_window", 0)),
        (5, impact, "Expected revenue", F.concat(F.lit("₹"), F.format_number(F.round(_expected_revenue(), 2), 2))),
        (5, impact, "Actual revenue", F.concat(F.lit("₹"), F.format_number(F.round("rev_window", 2), 2))),
        (5, impact, "Lost revenue", F.concat(F.lit("₹"), F.format_number(lost, 0))),
        (5, impact, "Missed conversions", F.format_number(F.round(_missed_conversions(), 6).cast("bigint"), 0)),
    ]
    numbered = [(order, *row) for order, row in enumerate(rows, start=1)]
    return stack_rows(facts, ["ord", "step", "section", "metric", "value"], numbered).orderBy("ord")
