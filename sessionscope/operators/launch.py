"""Did a launch lift conversion without hurting the guardrails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.calendar import as_date, date_lit, in_days, shift, week_start
from sessionscope.functions.rates import (
    count_if,
    mean_if,
    pct,
    ratio,
    relative_change,
    sum_if,
)
from sessionscope.functions.stats import (
    mean_diff_ci,
    pooled_z,
    proportion_diff_ci,
    tail_probability,
    welch_df,
    welch_t,
)
from sessionscope.labels import (
    BOUNCE_GUARDRAIL,
    DO_NOT_SHIP,
    LAUNCH_IMPROVED,
    LAUNCH_REGRESSED,
    LAUNCH_UNCLEAR,
    LOAD_GUARDRAIL,
    POST_LAUNCH,
    PRE_LAUNCH,
    REVENUE_GUARDRAIL,
    SEGMENT_OK,
    SEGMENT_REGRESSION,
    SHIP,
    SHIP_CONDITIONALLY,
)
from sessionscope.operators.rollup import dimension_rollup, moment_rollup
from sessionscope.schema import (
    ALPHA,
    DROP_DATE,
    DROP_DAYS,
    LAUNCH_DATE,
    LAUNCH_WINDOW_DAYS,
)

# The calendar range of the by-period tables.
RANGE = ("2024-04-01", "2024-05-31")
EXCLUDED = ("2024-04-10", "2024-04-12")


# --- fixed calendar range, by period ------------------------------------


def _in_range(sessions: DataFrame, days: tuple, excluded: tuple) -> DataFrame:
    gone = F.col("date").between(date_lit(excluded[0]), date_lit(excluded[1]))
    return sessions.where(in_days(*days) & ~gone)


def _period(day: Column, cut) -> Column:
    return F.when(day < date_lit(cut), PRE_LAUNCH).otherwise(POST_LAUNCH)


def launch_pre_post(
    sessions: DataFrame,
    launch_date=LAUNCH_DATE,
    days: tuple = RANGE,
    excluded: tuple = EXCLUDED,
    money_dp: int = 2,
    load_dp: int = 1,
) -> DataFrame:
    """Six metrics before and after the launch date."""
    return (
        _in_range(sessions, days, excluded)
        .groupBy(_period(F.col("date"), launch_date).alias("period"))
        .agg(
            F.count("*").alias("sessions"),
            F.sum("converted").alias("conversions"),
            pct(F.avg("converted"), 4).alias("cr_pct"),
            F.round(F.avg("revenue"), money_dp).alias("revenue_per_session_inr"),
            F.round(F.avg("page_load_ms"), load_dp).alias("avg_load_ms"),
            pct(F.avg("bounced"), 3).alias("bounce_rate_pct"),
        )
        .orderBy(F.desc("period"))
    )


def launch_weekly(
    sessions: DataFrame,
    label_cutoff="2024-04-28",
    days: tuple = RANGE,
    excluded: tuple = EXCLUDED,
    money_dp: int = 2,
    load_dp: int = 1,
) -> DataFrame:
    """Weekly trend; a week is labelled by its Monday against ``label_cutoff``."""
    return (
        _in_range(sessions, days, excluded)
        .groupBy(week_start(F.col("date")).alias("week_start"))
        .agg(
            F.count("*").alias("sessions"),
            pct(F.avg("converted"), 4).alias("cr_pct"),
            F.round(F.avg("revenue"), money_dp).alias("rps_inr"),
            F.round(F.avg("page_load_ms"), load_dp).alias("avg_load_ms"),
        )
        .withColumn("period", _period(F.col("week_start"), label_cutoff))
        .orderBy("week_start")
    )


def launch_device(
    sessions: DataFrame, launch_date=LAUNCH_DATE, days: tuple = RANGE, excluded: tuple = EXCLUDED
) -> DataFrame:
    before = F.col("date") < date_lit(launch_date)
    pre, post = mean_if("converted", before), mean_if("converted", ~before)
    return (
        _in_range(sessions, days, excluded)
        .groupBy("device")
        .agg(
            pct(pre, 4).alias("pre_cr_pct"),
            pct(post, 4).alias("post_cr_pct"),
            pct(post - pre, 4).alias("lift_pp"),
        )
        .orderBy("device")
    )


# --- equal windows around the launch ------------------------------------


class LaunchWindow:
    """Equal windows before and after a launch, without the drop days.

    The exclusion runs one day past the drop duration.
    """

    def __init__(
        self,
        launch_date=LAUNCH_DATE,
        window_days: int = LAUNCH_WINDOW_DAYS,
        drop_date=DROP_DATE,
        drop_days: int = DROP_DAYS,
    ):
        self.launch = as_date(launch_date)
        self.first = shift(self.launch, -window_days)
        self.last = shift(self.launch, window_days - 1)
        self.excluded = (as_date(drop_date), shift(drop_date, drop_days))

    def sessions(self, sessions: DataFrame) -> DataFrame:
        before = self.is_pre()
        gone = F.col("date").between(date_lit(self.excluded[0]), date_lit(self.excluded[1]))
        return sessions.where(in_days(self.first, self.last) & ~(before & gone))

    def is_pre(self) -> Column:
        return F.col("date") < date_lit(self.launch)


def launch_split(sessions: DataFrame, **window) -> DataFrame:
    """The sessions of both windows with their ``period``; a filter, no shuffle."""
    w = LaunchWindow(**window)
    return w.sessions(sessions).withColumn("period", _period(F.col("date"), w.launch))


def _counts(w: LaunchWindow) -> dict[str, Column]:
    pre, post = w.is_pre(), ~w.is_pre()
    return {
        "n1": count_if(pre),
        "n2": count_if(post),
        "c1": sum_if("converted", pre),
        "c2": sum_if("converted", post),
    }


def _sums(w: LaunchWindow) -> dict[str, Column]:
    return _counts(w) | {"b1": sum_if("bounced", w.is_pre()), "b2": sum_if("bounced", ~w.is_pre())}


def _measured(w: LaunchWindow) -> dict[str, Column]:
    """The values whose means and variances the guardrails compare, by window."""
    columns = {"load": "page_load_ms", "rev": "revenue"}
    sides = {"1": w.is_pre(), "2": ~w.is_pre()}
    return {short + side: F.when(here, F.col(c)) for side, here in sides.items() for short, c in columns.items()}


def _moments(w: LaunchWindow) -> dict[str, Column]:
    """Sufficient statistics of the primary metric and the guardrails."""
    out = _sums(w)
    for name, value in _measured(w).items():
        out[f"{name}_mean"], out[f"{name}_var"] = F.avg(value), F.var_samp(value)
    return out


def _one_row(sessions: DataFrame, w: LaunchWindow, aggregates: dict[str, Column]) -> DataFrame:
    return w.sessions(sessions).agg(*[c.alias(name) for name, c in aggregates.items()])


def _rate(x: str, n: str) -> Column:
    return ratio(F.col(x), F.col(n))


def _welch(short: str) -> tuple[Column, ...]:
    return tuple(
        F.col(name)
        for name in (f"{short}1_mean", f"{short}1_var", "n1", f"{short}2_mean", f"{short}2_var", "n2")
    )


def _proportions(prefix: str) -> tuple[Column, ...]:
    return tuple(F.col(name) for name in (f"{prefix}1", "n1", f"{prefix}2", "n2"))


def _with_tests(row: DataFrame, guardrails: bool = True) -> DataFrame:
    """Adds the z or t statistics and p values of the primary metric and the guardrails."""
    none = F.lit(None).cast("double")
    tests = {"cr": (pooled_z(*_proportions("c")), none)}
    if guardrails:
        tests["bounce"] = (pooled_z(*_proportions("b")), none)
        for short in ("load", "rev"):
            m1, v1, n1, m2, v2, n2 = _welch(short)
            tests[short] = (welch_t(m1, v1, n1, m2, v2, n2), welch_df(v1, n1, v2, n2))
    row = row.withColumns({f"{name}_stat": stat for name, (stat, _) in tests.items()})
    return row.withColumns(
        {f"{name}_p": tail_probability(F.col(f"{name}_stat"), df) for name, (_, df) in tests.items()}
    )


def _significant(alpha: float) -> Column:
    return F.coalesce(F.col("cr_p") < alpha, F.lit(False))


def _improved(alpha: float) -> Column:
    """Significant and higher, on unrounded rates."""
    return _significant(alpha) & F.coalesce(_rate("c2", "n2") > _rate("c1", "n1"), F.lit(False))


def _primary_columns(alpha: float) -> list[Column]:
    cr1, cr2 = _rate("c1", "n1"), _rate("c2", "n2")
    low, high = proportion_diff_ci(*_proportions("c"))
    verdict = (
        F.when(_improved(alpha), LAUNCH_IMPROVED)
        .when(_significant(alpha), LAUNCH_REGRESSED)
        .otherwise(LAUNCH_UNCLEAR)
    )
    return [
        F.lit("Conversion Rate").alias("metric"),
        F.lit("primary").alias("type"),
        pct(cr1, 4).alias("pre_value"),
        pct(cr2, 4).alias("post_value"),
        pct(cr2 - cr1, 4).alias("absolute_change_pp"),
        pct(relative_change(cr1, cr2), 2).alias("relative_lift_pct"),
        pct(low, 4).alias("ci_95_low_pp"),
        pct(high, 4).alias("ci_95_high_pp"),
        F.round("cr_stat", 4).alias("z_statistic"),
        F.round("cr_p", 8).alias("p_value"),
        _significant(alpha).alias("is_significant"),
        F.col("n1").alias("pre_sessions"),
        F.col("n2").alias("post_sessions"),
        verdict.alias("verdict"),
    ]


def launch_primary(sessions: DataFrame, alpha: float = ALPHA, **window) -> DataFrame:
    """Conversion rate before and after: lift, interval, z-test, verdict."""
    w = LaunchWindow(**window)
    return _with_tests(_one_row(sessions, w, _counts(w)), guardrails=False).select(
        *_primary_columns(alpha)
    )


def _guardrail_passes() -> dict[str, Column]:
    """Ties count as passed on every guardrail."""
    return {
        "load": F.col("load2_mean") <= F.col("load1_mean"),
        "bounce": _rate("b2", "n2") <= _rate("b1", "n1"),
        "rev": F.col("rev2_mean") >= F.col("rev1_mean"),
    }


def _guardrail_rows(alpha: float, money_dp: int, load_dp: int) -> Column:
    passes = _guardrail_passes()
    texts = {"load": LOAD_GUARDRAIL, "bounce": BOUNCE_GUARDRAIL, "rev": REVENUE_GUARDRAIL}

    def row(name: str, before: Column, after: Column, low: Column, high: Column, digits: int) -> Column:
        title, direction, passed, failed = texts[name]
        ok = F.coalesce(passes[name], F.lit(False))
        return F.struct(
            F.lit(title).alias("metric"),
            F.lit("guardrail").alias("type"),
            F.lit(direction).alias("direction_good"),
            F.round(before, digits).alias("pre_value"),
            F.round(after, digits).alias("post_value"),
            F.round(after - before, digits).alias("absolute_change"),
            pct(relative_change(before, after), 2).alias("relative_change_pct"),
            F.round(low, digits).alias("ci_95_low"),
            F.round(high, digits).alias("ci_95_high"),
            F.round(f"{name}_p", 6).alias("p_value"),
            F.coalesce(F.col(f"{name}_p") < alpha, F.lit(False)).alias("is_significant"),
            ok.alias("passed"),
            F.when(ok, passed).otherwise(failed).alias("verdict"),
        )

    none = F.lit(None).cast("double")
    return F.array(
        row("load", F.col("load1_mean"), F.col("load2_mean"), *mean_diff_ci(*_welch("load")), load_dp),
        row("bounce", _rate("b1", "n1") * 100, _rate("b2", "n2") * 100, none, none, 3),
        row("rev", F.col("rev1_mean"), F.col("rev2_mean"), *mean_diff_ci(*_welch("rev")), money_dp),
    )


def launch_guardrails(
    sessions: DataFrame, alpha: float = ALPHA, money_dp: int = 2, load_dp: int = 1, **window
) -> DataFrame:
    """Load time, bounce rate and revenue per session, each tested and judged.

    One pass computes counts, means and variances of both windows.
    """
    w = LaunchWindow(**window)
    tested = _with_tests(_one_row(sessions, w, _moments(w)))
    return tested.select(F.inline(_guardrail_rows(alpha, money_dp, load_dp)))


def _all_pass() -> Column:
    load, bounce, rev = _guardrail_passes().values()
    return F.coalesce(load & bounce & rev, F.lit(False))


def _recommendation(alpha: float) -> Column:
    return (
        F.when(_improved(alpha) & _all_pass(), SHIP)
        .when(_improved(alpha), SHIP_CONDITIONALLY)
        .otherwise(DO_NOT_SHIP)
    )


def launch_recommendation(sessions: DataFrame, alpha: float = ALPHA, **window) -> DataFrame:
    """Ship, ship conditionally, or not, from the primary metric and the guardrails."""
    w = LaunchWindow(**window)
    tested = _with_tests(_one_row(sessions, w, _moments(w)))
    passed = sum(F.coalesce(p, F.lit(False)).cast("int") for p in _guardrail_passes().values())
    return tested.select(
        _improved(alpha).alias("primary_significant"),
        passed.alias("guardrails_passed"),
        _all_pass().alias("all_guardrails_pass"),
        _recommendation(alpha).alias("recommendation"),
    )


def _segment_lift() -> Column:
    return relative_change(_rate("c1", "n1"), _rate("c2", "n2"))


def _segment_is_large(devices: tuple | None, device_gate: int, source_gate: int) -> Column:
    """Both windows must hold enough rows; the gate differs by dimension. No list means all devices."""
    n1, n2 = F.col("n1"), F.col("n2")
    listed = F.col("key").isNotNull() if devices is None else F.col("key").isin(*devices)
    device = (F.col("dimension") == "device") & listed
    source = (F.col("dimension") == "traffic_source") & (n1 > 0) & F.col("key").isNotNull()
    return (device & (n1 >= device_gate) & (n2 >= device_gate)) | (
        source & (n1 >= source_gate) & (n2 >= source_gate)
    )


def _segment_name() -> Column:
    prefix = F.when(F.col("dimension") == "device", "Device: ").otherwise("Source: ")
    return F.concat(prefix, F.col("key"))


def _segment_concern(worst: float) -> Column:
    return F.when(_segment_lift() < worst, SEGMENT_REGRESSION).otherwise(SEGMENT_OK)


def launch_side_effects(
    sessions: DataFrame,
    devices: tuple | None = None,
    device_gate: int = 100,
    source_gate: int = 500,
    worst_lift: float = -0.05,
    **window,
) -> DataFrame:
    """Lift per device and per traffic source, both dimensions in one scan."""
    w = LaunchWindow(**window)
    rollup = dimension_rollup(
        w.sessions(sessions), ("device", "traffic_source"), total=False, **_counts(w)
    )
    return (
        rollup.where(_segment_is_large(devices, device_gate, source_gate))
        .select(
            _segment_name().alias("segment"),
            pct(_rate("c1", "n1"), 4).alias("pre_cr"),
            pct(_rate("c2", "n2"), 4).alias("post_cr"),
            pct(_segment_lift(), 2).alias("lift_pct"),
            _segment_concern(worst_lift).alias("concern"),
        )
        .orderBy("segment")
    )


def launch_report(
    sessions: DataFrame,
    alpha: float = ALPHA,
    devices: tuple | None = None,
    device_gate: int = 100,
    source_gate: int = 500,
    worst_lift: float = -0.05,
    **window,
) -> DataFrame:
    """Recommendation, primary metric, guardrails and segments as text rows.

    A single pass over cells of device and source: the grand-total row expands into the first
    three sections, every large enough segment row into one line of the last.
    """
    w = LaunchWindow(**window)
    rollup = moment_rollup(w.sessions(sessions), ("device", "traffic_source"), _measured(w), **_sums(w))
    total = F.col("dimension") == "all"
    kept = rollup.where(total | _segment_is_large(devices, device_gate, source_gate))
    tested = _with_tests(kept)

    def line(section: str, metric: Column | str, value: Column, verdict: Column | None = None) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"),
            value.cast("string").alias("value"),
            (F.lit(None) if verdict is None else verdict).cast("string").alias("verdict"),
        )

    cr1, cr2 = pct(_rate("c1", "n1"), 4), pct(_rate("c2", "n2"), 4)
    low, high = proportion_diff_ci(*_proportions("c"))
    change = pct(_rate("c2", "n2") - _rate("c1", "n1"), 4)
    first = "Primary metric"
    total_lines = [
        line("Recommendation", "Recommendation", _recommendation(alpha)),
        line(first, "Pre-launch CR", F.format_string("%.4f%%", cr1)),
        line(first, "Post-launch CR", F.format_string("%.4f%%", cr2)),
        line(first, "Absolute change", F.format_string("%+.4fpp", change)),
        line(first, "Relative lift", F.format_string("%+.2f%%", pct(_segment_lift(), 2))),
        line(first, "95% CI", F.format_string("[%+.4fpp, %+.4fpp]", pct(low, 4), pct(high, 4))),
        line(first, "Z statistic", F.format_string("%.4f", F.round("cr_stat", 4))),
        line(first, "P value", F.format_string("%.8f", F.round("cr_p", 8))),
    ]
    guardrail_lines = F.transform(
        _guardrail_rows(alpha, 4, 4),
        lambda g: line(
            "Guardrails",
            g["metric"],
            F.format_string("%.4f -> %.4f (%+.2f%%)", g["pre_value"], g["post_value"], g["relative_change_pct"]),
            g["verdict"],
        ),
    )
    segment_line = line(
        "Side effects",
        _segment_name(),
        F.format_string("%+.2f%%", pct(_segment_lift(), 2)),
        _segment_concern(worst_lift),
    )
    lines = F.when(total, F.concat(F.array(*total_lines), guardrail_lines)).otherwise(F.array(segment_line))
    return tested.select(F.inline(lines))
