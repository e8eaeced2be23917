"""Every operator under its query name, with parameters for the test calendar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.functions.rates import round_columns
from sessionscope.operators import anomaly, cohorts, diagnosis, launch, measures, northstar, quality, segments
from sessionscope.sources.events import load_sessions

Query = Callable[[SparkSession, str], DataFrame]

# Means of a few rows tie exactly at two digits; four digits compare safely.
EXACT = {"money_dp": 4}

DROP = {"drop_date": "2024-01-10"}
LAUNCH = {"launch_date": "2024-01-21", "window_days": 10, **DROP}
RANGE = {"days": ("2024-01-01", "2024-01-30"), "excluded": ("2024-01-10", "2024-01-12")}
TRACKER = {"launch_date": "2024-01-21", "half_window": 9}
MEANS = {"money_dp": 4, "load_dp": 4}


def _user_features(sessions: DataFrame) -> DataFrame:
    means = ("avg_steps", "avg_page_load_ms", "conversion_rate", "revenue_per_session")
    digits = {"total_revenue": 2, **{name: 6 for name in means}}
    return round_columns(segments.user_features(sessions, devices=None), digits)


def _scaled_features(sessions: DataFrame) -> DataFrame:
    scaled = segments.scaled_features(segments.user_features(sessions))
    return round_columns(scaled, {name: 6 for name in segments.FEATURES})


def _rule_labels(sessions: DataFrame) -> DataFrame:
    """Fixed labels by rule, so that profiles can be compared exactly."""
    conversions, visits = F.col("total_conversions"), F.col("total_sessions")
    label = (
        F.when(F.col("revenue_per_session") > 60, 4)
        .when((conversions == 0) & (visits == 1), 0)
        .when(conversions == 0, 1)
        .when(visits <= 3, 2)
        .otherwise(3)
    )
    return segments.user_features(sessions).withColumn("segment_id", label)


PROFILE_DIGITS = {"avg_sessions": 6, "avg_cr": 6, "avg_revenue": 6, "avg_days_active": 6}


def _segment_profile(sessions: DataFrame) -> DataFrame:
    return round_columns(segments.segment_profile(_rule_labels(sessions)), PROFILE_DIGITS)


def _persona_rules(sessions: DataFrame) -> DataFrame:
    named = segments.persona_rules(segments.segment_profile(_rule_labels(sessions)))
    return round_columns(named, PROFILE_DIGITS)


_OPERATORS: dict[str, tuple[Callable[..., DataFrame], dict]] = {
    "north_star": (northstar.north_star, EXACT),
    "north_star_daily_stats": (northstar.north_star_daily_stats, {}),
    "daily_cr": (northstar.daily_cr, {}),
    "driver_page_experience": (northstar.driver_page_experience, {"load_dp": 4}),
    "load_cr_correlation": (northstar.load_cr_correlation, {}),
    "driver_discovery": (northstar.driver_discovery, {}),
    "paid_vs_organic": (northstar.paid_vs_organic, {}),
    "driver_product_quality": (northstar.driver_product_quality, EXACT),
    "driver_price": (northstar.driver_price, EXACT),
    "funnel": (northstar.funnel, {}),
    "return_visitor_cr": (northstar.return_visitor_cr, {}),
    "returning_semi_anti": (northstar.returning_semi_anti, {}),
    "metrics_tree": (northstar.metrics_tree, EXACT),
    "metrics_tree_document": (northstar.metrics_tree_fields, EXACT),
    "north_star_report": (northstar.north_star_report, {}),
    "drop_verify_union": (diagnosis.drop_verify_union, DROP),
    "drop_verify_ztest": (diagnosis.drop_verify_ztest, DROP),
    "slice_device": (diagnosis.slice_device, DROP),
    "slice_location": (diagnosis.slice_location, DROP),
    "slice_category": (diagnosis.slice_category, DROP),
    "slice_all_dims": (diagnosis.slice_all_dims, DROP),
    "worst_segment": (diagnosis.worst_segment, DROP),
    "drop_hourly": (diagnosis.drop_hourly, {"load_dp": 4, **DROP}),
    "hourly_vs_prev": (diagnosis.hourly_vs_prev, DROP),
    "biggest_drop_hour": (diagnosis.biggest_drop_hour, DROP),
    "root_cause": (diagnosis.root_cause, DROP),
    "business_impact": (diagnosis.business_impact, DROP),
    "business_impact_missed": (diagnosis.business_impact_missed, {**EXACT, **DROP}),
    "diagnosis_report": (diagnosis.diagnosis_report, DROP),
    "launch_pre_post": (launch.launch_pre_post, {"launch_date": "2024-01-21", **RANGE, **MEANS}),
    "launch_weekly": (launch.launch_weekly, {"label_cutoff": "2024-01-18", **RANGE, **MEANS}),
    "launch_device": (launch.launch_device, {"launch_date": "2024-01-21", **RANGE}),
    "launch_split": (launch.launch_split, LAUNCH),
    "launch_primary": (launch.launch_primary, LAUNCH),
    "launch_guardrails": (launch.launch_guardrails, {**LAUNCH, **MEANS}),
    "launch_recommendation": (launch.launch_recommendation, LAUNCH),
    "launch_side_effects": (launch.launch_side_effects, LAUNCH),
    "launch_report": (launch.launch_report, LAUNCH),
    "daily_kpis": (anomaly.daily_kpis, {**MEANS, "ma_dp": 8}),
    "anomaly_events_inclusive": (anomaly.anomaly_events_inclusive, {"z_threshold": 1.5}),
    "launch_tracker": (anomaly.launch_tracker, {**TRACKER, "ma_dp": 8}),
    "launch_tracker_sql": (
        anomaly.launch_tracker_sql,
        {"launch_date": "2024-01-21", "days": ("2024-01-12", "2024-01-30"), "ma_dp": 8},
    ),
    "weekly_digest": (anomaly.weekly_digest, {"z_threshold": 1.5, "digits": 6, **MEANS}),
    "has_anomaly": (anomaly.has_anomaly, {"z_threshold": 1.5}),
    "anomaly_status": (anomaly.anomaly_status, {**MEANS, "ma_dp": 8}),
    "anomaly_events": (anomaly.anomaly_events, {}),
    "driver_health": (anomaly.driver_health, {"category": "CAT_0", "steps_dp": 4, **MEANS}),
    "driver_health_document": (anomaly.driver_health_fields, {"category": "CAT_0", "steps_dp": 4, **MEANS}),
    "measure_cr": (measures.measure_cr, {"by": ("device",), "digits": 8}),
    "measure_rps": (measures.measure_rps, {"by": ("product_category",), "digits": 8}),
    "measure_cr_vs_baseline": (measures.measure_cr_vs_baseline, {"digits": 8}),
    "measure_cr_7d_calendar": (measures.measure_cr_7d_calendar, {"digits": 8}),
    "measure_launch_lift": (measures.measure_launch_lift, {**TRACKER, "digits": 8}),
    "session_calendar": (quality.session_calendar, {}),
    "sample_sessions": (quality.sample_sessions, {"n": 2500}),
    "dataset_summary": (quality.dataset_summary, {"load_dp": 4}),
    "session_invariants": (quality.session_invariants, {}),
    "cohort_retention": (cohorts.cohort_retention, {"min_size": 100, "limit": 20}),
    "cohort_days_since_first": (cohorts.cohort_days_since_first, {}),
    "primary_device": (segments.primary_device, {}),
    "user_features": (_user_features, {}),
    "scaled_features": (_scaled_features, {}),
    "segment_profile": (_segment_profile, {}),
    "persona_rules": (_persona_rules, {}),
    "user_segments": (segments.user_segments, {"coordinates": True, "digits": 5}),
    "user_segment_profile": (segments.user_segment_profile, {"digits": 5}),
    "optimal_k": (segments.optimal_k, {"digits": 4}),
}


def _bind(operator: Callable[..., DataFrame], params: dict) -> Query:
    return lambda spark, sf_dir: operator(load_sessions(spark, sf_dir), **params)


def build_queries() -> dict[str, Query]:
    return {name: _bind(operator, params) for name, (operator, params) in _OPERATORS.items()}
