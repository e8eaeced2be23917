"""Edge cases: gaps, ties, empty sides, constant series, boundary times."""

from __future__ import annotations

import pytest

from builders import sessions_of, sessions_per_day, ts
from sessionscope.operators import (
    anomaly,
    cohorts,
    diagnosis,
    launch,
    measures,
    northstar,
    quality,
    segments,
)


def collect(df):
    return [r.asDict() for r in df.collect()]


def test_empty_input(spark):
    none = sessions_of(spark, [{}]).where("1 = 0")
    row = northstar.north_star(none).first()
    assert (row.total_sessions, row.total_conversions, row.conversion_rate_pct) == (0, None, None)
    assert anomaly.daily_kpis(none).count() == 0
    assert measures.measure_cr(none).first().conversion_rate == 0.0
    verdict = diagnosis.drop_verify_ztest(none).first()
    assert verdict.p_value is None and "NOISE" in verdict.verdict
    assert launch.launch_recommendation(none).first().recommendation.startswith("🛑")
    assert quality.dataset_summary(none).first().total_sessions == 0
    assert northstar.load_cr_correlation(none).first().p_value is None


def test_one_day_has_no_spread(spark):
    row = anomaly.daily_kpis(sessions_per_day(spark, [("2024-01-01", 10, 2, 20.0)])).first()
    assert row.conversion_rate_7d_std is None and row.cr_zscore is None
    assert row.cr_anomaly is False


def test_constant_metric_never_alerts(spark):
    table = sessions_per_day(spark, [(f"2024-01-{d:02d}", 10, 5, 50.0) for d in range(1, 11)])
    assert {r["cr_zscore"] for r in collect(anomaly.daily_kpis(table))} == {None}
    assert {r["alert_status"] for r in collect(anomaly.anomaly_status(table))} == {"✅ Normal"}
    assert anomaly.anomaly_events(table).count() == 0


def test_row_frame_and_calendar_frame_differ_on_a_gap(spark):
    table = sessions_per_day(
        spark, [("2024-01-01", 10, 10, 1.0), ("2024-01-09", 10, 0, 0.0), ("2024-01-10", 10, 5, 1.0)]
    )
    by_row = [r["cr_7d_rolling_avg_pct"] for r in collect(northstar.daily_cr(table))]
    by_date = [r["cr_7d_rolling_avg"] for r in collect(measures.measure_cr_7d_calendar(table))]
    assert by_row == [100.0, 50.0, 50.0]
    assert by_date == [1.0, 0.0, 0.25]


def test_calendar_measure_is_a_ratio_of_sums(spark):
    table = sessions_per_day(spark, [("2024-01-01", 30, 30, 1.0), ("2024-01-02", 10, 0, 0.0)])
    assert collect(measures.measure_cr_7d_calendar(table))[1]["cr_7d_rolling_avg"] == 0.75


def test_trackers_differ_in_their_first_day(spark):
    table = sessions_per_day(spark, [("2024-04-09", 10, 8, 1.0), ("2024-04-10", 10, 2, 1.0)])
    warm = anomaly.launch_tracker(table).first()
    cold = anomaly.launch_tracker_sql(table).first()
    assert str(warm.date) == str(cold.date) == "2024-04-10"
    assert warm.conversion_rate_7d_ma == pytest.approx(0.5)
    assert cold.cr_7d_ma_pct == pytest.approx(20.0)


def test_boundary_times_belong_to_their_day(spark):
    table = sessions_of(
        spark,
        [
            {"timestamp": ts("2024-04-02T23:59:59")},
            {"timestamp": ts("2024-04-03T00:00:00"), "converted": 1},
            {"timestamp": ts("2024-04-09T23:59:59.999999")},
            {"timestamp": ts("2024-04-10T00:00:00"), "converted": 1},
            {"timestamp": ts("2024-04-10T23:59:59.999999")},
            {"timestamp": ts("2024-04-11T00:00:00")},
        ],
    )
    rows = {r["period"]: r for r in collect(diagnosis.drop_verify_union(table))}
    assert rows["baseline_7d"]["sessions"] == 2 and rows["drop_day"]["sessions"] == 2
    assert rows["drop_day"]["cr_pct"] == 50.0


def drop_rows(day, n, converted, **columns):
    return [
        {"timestamp": ts(f"{day}T0{i % 10}:00:00"), "converted": int(i < converted), **columns}
        for i in range(n)
    ]


def test_one_sided_values_and_zero_baselines(spark):
    table = sessions_of(
        spark,
        drop_rows("2024-04-05", 4, 2, device="mobile")
        + drop_rows("2024-04-10", 4, 1, device="mobile")
        + drop_rows("2024-04-05", 4, 0, device="desktop")
        + drop_rows("2024-04-10", 4, 1, device="desktop")
        + drop_rows("2024-04-05", 4, 2, device="tablet"),
    )
    rows = {r["value"]: r for r in collect(diagnosis.slice_all_dims(table, dimensions=("device",)))}
    assert set(rows) == {"mobile", "desktop"}
    assert rows["mobile"]["relative_change_pct"] == -50.0
    assert rows["desktop"]["relative_change_pct"] is None
    outer = {r["device"]: r["drop_day_cr_pct"] for r in collect(diagnosis.slice_device(table))}
    assert outer == {"mobile": 25.0, "desktop": 25.0, "tablet": None}


def test_ties_go_to_the_first_key(spark):
    table = sessions_of(
        spark,
        [
            row
            for name in ("b", "a", "c")
            for row in drop_rows("2024-04-05", 4, 2, device=name, traffic_source=name)
            + drop_rows("2024-04-10", 4, 1, device=name, traffic_source=name)
        ],
    )
    assert {r["worst_value"] for r in collect(diagnosis.worst_segment(table))} == {"a"}
    visits = sessions_of(
        spark, [{"device": d, "user_id": "U9"} for d in ("tablet", "mobile", "mobile", "tablet")]
    )
    assert segments.primary_device(visits).first().primary_device == "mobile"
    assert segments.user_features(visits).first().primary_device == "mobile"


def test_root_cause_rules(spark):
    def table(mobile_after, desktop_after):
        rows = []
        for device, after in (("mobile", mobile_after), ("desktop", desktop_after)):
            for category in ("CAT_1", "CAT_2"):
                common = {"device": device, "product_category": category}
                rows += drop_rows("2024-04-05", 10, 8, **common) + drop_rows("2024-04-10", 10, after, **common)
        return sessions_of(spark, rows)

    mobile = diagnosis.root_cause(table(2, 7)).first()
    assert mobile.root_cause_category == "Mobile UX / Payment Gateway"
    assert mobile.primary_hypothesis.startswith("MOBILE PAYMENT / UX ISSUE: Mobile CR dropped -75.0% vs desktop -12.5%.")
    even = diagnosis.root_cause(table(4, 4)).first()
    assert even.root_cause_category == "Product Category: CAT_1"


def test_missed_conversions_are_truncated(spark):
    table = sessions_per_day(spark, [("2024-04-09", 100, 30, 1.0), ("2024-04-10", 9, 0, 0.0)])
    assert diagnosis.business_impact_missed(table).first().missed_conversions == 2


def test_users_seen_once_and_without_id(spark):
    table = sessions_of(
        spark,
        [
            {"user_id": "U1", "converted": 1},
            {"user_id": "U1", "timestamp": ts("2024-01-03T08:00:00")},
            {"user_id": "U2", "converted": 1},
            {"user_id": None},
            {"user_id": None},
        ],
    )
    row = northstar.return_visitor_cr(table).first()
    assert (row.returning_sessions, row.new_sessions) == (2, 3)
    sides = {r["visitor_type"]: r for r in collect(northstar.returning_semi_anti(table))}
    assert sides["returning"]["sessions"] == 2 and sides["new"]["sessions"] == 3
    assert sides["new"]["cr_pct"] == pytest.approx(row.new_visitor_cr_pct, abs=1e-3)
    assert cohorts.cohort_days_since_first(table).count() == 3
    cohort = cohorts.cohort_retention(table, min_size=1).first()
    assert (cohort.cohort_size, cohort.returned_users, cohort.retention_rate_pct) == (2, 1, 50.0)
    assert segments.user_features(table).count() == 2
    assert quality.dataset_summary(table).first().unique_users == 2


def test_dominant_user_gets_the_same_days(spark):
    rows = [{"user_id": "HOT", "timestamp": ts(f"2024-01-{1 + i % 20:02d}T01:00:00")} for i in range(60)]
    rows += [{"user_id": f"U{i}", "timestamp": ts(f"2024-01-{1 + i % 9:02d}T02:00:00")} for i in range(60)]
    table = sessions_of(spark, rows)
    plain = collect(cohorts.cohort_days_since_first(table, heavy_share=2.0))
    spread = collect(cohorts.cohort_days_since_first(table, heavy_share=0.1))
    key = lambda r: r["session_id"]
    assert sorted(plain, key=key) == sorted(spread, key=key)
    assert len(plain) == 120 and max(r["days_since_first"] for r in plain) == 19


def test_days_active_counts_each_day_once(spark):
    table = sessions_of(
        spark,
        [
            {"timestamp": ts("2024-01-01T01:00:00"), "device": "mobile"},
            {"timestamp": ts("2024-01-01T02:00:00"), "device": "watch"},
            {"timestamp": ts("2024-01-05T02:00:00"), "device": "watch"},
        ],
    )
    row = segments.user_features(table).first()
    assert (row.total_sessions, row.days_active, row.primary_device) == (3, 2, "watch")
    assert (row.device_mobile, row.device_desktop, row.device_tablet) == (0, 0, 0)


def test_guardrails_pass_on_equal_means(spark):
    rows = [{"timestamp": ts("2024-04-20T00:00:00"), "page_load_ms": v} for v in (900.0, 1100.0)]
    rows += [{"timestamp": ts("2024-05-02T00:00:00"), "page_load_ms": v} for v in (950.0, 1050.0)]
    table = sessions_of(spark, rows)
    load = [r for r in collect(launch.launch_guardrails(table)) if r["metric"].startswith("Page")][0]
    assert load["passed"] is True and load["verdict"].startswith("✅") and load["p_value"] == 1.0


def test_recommendation_branches(spark):
    def decide(pre, post, load_after):
        days = [("2024-04-20", 1000, pre, float(pre)), ("2024-05-02", 1000, post, float(post))]
        table = sessions_per_day(spark, days)
        if load_after:
            slower = "CASE WHEN date >= DATE'2024-05-01' THEN 2000D ELSE page_load_ms END"
            table = table.selectExpr("* EXCEPT (page_load_ms)", f"{slower} AS page_load_ms")
        return launch.launch_recommendation(table).first().recommendation

    assert decide(100, 200, False).startswith("🚀")
    assert decide(100, 200, True).startswith("⚠️")
    assert decide(100, 101, False).startswith("🛑")
    assert decide(200, 100, False).startswith("🛑")


def test_launch_window_leaves_out_the_day_after_the_drop(spark):
    days = [f"2024-04-{d:02d}" for d in (1, 9, 10, 13, 14, 30)] + ["2024-03-31", "2024-05-01", "2024-05-30", "2024-05-31"]
    table = sessions_per_day(spark, [(d, 1, 0, 0.0) for d in days])
    split = {(str(r.date), r.period) for r in launch.launch_split(table).collect()}
    assert split == {
        ("2024-04-01", "pre_launch"),
        ("2024-04-09", "pre_launch"),
        ("2024-04-14", "pre_launch"),
        ("2024-04-30", "pre_launch"),
        ("2024-05-01", "post_launch"),
        ("2024-05-30", "post_launch"),
    }


def test_small_segments_are_gated(spark):
    rows = drop_rows("2024-04-20", 6, 3, device="mobile") + drop_rows("2024-05-02", 6, 2, device="mobile")
    rows += drop_rows("2024-04-20", 2, 1, device="tablet") + drop_rows("2024-05-02", 9, 2, device="tablet")
    table = sessions_of(spark, rows)
    effects = collect(launch.launch_side_effects(table, device_gate=5, source_gate=5))
    assert [r["segment"] for r in effects] == ["Device: mobile", "Source: organic_search"]
    assert effects[0]["lift_pct"] == pytest.approx(-33.33)
    assert effects[0]["concern"] == "⚠️ Regression on segment"


def test_a_fourth_device_is_a_segment_unless_a_list_leaves_it_out(spark):
    rows = drop_rows("2024-04-20", 6, 3, device="tv") + drop_rows("2024-05-02", 6, 2, device="tv")
    table = sessions_of(spark, rows)
    gates = {"device_gate": 5, "source_gate": 50}
    assert [r["segment"] for r in collect(launch.launch_side_effects(table, **gates))] == ["Device: tv"]
    assert not collect(launch.launch_side_effects(table, devices=("mobile",), **gates))
    report = collect(launch.launch_report(table, **gates))
    assert [r["metric"] for r in report if r["section"] == "Side effects"] == ["Device: tv"]


def test_correlation_of_a_constant_is_null(spark):
    row = northstar.load_cr_correlation(sessions_of(spark, [{"converted": 1}, {"converted": 0}])).first()
    assert row.correlation_with_cr is None and row.p_value is None


def test_weekly_digest_numbers_weeks_from_the_first_day(spark):
    days = [(f"2024-01-{d:02d}", 100, 10, 10.0) for d in range(3, 13)]
    days[-1] = ("2024-01-12", 100, 90, 10.0)
    weeks = collect(anomaly.weekly_digest(sessions_per_day(spark, days)))
    assert [(w["week_num"], str(w["week_start"]), str(w["week_end"])) for w in weeks] == [
        (1, "2024-01-03", "2024-01-09"),
        (2, "2024-01-10", "2024-01-12"),
    ]
    assert weeks[1]["anomaly_days"] == 1 and weeks[1]["anomaly_dates"] == "2024-01-12"
    assert weeks[0]["anomaly_dates"] == ""


def test_has_anomaly_marks_event_days(spark):
    days = [(f"2024-01-{d:02d}", 100, 10, 10.0) for d in range(1, 11)] + [("2024-01-11", 100, 90, 10.0)]
    flags = {str(r.date): r.has_anomaly for r in anomaly.has_anomaly(sessions_per_day(spark, days)).collect()}
    assert flags["2024-01-11"] == "🚨 ANOMALY"
    assert set(flags.values()) == {"🚨 ANOMALY", "✅ Normal"} and len(flags) == 11


def test_every_device_gets_a_column(spark):
    table = sessions_of(spark, [{"user_id": "U1", "device": "watch"}, {"user_id": "U2"}, {"user_id": "U2", "device": None}])
    rows = {r.user_id: r for r in segments.user_features(table, devices=None).collect()}
    assert (rows["U1"].device_watch, rows["U1"].device_mobile, rows["U1"].device_tablet) == (1, 0, 0)
    assert (rows["U2"].device_watch, rows["U2"].device_mobile, rows["U2"].device_desktop) == (0, 1, 0)
    many = sessions_of(spark, [{"user_id": "U", "device": f"d{i}"} for i in range(4)])
    with pytest.raises(ValueError, match="devices"):
        segments.device_values(many, at_most=3)


def test_health_follows_the_values(spark):
    table = sessions_of(spark, [{"user_id": f"U{i}", "converted": i % 2, "revenue": 100.0 * (i % 2), "page_load_ms": 2600.0, "traffic_source": "direct"} for i in range(4)])
    health = {r.metric: r.health for r in northstar.north_star_report(table).collect()}
    assert health["Avg Page Load"] == health["Organic Share"] == "⚠️ At Risk"
    assert health["Revenue/Session"] == "✅ Healthy"
    assert health["Return Visitor Lift"] is None  # nobody returned
