"""Readers, coercion, calendar columns, sinks, documents and the job."""

from __future__ import annotations

import json
from datetime import date, datetime
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from builders import sessions_of, ts
from sessionscope.operators import anomaly, northstar, quality
from sessionscope.plans import job
from sessionscope.schema import SESSION_SCHEMA
from sessionscope.sources.events import load_sessions, sessions_from_events
from sessionscope.sources.sessions import read_sessions, register_sessions

SF_DIR = "/root/testdata/sf0.001"


def wide_frame() -> pd.DataFrame:
    """Sessions with the types a pandas writer leaves behind."""
    times = pd.to_datetime(["2024-02-29 23:59:59", "2024-03-01 00:00:00"])
    return pd.DataFrame(
        {
            "session_id": ["S00000001", "S00000002"],
            "user_id": ["U0000001", "U0000002"],
            "timestamp": times,
            "device": ["mobile", "desktop"],
            "location": ["Pune", "Delhi"],
            "traffic_source": ["email", "direct"],
            "product_category": ["Books", "Beauty"],
            "steps_completed": [1, 5],
            "converted": [0, 1],
            "revenue": [0.0, 99.5],
            "page_load_ms": [1200.5, 900.0],
            "bounced": [1, 0],
            "date": [t.date() for t in times],
            "week": ["2024-02-26/2024-03-03"] * 2,
            "month": ["2024-02", "2024-03"],
            "hour": [23, 0],
        }
    )


def check_wide(spark, path):
    sessions = read_sessions(spark, str(path))
    assert sessions.schema.simpleString() == SESSION_SCHEMA.simpleString()
    rows = sessions.orderBy("session_id").collect()
    assert rows[0].timestamp == datetime(2024, 2, 29, 23, 59, 59) and rows[0].date == date(2024, 2, 29)
    assert rows[1].converted == 1 and rows[1].hour == 0
    return sessions


def test_wide_types_are_coerced(spark, tmp_path):
    pq.write_table(pa.Table.from_pandas(wide_frame()), tmp_path / "s.parquet", coerce_timestamps="us")
    check_wide(spark, tmp_path / "s.parquet")


def test_nanosecond_timestamps(spark, tmp_path):
    frame = wide_frame()
    frame["timestamp"] = frame["timestamp"].astype("datetime64[ns]")
    pq.write_table(pa.Table.from_pandas(frame), tmp_path / "s.parquet", version="2.6")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        check_wide(spark, tmp_path / "s.parquet")
    finally:
        spark.conf.unset("spark.sql.legacy.parquet.nanosAsLong")


def test_calendar_is_derived_when_absent(spark, tmp_path):
    frame = wide_frame()
    stored = ["week", "month", "date", "hour"]
    pq.write_table(pa.Table.from_pandas(frame.drop(columns=stored)), tmp_path / "s.parquet", coerce_timestamps="us")
    derived = read_sessions(spark, str(tmp_path / "s.parquet")).orderBy("session_id").toPandas()
    for name in stored:
        assert list(derived[name]) == list(frame[name])


def test_calendar_does_not_depend_on_the_time_zone(spark):
    table = sessions_of(spark, [{"timestamp": ts("2024-03-31T00:30:00")}, {"timestamp": ts("2024-12-31T23:59:59")}])
    seen = set()
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            rows = quality.session_calendar(table).orderBy("session_id").collect()
            seen.add(tuple((str(r.date), r.week, r.month, r.hour) for r in rows))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert seen == {
        (
            ("2024-03-31", "2024-03-25/2024-03-31", "2024-03", 0),
            ("2024-12-31", "2024-12-30/2025-01-05", "2024-12", 23),
        )
    }


def test_missing_input_and_missing_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="No session data"):
        read_sessions(spark, str(tmp_path / "nowhere"))
    spark.range(1).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="session_id"):
        read_sessions(spark, str(tmp_path / "other"))


def test_registered_view_answers_sql(spark):
    register_sessions(load_sessions(spark, SF_DIR))
    text = "SELECT count(*) AS n, sum(converted) AS c FROM sessions"
    row = spark.sql(text).first()
    star = northstar.north_star(load_sessions(spark, SF_DIR)).first()
    assert (row.n, row.c) == (star.total_sessions, star.total_conversions)


def test_invariants_report_broken_rows(spark):
    table = sessions_of(
        spark,
        [
            {"steps_completed": 1, "bounced": 0},
            {"steps_completed": 2, "bounced": 1},
            {"steps_completed": 3, "converted": 1, "revenue": 5.0},
            {"revenue": 7.0},
            {"page_load_ms": 0.0},
            {},
        ],
    )
    found = {r.rule: r.violations for r in quality.session_invariants(table).collect()}
    assert found == {
        "bounced_iff_first_step": 2,
        "revenue_only_if_converted": 1,
        "converted_only_from_step_4": 1,
        "page_load_positive": 1,
        "steps_between_1_and_5": 0,
    }


def test_metrics_tree_document(spark):
    tree = northstar.metrics_tree(load_sessions(spark, SF_DIR))
    (text,) = northstar.metrics_tree_document(tree).toJSON().collect()
    document = json.loads(text)
    assert document["north_star"]["total_sessions"] == 1000 and document["north_star"]["north_star_metric"] == "Conversion Rate"
    drivers = {d["driver"]: d for d in document["level1_drivers"]}
    assert list(drivers) == ["Page Experience", "Price & Value", "Discovery", "Product Quality"]
    load = drivers["Page Experience"]["level2"]["page_load_speed"]
    assert set(load) == {"value", "benchmark", "status", "correlation_with_cr", "p_value"} and load["benchmark"] == "< 2500ms"
    assert drivers["Page Experience"]["health"] == ("✅ Healthy" if load["status"] == "✅" else "⚠️ At Risk")
    assert set(drivers["Price & Value"]["level2"]) == {"revenue_per_session", "category_aov", "traffic_source_cr"}
    assert set(drivers["Discovery"]["level2"]) == {"traffic_mix", "organic_share", "paid_efficiency"}
    steps = drivers["Product Quality"]["level2"]["funnel_steps_distribution"]
    assert set(steps) == set("12345") and sum(steps.values()) == pytest.approx(100, abs=0.05)


def test_driver_health_document(spark):
    health = anomaly.driver_health(load_sessions(spark, SF_DIR), category="CAT_0")
    (text,) = anomaly.driver_health_document(health).toJSON().collect()
    document = json.loads(text)
    assert list(document) == ["north_star", "page_experience", "price_value", "discovery", "product_quality"]
    assert set(document["north_star"]) == {"name", "value", "unit", "status"}
    assert document["page_experience"]["sub_drivers"]["bounce_rate"]["unit"] == "%"
    assert document["product_quality"]["status"] == "healthy"


def test_documents_of_nothing(spark):
    empty = load_sessions(spark, SF_DIR).limit(0)
    (text,) = northstar.metrics_tree_document(northstar.metrics_tree(empty)).toJSON().collect()
    assert [d["driver"] for d in json.loads(text)["level1_drivers"]][0] == "Page Experience"
    assert anomaly.driver_health_document(anomaly.driver_health(empty)).count() == 1


def test_job_writes_every_feed(spark, tmp_path):
    settings = job.Settings(str(tmp_path), drop_date="2024-01-10", launch_date="2024-01-21", max_users=200)
    names = job.run(load_sessions(spark, SF_DIR), settings)
    assert len(names) == 6
    written = {p.name for p in Path(tmp_path).iterdir() if (p / "_SUCCESS").exists()}
    assert {
        "session_sample",
        "metrics_tree_json",
        "diagnosis_report",
        "launch_report",
        "daily_kpis_csv",
        "anomaly_events",
        "feature_launch_tracker",
        "driver_health",
        "user_segments",
        "segment_profiles",
    } <= written
    segments = spark.read.option("header", True).csv(str(tmp_path / "user_segments"))
    assert segments.columns == [
        "user_id",
        "segment_id",
        "segment_name",
        "total_sessions",
        "conversion_rate",
        "revenue_per_session",
        "days_active",
    ]
    assert segments.count() == 498


def test_job_command_line(spark, tmp_path):
    dates = ["--drop-date", "2024-01-10", "--launch-date", "2024-01-21"]
    job.main(["--events", SF_DIR, "--output", str(tmp_path), "--module", "2", *dates])
    report = spark.read.option("header", True).csv(str(tmp_path / "diagnosis_report"))
    assert report.count() == 20 and set(report.columns) == {"step", "section", "ord", "metric", "value"}


def test_job_takes_every_setting_from_the_command_line(spark, tmp_path):
    options = ["--segments", "3", "--starts", "2", "--max-users", "150", "--z-threshold", "1.5", "--half-window", "5"]
    for module in ("4", "5"):
        job.main(["--events", SF_DIR, "--output", str(tmp_path), "--module", module, "--launch-date", "2024-01-21", *options])
    profile = spark.read.option("header", True).csv(str(tmp_path / "segment_profiles"))
    assert profile.count() == 3 and {"segment_silhouette", "silhouette"} <= set(profile.columns)
    assert spark.read.option("header", True).csv(str(tmp_path / "feature_launch_tracker")).count() == 11


def test_job_runs_one_module(spark, tmp_path):
    settings = job.Settings(str(tmp_path), launch_date="2024-01-21")
    assert job.run(load_sessions(spark, SF_DIR), settings, module=4) == ["run_anomaly"]
    assert not (tmp_path / "metrics_tree").exists() and (tmp_path / "daily_kpis").exists()


def test_long_ids_stay_apart(spark):
    rows = [(10**12 + i, "2024-01-10 08:00:00", 250_000 + i, "view", 1.0, '{"k": 1}') for i in range(200)]
    rows += [(10**8 + i, "2024-01-10 08:00:00", 10**7 + i, "view", 1.0, '{"k": 1}') for i in range(200)]
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events = frame.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    counted = sessions_from_events(events).agg(F.countDistinct("session_id"), F.countDistinct("user_id")).first()
    assert tuple(counted) == (400, 400)


def test_sample_refuses_null_ids(spark):
    frame = spark.createDataFrame([("a", 1), (None, 2)], "session_id string, n int")
    with pytest.raises(Exception, match="has no session_id"):
        quality.sample_sessions(frame, n=2).collect()
