"""What keeps the plans sound at scale: pushdown, single scans, reuse, partition invariance."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

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
from sessionscope.sources.events import load_sessions
from sessionscope.operators.rollup import dimension_rollup
from sessionscope.sources.sessions import read_sessions, read_user_table
from sessionscope.sources.sinks import write_sessions, write_sessions_by_user

SF_DIR = "/root/testdata/sf0.001"
DROP = {"drop_date": "2024-01-10"}
LAUNCH = {"launch_date": "2024-01-21", "window_days": 10, **DROP}


def final_plan(df):
    """The executed plan after adaptive execution."""
    df._jdf.collectToPython()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def sessions(spark):
    return load_sessions(spark, SF_DIR)


@pytest.fixture(scope="module")
def stored(spark, sessions, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "sessions")
    write_sessions(sessions, path, files=4)
    return read_sessions(spark, path)


@pytest.mark.parametrize(
    "operator, params, scans",
    [
        (northstar.north_star, {}, 1),
        (northstar.driver_price, {}, 1),
        (northstar.metrics_tree, {}, 2),
        (northstar.north_star_report, {}, 2),
        (northstar.returning_semi_anti, {}, 1),
        (quality.dataset_summary, {}, 1),
        (northstar.return_visitor_cr, {}, 1),
        (diagnosis.diagnosis_report, DROP, 1),
        (diagnosis.slice_all_dims, DROP, 1),
        (diagnosis.root_cause, DROP, 1),
        (launch.launch_report, LAUNCH, 1),
        (launch.launch_guardrails, LAUNCH, 1),
        (launch.launch_side_effects, LAUNCH, 1),
        (anomaly.daily_kpis, {}, 1),
        (anomaly.has_anomaly, {}, 1),
        (anomaly.driver_health, {}, 1),
        (cohorts.cohort_retention, {}, 1),
        (segments.user_features, {}, 1),
    ],
)
def test_number_of_scans(sessions, operator, params, scans):
    assert final_plan(operator(sessions, **params)).count("FileScan") == scans


def test_launch_report_copies_no_session(sessions):
    plan = final_plan(launch.launch_report(sessions, **LAUNCH))
    assert plan.count("FileScan") == 1 and "Expand" not in plan


def test_baseline_is_one_row_beside_the_groups(sessions):
    plan = final_plan(measures.measure_cr_vs_baseline(sessions, by=("user_id",)))
    assert plan.count("FileScan") == 1 and "Window" not in plan


def test_dates_reach_the_scan(sessions):
    plan = final_plan(diagnosis.drop_verify_ztest(sessions, **DROP))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "GreaterThanOrEqual(ts,2024-01-03T00:00)" in pushed
    assert "LessThan(ts,2024-01-11T00:00)" in pushed


def test_only_needed_columns_are_read(sessions):
    plan = final_plan(northstar.daily_cr(sessions))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_dominant_user_does_not_fill_a_partition(spark, sessions):
    hot = F.when(F.substring("session_id", -1, 1).isin("0", "3", "6", "9"), "HOT").otherwise(F.col("user_id"))
    skewed = sessions.withColumn("user_id", hot)
    settings = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)

        def largest(share):
            dated = cohorts.cohort_days_since_first(skewed, heavy_share=share)
            sizes = dated.groupBy(F.spark_partition_id()).count().collect()
            assert sum(r[1] for r in sizes) == 1000
            return max(r[1] for r in sizes)

        # Eight partitions of 125 rows each would be even; 400 rows are one user's.
        assert largest(0.01) < 200 and largest(2.0) > 400
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_days_prune_partitions(stored):
    plan = final_plan(diagnosis.drop_hourly(stored, **DROP))
    assert re.search(r"PartitionFilters: \[[^\]]*date#\d+ >= 2024-01-10", plan)


def test_stored_sessions_are_the_same_rows(sessions, stored):
    assert sorted(map(tuple, sessions.select(stored.columns).collect())) == sorted(map(tuple, stored.collect()))


def test_user_work_takes_one_shuffle(sessions):
    assert final_plan(segments.user_features(sessions)).count("Exchange hashpartitioning") == 1


def test_scaling_reuses_the_user_aggregation(sessions):
    plan = final_plan(segments.scaled_features(segments.user_features(sessions)))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_no_cartesian_product_and_no_python_over_sessions(sessions):
    for operator in (cohorts.cohort_days_since_first, quality.sample_sessions, segments.user_features):
        plan = final_plan(operator(sessions))
        assert "CartesianProduct" not in plan and "EvalPython" not in plan


@pytest.mark.parametrize(
    "operator, params",
    [
        (quality.sample_sessions, {"n": 137}),
        (northstar.driver_product_quality, {}),
        (diagnosis.slice_all_dims, DROP),
        (cohorts.cohort_retention, {"min_size": 5}),
        (cohorts.cohort_days_since_first, {"heavy_share": 0.004}),
        (segments.primary_device, {}),
        (launch.launch_side_effects, LAUNCH),
    ],
)
def test_results_do_not_depend_on_partitioning(sessions, operator, params):
    one, many = sessions.coalesce(1), sessions.repartition(13)
    rows = [sorted(map(str, operator(s, **params).collect())) for s in (one, many)]
    assert rows[0] == rows[1] and rows[0]


BY_USER = [
    (northstar.return_visitor_cr, {}),
    (cohorts.cohort_retention, {"min_size": 5}),
    (cohorts.cohort_days_since_first, {"heavy_share": None}),
    (segments.user_features, {}),
    (segments.primary_device, {}),
    (northstar.returning_semi_anti, {}),
    (quality.dataset_summary, {}),
]


@pytest.fixture(scope="module")
def by_user(spark, sessions):
    write_sessions_by_user(sessions, "sessions_by_user", buckets=4)
    yield read_user_table(spark, "sessions_by_user")
    spark.sql("DROP TABLE sessions_by_user")


@pytest.mark.parametrize("operator, params", BY_USER)
def test_user_table_needs_no_shuffle_by_user(sessions, by_user, operator, params):
    found = operator(by_user, **params)
    assert not re.search(r"Exchange hashpartitioning\((user_id|seen_user)", final_plan(found))
    assert rounded(found) == rounded(operator(sessions, **params))


def rounded(frame):
    """Rows in order; sums of doubles differ in their last digits."""
    rows = [[round(v, 9) if isinstance(v, float) else v for v in row] for row in frame.collect()]
    return sorted(map(str, rows))


def test_user_table_refuses_a_dominant_user(spark, sessions):
    hot = sessions.withColumn("user_id", F.when(F.col("session_id") < "S00000400", "HOT").otherwise(F.col("user_id")))
    with pytest.raises(ValueError, match="One user holds"):
        write_sessions_by_user(hot, "refused")
    assert not spark.catalog.tableExists("refused")
    with pytest.raises(FileNotFoundError):
        read_user_table(spark, "refused")


def test_split_by_join_equals_split_by_sums(spark, sessions):
    missing = sessions.withColumn("user_id", F.when(F.col("session_id") > "S00000100", F.col("user_id")))
    by_join = {r.visitor_type: r for r in northstar.returning_semi_anti(missing).collect()}
    sums = northstar.return_visitor_cr(missing).first()
    assert by_join["returning"].sessions == sums.returning_sessions and by_join["new"].sessions == sums.new_sessions


def test_moments_add_up_like_single_rows(spark, sessions):
    """Correlation from cells equals the one over rows, with nulls and a large common offset."""
    odd = sessions.withColumn("page_load_ms", F.when(F.crc32("session_id") % 7 != 0, F.col("page_load_ms") + 1e7))
    for table in (sessions, odd):
        cells = dimension_rollup(
            table, ("device", "traffic_source"), ("date",), n=F.count("*"), moments=("page_load_ms", "converted")
        )
        both = table.where("page_load_ms IS NOT NULL")
        total = cells.where("dimension = 'all'").first()
        rows = both.agg(F.corr("page_load_ms", "converted").alias("r"), F.count("*").alias("n")).first()
        assert total.n_xy == rows.n and total.xy / (total.xx * total.yy) ** 0.5 == pytest.approx(rows.r, abs=1e-9)


@pytest.mark.parametrize("n", [1, 10, 500, 999, 1000, 5000])
def test_sample_is_exact_for_any_size(sessions, n):
    drawn = {r.session_id for r in quality.sample_sessions(sessions, n).collect()}
    ordered = sessions.select("session_id", F.md5(F.concat(F.lit("42:"), "session_id")).alias("d"))
    expected = {r.session_id for r in ordered.orderBy("d").limit(n).collect()}
    assert drawn == expected and len(drawn) == min(n, 1000)


def test_sample_cut_keeps_few_rows_beyond_the_sample(spark):
    ids = spark.range(200_000).select(F.col("id").cast("string").alias("session_id"))
    for n in (50, 1000, 20_000):
        cut = quality.sample_cut(ids, n, "session_id")
        kept = quality.within_cut(ids, cut, "session_id").count()
        assert n <= kept <= 3 * n + 50


def test_seed_changes_the_sample(sessions):
    first, second = (
        {r.session_id for r in quality.sample_sessions(sessions, 100, seed).collect()} for seed in (1, 2)
    )
    assert first != second
