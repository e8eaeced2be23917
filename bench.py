"""Time the headline queries and print one JSON line.

`BENCH_SF_DIR` picks the tables, `BENCH_CPUS` the local threads,
`BENCH_QUERIES` a comma-separated list of query names and `BENCH_RUNS` how often
each query runs.  `queries` holds the fastest run of each, `first_runs` the sum of
the first ones, which include code generation and JIT.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "north_star daily_cr driver_page_experience driver_discovery driver_product_quality funnel "
    "return_visitor_cr metrics_tree drop_verify_ztest slice_all_dims hourly_vs_prev root_cause "
    "business_impact cohort_retention diagnosis_report launch_pre_post launch_primary "
    "launch_guardrails launch_side_effects launch_report daily_kpis anomaly_status has_anomaly "
    "weekly_digest driver_health sample_sessions cohort_days_since_first user_features "
    "scaled_features persona_rules user_segments"
).split()


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sessionscope-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # No Python call sites in plans: building columns costs half the round trips.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(build, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    from sessionscope.catalog import build_queries
    from sessionscope.plans.ship import ship_package

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    ship_package(spark)
    queries = build_queries()
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    timed(queries["north_star"], spark, sf_dir)
    timed(queries["drop_verify_ztest"], spark, sf_dir)
    repeats = range(int(os.environ.get("BENCH_RUNS", "2")))
    runs = {name: [timed(queries[name], spark, sf_dir) for _ in repeats] for name in names}
    seconds = {name: round(min(times), 3) for name, times in runs.items()}
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "first_runs": round(sum(times[0] for times in runs.values()), 3),
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
