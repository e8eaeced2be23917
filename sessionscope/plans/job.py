"""Batch job that runs one module or all of them.

    python -m sessionscope.plans.job --input s3a://.../sessions --output s3a://.../out [--module 4]

Every module reads the same registered sessions view and writes its own folder,
so a failed module can be run again alone.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from sessionscope.operators import anomaly, cohorts, diagnosis, launch, northstar, quality, segments
from sessionscope.plans.ship import ship_package
from sessionscope.schema import (
    ALPHA,
    BASELINE_DAYS,
    DROP_DATE,
    DROP_DAYS,
    LAUNCH_DATE,
    LAUNCH_WINDOW_DAYS,
    TRACKER_HALF_WINDOW,
    Z_THRESHOLD,
)
from sessionscope.sources.events import load_sessions
from sessionscope.sources.sessions import read_sessions, register_sessions
from sessionscope.sources.sinks import write_csv, write_json, write_parquet


@dataclass(frozen=True)
class Settings:
    """Where the feeds go and what the analyses use; every field but ``output`` has a default and an option."""

    output: str
    drop_date: str = DROP_DATE
    drop_days: int = DROP_DAYS
    baseline_days: int = BASELINE_DAYS
    launch_date: str = LAUNCH_DATE
    window_days: int = LAUNCH_WINDOW_DAYS
    half_window: int = TRACKER_HALF_WINDOW
    z_threshold: float = Z_THRESHOLD
    alpha: float = ALPHA
    sample_rows: int = 100_000
    cohort_size: int = 50
    cohort_rows: int = 30
    category: str = "Electronics"
    segments: int = 4
    starts: int = 10
    seed: int = 42
    max_users: int | None = None

    def path(self, name: str) -> str:
        return f"{self.output.rstrip('/')}/{name}"

    @property
    def drop(self) -> dict:
        return {"drop_date": self.drop_date, "drop_days": self.drop_days, "baseline_days": self.baseline_days}

    @property
    def launch(self) -> dict:
        dropped = {"drop_date": self.drop_date, "drop_days": self.drop_days}
        return {"launch_date": self.launch_date, "window_days": self.window_days, **dropped}


def run_dataset(sessions: DataFrame, settings: Settings) -> None:
    write_csv(quality.sample_sessions(sessions, settings.sample_rows, settings.seed), settings.path("session_sample"))
    write_csv(quality.dataset_summary(sessions), settings.path("dataset_summary"))
    write_csv(quality.session_invariants(sessions), settings.path("session_invariants"))


def run_north_star(sessions: DataFrame, settings: Settings) -> None:
    # The tree is small and feeds two sinks: written once, read back.
    write_parquet(northstar.metrics_tree(sessions), settings.path("metrics_tree"))
    tree = sessions.sparkSession.read.parquet(settings.path("metrics_tree"))
    write_json(northstar.metrics_tree_document(tree), settings.path("metrics_tree_json"))
    write_csv(northstar.north_star_report(sessions), settings.path("north_star_report"))
    write_csv(northstar.daily_cr(sessions), settings.path("daily_cr"))
    write_csv(northstar.funnel(sessions), settings.path("funnel"))


def run_diagnosis(sessions: DataFrame, settings: Settings) -> None:
    write_csv(diagnosis.diagnosis_report(sessions, alpha=settings.alpha, **settings.drop), settings.path("diagnosis_report"))
    write_csv(diagnosis.slice_all_dims(sessions, **settings.drop), settings.path("slices"))
    write_csv(diagnosis.hourly_vs_prev(sessions, **settings.drop), settings.path("hourly"))
    kept = cohorts.cohort_retention(sessions, settings.cohort_size, settings.cohort_rows)
    write_csv(kept, settings.path("cohort_retention"))


def run_launch(sessions: DataFrame, settings: Settings) -> None:
    write_csv(launch.launch_report(sessions, alpha=settings.alpha, **settings.launch), settings.path("launch_report"))
    write_csv(launch.launch_primary(sessions, alpha=settings.alpha, **settings.launch), settings.path("launch_primary"))
    write_csv(launch.launch_guardrails(sessions, alpha=settings.alpha, **settings.launch), settings.path("launch_guardrails"))
    write_csv(launch.launch_side_effects(sessions, **settings.launch), settings.path("launch_side_effects"))


def run_anomaly(sessions: DataFrame, settings: Settings) -> None:
    # Four feeds share the daily table: one pass over the sessions, then day rows.
    write_parquet(anomaly.daily_kpis(sessions, z_threshold=settings.z_threshold), settings.path("daily_kpis"))
    kpis = sessions.sparkSession.read.parquet(settings.path("daily_kpis"))
    write_csv(kpis.orderBy("date"), settings.path("daily_kpis_csv"))
    write_csv(anomaly.events_of(kpis).orderBy("date"), settings.path("anomaly_events"))
    tracker = anomaly.tracker_of(kpis, settings.launch_date, settings.half_window)
    write_csv(tracker.orderBy("date"), settings.path("feature_launch_tracker"))
    write_csv(anomaly.digest_of(kpis), settings.path("weekly_digest"))
    health = anomaly.driver_health(sessions, settings.category)
    write_json(anomaly.driver_health_document(health), settings.path("driver_health"))


def run_segments(sessions: DataFrame, settings: Settings) -> None:
    labelled, model = segments.labelled_users(
        sessions, settings.segments, settings.seed, settings.starts, settings.max_users
    )
    # Labelled once and written: profile, names and export read user rows only.
    write_parquet(labelled, settings.path("labelled_users"))
    labelled = sessions.sparkSession.read.parquet(settings.path("labelled_users"))
    write_csv(segments.fitted_profile(labelled, model).orderBy("segment_id"), settings.path("segment_profiles"))
    write_csv(segments.name_users(labelled), settings.path("user_segments"))


MODULES: dict[int, Callable[[DataFrame, Settings], None]] = {
    0: run_dataset,
    1: run_north_star,
    2: run_diagnosis,
    3: run_launch,
    4: run_anomaly,
    5: run_segments,
}


def run(sessions: DataFrame, settings: Settings, module: int | None = None) -> list[str]:
    """Run one module, or all in order; returns the names of those that ran."""
    ship_package(sessions.sparkSession)
    register_sessions(sessions)
    chosen = MODULES if module is None else {module: MODULES[module]}
    for step in chosen.values():
        step(sessions, settings)
    return [step.__name__ for step in chosen.values()]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Session analytics on Spark")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--input", help="Parquet folder of the session table")
    source.add_argument("--events", help="folder with events.parquet to read as sessions")
    parser.add_argument("--output", required=True)
    parser.add_argument("--module", type=int, choices=sorted(MODULES))
    options = [field for field in fields(Settings) if field.name != "output"]
    for field in options:
        kind = int if field.name == "max_users" else type(field.default)
        parser.add_argument(f"--{field.name.replace('_', '-')}", type=kind, default=field.default)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("sessionscope").getOrCreate()
    sessions = read_sessions(spark, args.input) if args.input else load_sessions(spark, args.events)
    settings = Settings(args.output, **{field.name: getattr(args, field.name) for field in options})
    for name in run(sessions, settings, args.module):
        print(name)


if __name__ == "__main__":
    main()
