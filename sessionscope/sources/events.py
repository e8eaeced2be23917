"""Sessions out of a generic event log: one event is one session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionscope.functions.calendar import calendar_sql
from sessionscope.sources.sessions import read_parquet

EVENT_SCHEMA = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"

# Two numbers that several columns need, parsed once per row.
HELPERS = {
    "device_band": "CAST(get_json_object(props, '$.k') AS INT)",
    "source_band": "(event_id * 37) % 100",
}


def _padded(number: str, digits: int) -> str:
    """At least ``digits`` digits; longer numbers keep all of theirs."""
    text = f"CAST({number} AS STRING)"
    return f"repeat('0', greatest({digits} - length({text}), 0)), {text}"


# The session columns in terms of the event columns and the helpers.
SESSION_COLUMNS = {
    "session_id": "concat('S', " + _padded("event_id", 8) + ")",
    "user_id": "concat('U', " + _padded("user_id * 40 + event_id % 40", 7) + ")",
    "timestamp": "ts",
    "device": "CASE WHEN device_band < 62 THEN 'mobile' WHEN device_band < 92 THEN 'desktop' ELSE 'tablet' END",
    "location": "concat('CITY_', CAST(user_id % 10 AS STRING))",
    "traffic_source": """CASE WHEN source_band < 30 THEN 'organic_search'
                              WHEN source_band < 52 THEN 'paid_search'
                              WHEN source_band < 70 THEN 'social'
                              WHEN source_band < 82 THEN 'email'
                              WHEN source_band < 92 THEN 'direct'
                              ELSE 'referral' END""",
    "product_category": "concat('CAT_', CAST((event_id * 7 + user_id) % 6 AS STRING))",
    "steps_completed": """CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3
                                          WHEN 'error' THEN 4 WHEN 'purchase' THEN 5 END""",
    "converted": "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END",
    "revenue": "CASE WHEN event_type = 'purchase' THEN value ELSE 0D END",
    "page_load_ms": "400 + 30 * value",
    "bounced": "CASE WHEN event_type = 'view' THEN 1 ELSE 0 END",
    **calendar_sql("ts"),
}


def sessions_from_events(events: DataFrame) -> DataFrame:
    """A pure projection: the columns a query does not use are never computed."""
    helped = events.selectExpr("*", *[f"{text} AS {name}" for name, text in HELPERS.items()])
    return helped.selectExpr(*[f"{text} AS {name}" for name, text in SESSION_COLUMNS.items()])


def load_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_from_events(read_parquet(spark, f"{sf_dir}/events.parquet", EVENT_SCHEMA))
