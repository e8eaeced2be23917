"""Small hand-made session tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.functions.calendar import calendar_sql
from sessionscope.schema import SESSION_SCHEMA

DEFAULTS = {
    "user_id": "U1",
    "timestamp": datetime(2024, 1, 1, 12),
    "device": "mobile",
    "location": "CITY_1",
    "traffic_source": "organic_search",
    "product_category": "CAT_1",
    "steps_completed": 5,
    "converted": 0,
    "revenue": 0.0,
    "page_load_ms": 1000.0,
    "bounced": 0,
}


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def sessions_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """One session per dict; missing columns take a default, the calendar is derived."""
    stored = [f for f in SESSION_SCHEMA.fields if f.name not in ("date", "week", "month", "hour")]
    schema = type(SESSION_SCHEMA)(stored)
    full = [
        {"session_id": f"S{i:08d}", **DEFAULTS, **row} for i, row in enumerate(rows, start=1)
    ]
    data = [tuple(row[f.name] for f in stored) for row in full]
    df = spark.createDataFrame(data, schema)
    return df.selectExpr("*", *[f"{text} AS {name}" for name, text in calendar_sql("timestamp").items()])


def sessions_per_day(spark: SparkSession, days: list[tuple]) -> DataFrame:
    """Sessions that add up to ``(date, sessions, conversions, revenue)`` per day."""
    totals = spark.createDataFrame(days, "day string, n int, c int, total double")
    one = totals.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    converted = F.when(F.col("i") <= F.col("c"), 1).otherwise(0)
    return one.select(
        F.concat("day", F.lit("-"), F.col("i").cast("string")).alias("session_id"),
        F.concat(F.lit("U"), F.col("i").cast("string")).alias("user_id"),
        F.to_timestamp_ntz(F.concat("day", F.lit(" 10:00:00"))).alias("timestamp"),
        F.lit("mobile").alias("device"),
        F.lit("CITY_1").alias("location"),
        F.lit("direct").alias("traffic_source"),
        F.lit("CAT_1").alias("product_category"),
        F.lit(5).alias("steps_completed"),
        converted.alias("converted"),
        F.when(converted == 1, F.col("total") / F.col("c")).otherwise(0.0).alias("revenue"),
        F.lit(1500.0).alias("page_load_ms"),
        F.lit(0).alias("bounced"),
        F.to_date("day").alias("date"),
        F.lit(10).alias("hour"),
    )
