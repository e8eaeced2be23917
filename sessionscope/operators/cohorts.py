"""First-seen cohorts of users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.rates import count_if, pct, ratio


def cohort_retention(sessions: DataFrame, min_size: int = 50, limit: int = 30) -> DataFrame:
    """Users per first day and how many of them came back on any later day.

    First and last day per user answer the question without joining the
    sessions to themselves: one shuffle of a small row per user.
    """
    per_user = (
        sessions.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.min("date").alias("first"), F.max("date").alias("last"))
    )
    cohorts = per_user.groupBy(F.col("first").alias("cohort_date")).agg(
        F.count("*").alias("cohort_size"),
        count_if(F.col("last") > F.col("first")).alias("returned_users"),
    )
    return (
        cohorts.where(F.col("cohort_size") >= min_size)
        .withColumn(
            "retention_rate_pct", pct(ratio(F.col("returned_users"), F.col("cohort_size")), 2)
        )
        .orderBy("cohort_date")
        .limit(limit)
    )


def cohort_days_since_first(sessions: DataFrame, heavy_share: float | None = 0.001) -> DataFrame:
    """Every session with its user's first day and the days since then.

    Users who own more than ``heavy_share`` of all rows number less than
    ``1 / heavy_share``.  That bound makes them safe to broadcast; their
    sessions get the first day in place and travel on under a key of their own
    session, so a dominant user spreads evenly.  Everybody else joins by user.
    Both user lists read the same aggregation, whose exchange is reused.

    ``None`` joins everybody by user: right for a table stored by user, where rows
    and first days already lie together.
    """
    known = sessions.where(F.col("user_id").isNotNull())
    if heavy_share is None:
        days = known.groupBy("user_id").agg(F.min("date").alias("first_date"))
        return _dated(known.join(days, "user_id"))
    if heavy_share < 1e-4:
        raise ValueError("heavy_share below 1e-4 would broadcast more than 10,000 users")
    total = known.agg(F.count("*").alias("_total"))
    first = (
        known.groupBy("user_id")
        .agg(F.min("date").alias("first_date"), F.count("*").alias("_n"))
        .crossJoin(F.broadcast(total))
    )
    is_heavy = F.col("_n") > F.col("_total") * F.lit(heavy_share)
    heavy = first.where(is_heavy).select("user_id", F.col("first_date").alias("_heavy_first"))
    light = first.where(~is_heavy).select(F.col("user_id").alias("_key"), "first_date")
    in_place = F.col("_heavy_first").isNotNull()
    keyed = known.join(F.broadcast(heavy), "user_id", "left").withColumn(
        "_key", F.when(in_place, F.concat(F.lit("~"), F.coalesce("session_id", F.rand(1).cast("string")))).otherwise(F.col("user_id"))
    )
    dated = keyed.join(light, "_key", "left").withColumn(
        "first_date", F.coalesce("_heavy_first", "first_date")
    )
    return _dated(dated)


def _dated(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "session_id",
        "user_id",
        "first_date",
        F.col("date").alias("session_date"),
        F.datediff("date", "first_date").alias("days_since_first"),
    )
