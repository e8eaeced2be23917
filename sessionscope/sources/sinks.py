"""Writers for session tables, feeds and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sessions(sessions: DataFrame, path: str, files: int | None = None) -> None:
    """Parquet by day.

    Rows are range-partitioned by time and id, so a day or a moment that holds
    a large share of the rows spreads over several files instead of ending in
    one task, and every file covers a narrow time range that the reader can skip.
    """
    keys = ["date", "timestamp", "session_id"]
    ranged = sessions.repartitionByRange(files, *keys) if files else sessions.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("date").parquet(path)


def write_sessions_by_user(sessions: DataFrame, table: str, buckets: int = 200, max_share: float = 0.05) -> None:
    """A catalog table bucketed and sorted by user, beside the day layout.

    User-level operators over it need no shuffle by user.  A user is one bucket, so the table refuses users
    who hold more than ``max_share`` of all rows: for those the shuffled form spreads better.
    """
    users = sessions.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count("*").alias("n"))
    most, total = users.agg(F.max("n"), F.sum("n")).first()
    if total and most > max(max_share * total, 1):
        raise ValueError(f"One user holds {most} of {total} sessions: more than {max_share:.0%} in one bucket.")
    dealt = sessions.repartition(buckets, "user_id")
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, "user_id").sortBy("user_id").saveAsTable(table)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
