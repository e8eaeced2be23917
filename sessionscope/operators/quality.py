"""Calendar enrichment, sampling, summary and row invariants of the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.functions.calendar import calendar_sql
from sessionscope.functions.rates import count_if, pct, ratio
from sessionscope.functions.rows import stack_rows


def session_calendar(sessions: DataFrame) -> DataFrame:
    """Day, week label, month label and hour of every session."""
    calendar = [f"{text} AS {name}" for name, text in calendar_sql("timestamp").items()]
    return sessions.selectExpr("session_id", "timestamp", *calendar)


def dataset_summary(sessions: DataFrame, load_dp: int = 0) -> DataFrame:
    """One row of totals, users counted exactly.

    One scan: sessions collapse to a small row per user, and totals and the number of users
    are sums over these rows.
    """
    per_user = sessions.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        F.sum("converted").alias("c"),
        F.count("converted").alias("n_c"),
        F.sum("revenue").alias("revenue"),
        F.sum("page_load_ms").alias("load"),
        F.count("page_load_ms").alias("n_load"),
    )
    return per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_sessions"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        pct(ratio(F.sum("c"), F.sum("n_c")), 2).alias("overall_cr_pct"),
        F.round(F.sum("revenue"), 2).alias("total_revenue"),
        F.round(ratio(F.sum("load"), F.sum("n_load")), load_dp).alias("avg_page_load_ms"),
        F.count("user_id").alias("unique_users"),
    )


def session_invariants(sessions: DataFrame) -> DataFrame:
    """Rows that break each rule of the fact table, counted in one pass."""
    # The rules every session obeys.
    rules = {
        "bounced_iff_first_step": (F.col("bounced") == 1) != (F.col("steps_completed") == 1),
        "revenue_only_if_converted": (F.col("converted") != 1) & (F.col("revenue") != 0),
        "converted_only_from_step_4": (F.col("converted") == 1) & (F.col("steps_completed") < 4),
        "page_load_positive": F.col("page_load_ms") <= 0,
        "steps_between_1_and_5": ~F.col("steps_completed").between(1, 5),
    }
    counts = sessions.agg(
        F.count("*").alias("checked"), *[count_if(broken).alias(name) for name, broken in rules.items()]
    )
    rows = [(name, F.col(name), F.col("checked")) for name in rules]
    return stack_rows(counts, ["rule", "violations", "rows_checked"], rows)


def _draw(seed: int, id_column: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column)))


def _magnitude(digest: Column) -> Column:
    """Leading zeros and the first other hex digit: labels that sort like the digests."""
    return F.substring(digest, F.lit(1), 33 - F.length(F.ltrim(digest, F.lit("0"))))


def sample_cut(ids: DataFrame, n: int, id_column: str, seed: int = 42) -> DataFrame:
    """One row: the smallest bound on the digest that at least ``n`` ids stay within.

    Each label is about as wide as everything below it or narrower, so the
    bound keeps about ``2 n`` ids at most.  There are under 500 labels, however
    many ids there are.
    """
    histogram = (
        ids.select(_magnitude(_draw(seed, id_column)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    )
    running = F.sum("n").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0))
    enough = histogram.select("label", running.alias("within")).where(F.col("within") >= n)
    # "g" sorts behind every hex digit, so the bound closes the label.
    return enough.agg(F.concat(F.coalesce(F.min("label"), F.lit("")), F.lit("g")).alias("cut"))


def within_cut(df: DataFrame, cut: DataFrame, id_column: str, seed: int = 42) -> DataFrame:
    """The rows whose id passes the cut; ``cut`` is a single row, so it is broadcast."""
    return (
        df.crossJoin(F.broadcast(cut)).where(_draw(seed, id_column) < F.col("cut")).drop("cut")
    )


def first_drawn(df: DataFrame, n: int, id_column: str, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest draws."""
    return df.orderBy(_draw(seed, id_column), id_column).limit(n)


def sample_sessions(
    sessions: DataFrame, n: int = 100_000, seed: int = 42, id_column: str = "session_id"
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones for any partitioning.

    Rows are ordered by a seeded digest of their id.  A first pass over the id
    alone finds the cut that keeps between ``n`` and about ``2 n`` rows, so the
    final ordering never sees more than that, whatever the table holds.  A null
    id has no draw: the job fails and says so.
    """
    missing = F.raise_error(F.lit(f"a sampled row has no {id_column}"))
    named = sessions.withColumn(id_column, F.coalesce(F.col(id_column), missing.cast(sessions.schema[id_column].dataType)))
    cut = sample_cut(named, n, id_column, seed)
    return first_drawn(within_cut(named, cut, id_column, seed), n, id_column, seed)
