"""Reading and registering the session fact table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionscope.functions.calendar import calendar_sql
from sessionscope.schema import CALENDAR_COLUMNS, SESSION_SCHEMA


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet scan whose missing input is reported in plain words.

    A known ``schema`` saves the pass over the file footers.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"No session data at {path!r}: write the table first.") from error
        raise


def _as_timestamp(column: Column, source: T.DataType) -> Column:
    if isinstance(source, T.LongType):
        # Nanoseconds since the epoch (`spark.sql.legacy.parquet.nanosAsLong`).
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_add("MICROSECOND", F.floor(column / F.lit(1000)), epoch)
    return column.cast("timestamp_ntz")


def coerce_sessions(df: DataFrame) -> DataFrame:
    """``df`` with the canonical column types; calendar columns filled if absent."""
    types = {field.name: field.dataType for field in df.schema.fields}
    missing = [
        name for name in SESSION_SCHEMA.names if name not in types and name not in CALENDAR_COLUMNS
    ]
    if missing:
        raise ValueError(f"Session data lacks the columns {missing}")
    df = df.withColumn("timestamp", _as_timestamp(F.col("timestamp"), types["timestamp"]))
    derived = calendar_sql("timestamp")

    def column(field: T.StructField) -> Column:
        if field.name == "timestamp":
            value = F.col("timestamp")
        elif field.name == "date" and isinstance(types.get("date"), (T.TimestampType, T.TimestampNTZType)):
            value = F.to_date("date")
        elif field.name in types:
            same = types[field.name] == field.dataType
            value = F.col(field.name) if same else F.col(field.name).cast(field.dataType)
        else:
            value = F.expr(derived[field.name])
        return value.alias(field.name)

    return df.select([column(field) for field in SESSION_SCHEMA.fields])


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return coerce_sessions(read_parquet(spark, path))


def register_sessions(sessions: DataFrame, name: str = "sessions") -> DataFrame:
    """Make the table visible to ``spark.sql`` under ``name``."""
    sessions.createOrReplaceTempView(name)
    return sessions


def read_user_table(spark: SparkSession, table: str) -> DataFrame:
    """The table that ``write_sessions_by_user`` wrote, with its bucketing."""
    if not spark.catalog.tableExists(table):
        raise FileNotFoundError(f"No session table {table!r}: write it first.")
    return coerce_sessions(spark.table(table))
