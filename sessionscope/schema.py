"""The session fact table and the default parameters of the analyses."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per session. `date`, `week`, `month` and `hour` derive from `timestamp`.
SESSION_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("device", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("traffic_source", T.StringType()),
        T.StructField("product_category", T.StringType()),
        T.StructField("steps_completed", T.IntegerType()),
        T.StructField("converted", T.IntegerType()),
        T.StructField("revenue", T.DoubleType()),
        T.StructField("page_load_ms", T.DoubleType()),
        T.StructField("bounced", T.IntegerType()),
        T.StructField("date", T.DateType()),
        T.StructField("week", T.StringType()),
        T.StructField("month", T.StringType()),
        T.StructField("hour", T.IntegerType()),
    ]
)

CALENDAR_COLUMNS = ("date", "week", "month", "hour")

# The defaults every analysis uses unless told otherwise.
DROP_DATE = "2024-04-10"
DROP_DAYS = 3
LAUNCH_DATE = "2024-05-01"
BASELINE_DAYS = 7
LAUNCH_WINDOW_DAYS = 30
TRACKER_HALF_WINDOW = 21
ROLLING_WINDOW = 7
Z_THRESHOLD = 2.0
ALPHA = 0.05
Z_95 = 1.96
DEVICES = ("mobile", "desktop", "tablet")
SLICE_DIMENSIONS = ("device", "location", "product_category", "traffic_source")

# The thresholds behind the health marks.
MAX_LOAD_MS = 2500.0
MAX_BOUNCE_RATE = 0.40
MAX_MOBILE_GAP = 0.01
MIN_REVENUE_PER_SESSION = 40.0
MIN_ORGANIC_SHARE_PCT = 25.0
MIN_CONVERSION_RATE = 0.03
