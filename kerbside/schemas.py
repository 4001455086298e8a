"""Fixed schemas and shared constants. Nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

LOCAL_ZONE = "Australia/Melbourne"

READING_FIELDS = [
    "location_id",
    "sensing_datetime",
    "sensing_date",
    "sensing_time",
    "direction_1",
    "direction_2",
    "total_of_directions",
]

BRONZE_SCHEMA = T.StructType(
    [
        T.StructField("location_id", T.IntegerType()),
        T.StructField("sensing_datetime", T.StringType()),
        T.StructField("sensing_date", T.StringType()),
        T.StructField("sensing_time", T.StringType()),
        T.StructField("direction_1", T.IntegerType()),
        T.StructField("direction_2", T.IntegerType()),
        T.StructField("total_of_directions", T.IntegerType()),
        T.StructField("dedupe_key", T.StringType()),
        T.StructField("ingested_at", T.StringType()),
    ]
)

# Arrival partitions are declared as strings so hour "07" is not read as 7.
ARRIVAL_FIELDS = [T.StructField("dt", T.StringType()), T.StructField("hour", T.StringType())]

CORRUPT_COLUMN = "_corrupt_record"
SOURCE_COLUMN = "source_file"

DERIVED_COLUMNS = [
    "event_ts_utc",
    "ingested_ts_utc",
    "event_ts_local",
    "event_date",
    "event_hour",
    "day_of_week",
    "is_weekend",
]

SILVER_SCHEMA = T.StructType(
    [
        T.StructField("location_id", T.IntegerType()),
        T.StructField("event_ts_utc", T.TimestampType()),
        T.StructField("event_ts_local", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("event_hour", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("is_weekend", T.BooleanType()),
        T.StructField("direction_1", T.IntegerType()),
        T.StructField("direction_2", T.IntegerType()),
        T.StructField("total_of_directions", T.IntegerType()),
        T.StructField("dedupe_key", T.StringType()),
        T.StructField("ingested_ts_utc", T.TimestampType()),
    ]
)

SILVER_COLUMNS = SILVER_SCHEMA.fieldNames()

# The lags and windows the features are named after.
LAG_HOURS = [1, 2, 3, 24]
ROLLING_WINDOWS = [3, 6]
TARGET_COLUMN = "target_next_hour"


def feature_columns() -> list[str]:
    """Model inputs in their contractual order."""
    return [
        "hour_sin",
        "hour_cos",
        "dow_sin",
        "dow_cos",
        "is_weekend",
        *[f"lag_{n}h" for n in LAG_HOURS],
        *[f"roll_mean_{w}h" for w in ROLLING_WINDOWS],
    ]
