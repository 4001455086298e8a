"""Star schema: date and sensor dimensions, hourly fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.columns import iso_weekday, key_text, surrogate_key

HOURLY_GRAIN = ["location_id", "event_date", "event_hour", "is_weekend", "day_of_week"]


def staging_view(silver: DataFrame) -> DataFrame:
    """Silver under its downstream names."""
    return silver.withColumnRenamed("total_of_directions", "pedestrian_count")


def hourly_counts(stg: DataFrame) -> DataFrame:
    """Readings summed per sensor and local hour.

    ``first_reading_ts`` and ``last_reading_ts`` ride along so that both
    dimensions can be built from this frame, a sixtieth of the readings,
    without another pass over Silver.
    """
    return stg.groupBy(*HOURLY_GRAIN).agg(
        F.sum("pedestrian_count").alias("pedestrian_count"),
        F.sum("direction_1").alias("count_direction_1"),
        F.sum("direction_2").alias("count_direction_2"),
        F.count("*").alias("minutes_reported"),
        F.round(F.count("*") / F.lit(60.0), 3).alias("reading_completeness"),
        F.min("event_ts_utc").alias("first_reading_ts"),
        F.max("event_ts_utc").alias("last_reading_ts"),
    )


def observed_dates(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("event_date").cast("date").alias("date_day")).distinct()


def dim_date(frame: DataFrame) -> DataFrame:
    """Calendar attributes of the dates present, Monday counted as 1.

    Takes the staging view or the hourly counts.
    """
    weekday = iso_weekday("date_day")
    return observed_dates(frame).select(
        "date_day",
        F.year("date_day").alias("year"),
        F.month("date_day").alias("month"),
        F.dayofmonth("date_day").alias("day_of_month"),
        weekday.alias("day_of_week"),
        weekday.isin(6, 7).alias("is_weekend"),
    )


def observe_sensors(stg: DataFrame) -> DataFrame:
    """First and last reading and their number, per sensor."""
    return stg.groupBy("location_id").agg(
        F.min("event_ts_utc").alias("first_seen"),
        F.max("event_ts_utc").alias("last_seen"),
        F.count("*").alias("reading_count"),
    )


def observe_sensors_hourly(hourly: DataFrame) -> DataFrame:
    """The same from hourly counts."""
    return hourly.groupBy("location_id").agg(
        F.min("first_reading_ts").alias("first_seen"),
        F.max("last_reading_ts").alias("last_seen"),
        F.sum("minutes_reported").alias("reading_count"),
    )


def dim_sensor(observed: DataFrame) -> DataFrame:
    """One open version per observed sensor.

    The key hashes sensor and first reading, so a backfill of earlier readings
    changes it.
    """
    return observed.select(
        surrogate_key(key_text("location_id"), key_text("first_seen", timestamp=True)).alias(
            "sensor_key"
        ),
        "location_id",
        F.col("first_seen").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"),
        F.lit(True).alias("is_current"),
        "last_seen",
        "reading_count",
    )


def current_sensors(dim: DataFrame) -> DataFrame:
    return dim.filter("is_current").select("sensor_key", "location_id")


def fact_hourly(hourly: DataFrame, dim: DataFrame) -> DataFrame:
    """Hourly counts with the key of each sensor's current version.

    No broadcast hint: the planner broadcasts the dimension when its measured
    size allows, and otherwise joins by shuffle with skew handling.
    """
    date_key = F.col("event_date").cast("date")
    return hourly.join(current_sensors(dim), "location_id", "left").select(
        surrogate_key(
            key_text("location_id"), key_text("event_date"), key_text("event_hour")
        ).alias("footfall_key"),
        "sensor_key",
        date_key.alias("date_key"),
        "event_hour",
        "is_weekend",
        "day_of_week",
        "pedestrian_count",
        "count_direction_1",
        "count_direction_2",
        "minutes_reported",
        "reading_completeness",
    )


def star_schema_from_hourly(hourly: DataFrame) -> dict[str, DataFrame]:
    sensors = dim_sensor(observe_sensors_hourly(hourly))
    return {
        "dim_date": dim_date(hourly),
        "dim_sensor": sensors,
        "fact_footfall_hourly": fact_hourly(hourly, sensors),
    }


def star_schema(stg: DataFrame) -> dict[str, DataFrame]:
    """All three tables from one aggregation of the staging view."""
    return star_schema_from_hourly(hourly_counts(stg))
