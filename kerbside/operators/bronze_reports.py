"""Ad-hoc checks over raw readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.columns import iso_timestamp, seconds_between


def summary(bronze: DataFrame) -> DataFrame:
    return bronze.agg(
        F.count("*").alias("total_readings"),
        F.countDistinct("location_id").alias("distinct_sensors"),
        F.min("sensing_datetime").alias("earliest_event"),
        F.max("sensing_datetime").alias("latest_event"),
    )


def busiest(bronze: DataFrame, top_n: int = 10) -> DataFrame:
    """Most pedestrians by sensor; the sensor id decides between equals."""
    return (
        bronze.groupBy("location_id")
        .agg(
            F.sum("total_of_directions").alias("pedestrians"),
            F.count("*").alias("minutes_reported"),
        )
        .orderBy(F.desc_nulls_last("pedestrians"), F.asc_nulls_last("location_id"))
        .limit(top_n)
    )


def duplicates(bronze: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """Rows beyond the first of each key; rows without a key count as such."""
    distinct = F.countDistinct(key)
    return bronze.agg(
        F.count("*").alias("total_rows"),
        distinct.alias("distinct_keys"),
        (F.count("*") - distinct).alias("duplicates"),
    )


def with_lag(bronze: DataFrame) -> DataFrame:
    return bronze.withColumn(
        "lag_seconds",
        seconds_between(iso_timestamp("sensing_datetime"), iso_timestamp("ingested_at")),
    )


def latest_lag(bronze: DataFrame, top_n: int = 5) -> DataFrame:
    """The newest readings with their delay from event to ingestion."""
    return (
        with_lag(bronze)
        .select("location_id", "sensing_datetime", "ingested_at", "lag_seconds")
        .orderBy(
            F.desc("sensing_datetime"), F.asc_nulls_last("location_id"), F.asc("ingested_at")
        )
        .limit(top_n)
    )


def lag_by_sensor(bronze: DataFrame) -> DataFrame:
    return (
        with_lag(bronze)
        .groupBy("location_id")
        .agg(
            F.count("lag_seconds").alias("readings"),
            F.avg("lag_seconds").alias("avg_lag_seconds"),
            F.max("lag_seconds").alias("max_lag_seconds"),
        )
    )
