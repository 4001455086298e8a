"""High-water-mark increments and current state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.columns import iso_timestamp, natural_key
from kerbside.schemas import READING_FIELDS

EPOCH = datetime(1970, 1, 1)


def with_event_time(readings: DataFrame, strict: bool = False) -> DataFrame:
    return readings.withColumn("event_ts_utc", iso_timestamp("sensing_datetime", strict))


def filter_new(readings: DataFrame, mark: Column | datetime) -> DataFrame:
    """Readings strictly after the mark. One whose time cannot be read is kept,
    for the quarantine to record."""
    mark = mark if isinstance(mark, Column) else F.lit(mark)
    ts = F.col("event_ts_utc")
    return readings.filter(ts.isNull() | (ts > mark))


def reading_id() -> Column:
    """What a reading says, in short: how one without a readable time is known."""
    return F.md5(F.to_json(F.struct(*READING_FIELDS), {"ignoreNullFields": "false"}))


def with_position(readings: DataFrame) -> DataFrame:
    """Adds where a reading stands in the order polls go by: its event time in
    microseconds, NULL if unreadable, and its natural key, or else its id."""
    key = F.coalesce(natural_key("location_id", "sensing_datetime"), F.lit(""))
    return with_event_time(readings).withColumns(
        {
            "at": F.unix_micros("event_ts_utc"),
            "key": F.when(F.col("event_ts_utc").isNull(), reading_id()).otherwise(key),
        }
    )


def is_after(at: int, key: str | None) -> Column:
    """Does a position lie beyond a cursor? One without key has passed all keys
    of its time; unreadable times are never passed by it."""
    beyond = F.col("at") > at
    if key is not None:
        beyond = beyond | ((F.col("at") == at) & (F.col("key") > key))
    return F.col("at").isNull() | beyond


def page_end(positions: DataFrame, size: int) -> tuple[int | None, str] | None:
    """Position of the last of the first ``size`` readings, unreadable ones first;
    None if there are no more than that. Every task keeps so many at most."""
    first = positions.select("at", "key").orderBy(F.col("at").asc_nulls_first(), "key")
    last = first.limit(size + 1).agg(
        F.count("*").alias("n"),
        F.slice(F.sort_array(F.collect_list(F.struct("at", "key"))), size, 1).alias("last"),
    ).first()
    return tuple(last["last"][0]) if last["n"] > size else None


def is_up_to(at: int | None, key: str) -> Column:
    """Does a position lie before the end of a page, or at it? Copies that share
    the position of the last reading are on its page."""
    unreadable = F.col("at").isNull()
    if at is None:
        return unreadable & (F.col("key") <= key)
    return unreadable | (F.col("at") < at) | ((F.col("at") == at) & (F.col("key") <= key))


def newest_event(readings: DataFrame) -> DataFrame:
    return readings.agg(F.max("event_ts_utc").alias("last_event_ts"))


def current_state(silver: DataFrame, key: str = "location_id") -> DataFrame:
    """Each sensor's latest reading; every task first keeps one row per sensor."""
    fields = [c for c in silver.columns if c not in (key, "event_ts_utc", "ingested_ts_utc")]
    order = ["event_ts_utc", "ingested_ts_utc"]
    latest = F.max(F.struct(*order, *fields)).alias("latest")
    return (
        silver.groupBy(key).agg(latest).select(key, "latest.*").select(*silver.columns)
    )


def rolling_counts(
    silver: DataFrame, length: str = "1 hour", slide: str | None = "5 minutes"
) -> DataFrame:
    """Sums per sensor over sliding or tumbling windows; batch and stream."""
    window = F.window("event_ts_utc", length, slide) if slide else F.window("event_ts_utc", length)
    return (
        silver.groupBy(window.alias("span"), "location_id")
        .agg(
            F.sum("total_of_directions").alias("pedestrians"),
            F.count("*").alias("minutes_reported"),
        )
        .select(
            "location_id",
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "pedestrians",
            "minutes_reported",
        )
    )
