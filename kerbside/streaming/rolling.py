"""Rolling sums and current state per sensor on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbside.operators.incremental import current_state, rolling_counts
from kerbside.operators.silver import (
    clean_counts,
    fill_natural_key,
    parse_and_type,
    select_silver_columns,
    split_valid_and_quarantine,
)
from kerbside.sources import versions
from kerbside.sources.versions import PART


def typed_stream(bronze: DataFrame) -> DataFrame:
    """Valid, cleaned readings of a Bronze stream, copies not yet removed."""
    valid, _ = split_valid_and_quarantine(parse_and_type(bronze))
    return valid.transform(fill_natural_key).transform(clean_counts).transform(
        select_silver_columns
    )


def stream_rolling(
    readings: DataFrame,
    delay: str = "15 minutes",
    length: str = "1 hour",
    slide: str | None = "5 minutes",
    drop_copies: bool = True,
) -> DataFrame:
    """Rolling sums; a window is final once the watermark has passed its end.

    ``drop_copies`` removes repeats of a reading within the delay. It keeps the
    first copy, not the latest, which Silver alone can promise.
    """
    timed = readings.withWatermark("event_ts_utc", delay)
    if drop_copies:
        timed = timed.dropDuplicatesWithinWatermark(["dedupe_key"])
    return rolling_counts(timed, length, slide)


WINDOWS, STATE = "windows", "state"


def window_day() -> Column:
    return F.to_date("window_start")


def stream_rolling_table(
    windows: DataFrame, root: str, checkpoint: str, once: bool = False, final: bool = False
) -> StreamingQuery:
    """Upkeep of a table of windows, in parts by the day a window begins.

    A batch replaces the windows it has changed and rewrites the parts of their
    days alone; days behind the watermark keep their files. With ``final`` only
    closed windows come, each of them once. A replayed batch changes nothing.
    """
    key = ["location_id", "window_start"]

    def combine(new: DataFrame, stored: DataFrame) -> DataFrame:
        return stored.join(new.select(*key), key, "left_anti").unionByName(new)

    def merge(batch: DataFrame, _: int) -> None:
        versions.merge(batch, root, WINDOWS, window_day(), combine)

    trigger = {"availableNow": True} if once else {"processingTime": "5 minutes"}
    return (
        windows.writeStream.outputMode("append" if final else "update")
        .foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def read_windows(spark: SparkSession, root: str) -> DataFrame:
    return versions.read(spark, root, WINDOWS).drop(PART)


def state_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("location_id"), F.lit(buckets)).cast("int")


def read_state(spark: SparkSession, root: str) -> DataFrame:
    return versions.read(spark, root, STATE).drop(PART)


def stream_state(
    readings: DataFrame, root: str, checkpoint: str, once: bool = False, buckets: int = 64
) -> StreamingQuery:
    """Upkeep of a one-row-per-sensor table of latest readings.

    The table lies in hash buckets of sensors; a batch rewrites the buckets of
    the sensors it brings news of. The number of buckets must not change later.
    """

    def combine(new: DataFrame, stored: DataFrame) -> DataFrame:
        return current_state(new.unionByName(stored))

    def merge(batch: DataFrame, _: int) -> None:
        versions.merge(current_state(batch), root, STATE, state_bucket(buckets), combine)

    trigger = {"availableNow": True} if once else {"processingTime": "60 seconds"}
    return (
        readings.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
