"""Bronze readings, pages and sensor attributes derived from an ``events`` table.

The given tables hold no sensor data, so the event log stands in for one: a
user is a sensor, an event is one minute's report. Some rows are damaged on
purpose (missing location, bad timestamp, null counts, wrong total) and every
tenth event is sent a second time an hour later, so that the cleaning steps
have something to do. No event is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions.columns import local_time
from kerbside.schemas import BRONZE_SCHEMA, READING_FIELDS


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _minute_text(ts) -> F.Column:
    return F.concat(
        F.date_format(F.date_trunc("minute", ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")
    )


def bronze_from_events(events: DataFrame) -> DataFrame:
    """Bronze rows in one pass; a re-sent event is exploded, not re-read."""
    ts = F.col("ts").cast("timestamp")
    # An unreadable timestamp for some rows; the natural key keeps that text.
    sensing = F.when(F.col("event_id") % 97 == 0, F.lit("not-a-timestamp")).otherwise(
        _minute_text(ts)
    )
    copies = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    whole_value = F.floor("value").cast("int")
    return (
        events.withColumn("copy", F.explode(copies))
        .select(
            F.when(F.col("event_id") % 101 != 0, F.col("user_id").cast("int")).alias("location_id"),
            sensing.alias("sensing_datetime"),
            F.date_format(local_time(ts), "yyyy-MM-dd").alias("sensing_date"),
            F.date_format(local_time(ts), "HH:mm").alias("sensing_time"),
            (F.when(F.col("event_type") != "error", whole_value) + F.col("copy")).alias(
                "direction_1"
            ),
            F.when(
                F.col("event_type") != "signup", F.get_json_object("props", "$.k").cast("int")
            ).alias("direction_2"),
            whole_value.alias("total_of_directions"),
            F.concat(F.col("user_id").cast("string"), F.lit("#"), sensing).alias("dedupe_key"),
            F.concat(
                F.date_format(
                    F.timestamp_add("HOUR", F.col("copy"), ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
                ),
                F.lit("+00:00"),
            ).alias("ingested_at"),
        )
        .select(*BRONZE_SCHEMA.fieldNames())
    )


def with_arrival(bronze: DataFrame) -> DataFrame:
    """Adds the arrival partitions ``dt`` and ``hour`` the landing job gives."""
    return bronze.withColumns(
        {
            "dt": F.substring("ingested_at", 1, 10),
            "hour": F.substring("ingested_at", 12, 2),
        }
    )


def pages_from_events(events: DataFrame) -> DataFrame:
    """Raw API pages, some with damaged records.

    A page holds one event's record, twice when the event is one that is sent
    again, so building the pages needs no grouping.
    """
    ts = F.col("ts").cast("timestamp")
    fields = {
        "location_id": F.when(F.col("event_id") % 101 != 0, F.col("user_id").cast("string")),
        "sensing_datetime": _minute_text(ts),
        "sensing_date": F.date_format(local_time(ts), "yyyy-MM-dd"),
        "sensing_time": F.date_format(local_time(ts), "HH:mm"),
        "direction_1": F.when(F.col("event_type") != "error", F.floor("value").cast("string")),
        "direction_2": F.when(F.col("event_type") == "signup", F.lit("")).otherwise(
            F.get_json_object("props", "$.k")
        ),
        "total_of_directions": F.when(F.col("event_id") % 89 == 0, F.lit("n/a")).otherwise(
            F.floor("value").cast("string")
        ),
    }
    record = F.map_from_arrays(
        F.array(*[F.lit(name) for name in READING_FIELDS]),
        F.array(*[fields[name] for name in READING_FIELDS]),
    )
    # Whole keys go missing from some records, not just their values.
    kept = F.when(
        F.col("event_id") % 83 == 0, F.map_filter(record, lambda k, _: k != "sensing_time")
    ).otherwise(record)
    results = F.when(F.col("event_id") % 10 == 0, F.array(kept, kept)).otherwise(F.array(kept))
    page = F.struct(F.size(results).alias("total_count"), results.alias("results"))
    return events.select(F.to_json(page).alias("payload"))


def attribute_feed(events: DataFrame) -> DataFrame:
    """Sensor attributes over time: one row per observed status."""
    return events.select(
        F.col("user_id").cast("int").alias("location_id"),
        F.col("ts").cast("timestamp").alias("observed_ts"),
        F.col("event_type").alias("status"),
    )


# JSON values a count may come as; SQL states what becomes of each.
COUNT_VALUES = [
    "5", "3.7", "-3.7", '"4"', '" +4 "', '"3.7"', "true", "false", "null", '""', "[]", "{}", "[1]",
    '"1_0"', "1e2", '"1e2"', "99999999999", '"\uff13"',
]


def pages_of_all_kinds(events: DataFrame) -> DataFrame:
    """A page an event, its first count one of every kind of JSON value in turn."""
    kinds = F.array(*[F.lit(v) for v in COUNT_VALUES])
    value = F.element_at(kinds, (F.pmod("event_id", F.lit(len(COUNT_VALUES))) + 1).cast("int"))
    payload = F.format_string(
        '{"results": [{"location_id": %s, "sensing_datetime": "%s", "sensing_date": "", '
        '"sensing_time": "", "direction_1": %s}, "no record"]}',
        F.col("event_id").cast("string"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        value,
    )
    return events.select(payload.alias("payload"))
