"""What a dashboard reads: joins, profiles, top lists, load bands, snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions.columns import truncated_mean

# Published sensor positions (id, latitude, longitude, name).
SENSOR_LOCATIONS = [
    (1, -37.81340, 144.96520, "Bourke St Mall (North)"),
    (2, -37.81357, 144.96506, "Bourke St Mall (South)"),
    (3, -37.81101, 144.96429, "Melbourne Central"),
    (4, -37.81496, 144.96660, "Town Hall (West)"),
    (5, -37.81874, 144.96787, "Princes Bridge"),
    (6, -37.81800, 144.96700, "Flinders Street Station"),
    (9, -37.81830, 144.95270, "Southern Cross"),
    (13, -37.81120, 144.95560, "Flagstaff"),
    (15, -37.80970, 144.96470, "State Library"),
    (18, -37.81430, 144.97260, "Collins Place"),
    (23, -37.81870, 144.95430, "Spencer-Collins"),
    (27, -37.80690, 144.95770, "QV Market"),
    (30, -37.81000, 144.97260, "Lonsdale-Spring"),
    (34, -37.81560, 144.97370, "Flinders-Spring"),
    (47, -37.81150, 144.96650, "Chinatown-Swanston"),
]

DAY_TYPES = ["weekday", "weekend"]
ACTUAL_HOURS = range(9, 16)
OUTLOOK_HOURS = range(15, 22)


def sensor_locations(spark: SparkSession, entries: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(
        entries or SENSOR_LOCATIONS, "location_id int, lat double, lon double, name string"
    )


# --- facts with their sensor --------------------------------------------------


def facts_of_current_sensors(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Facts whose sensor version is current, with its location."""
    sensors = dim.filter("is_current").select("sensor_key", "location_id")
    return fact.join(sensors, "sensor_key", "inner").select(
        "sensor_key",
        "location_id",
        "date_key",
        "event_hour",
        "is_weekend",
        "day_of_week",
        "pedestrian_count",
    )


def facts_with_current_sensor(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Every fact, with a location only where its sensor version is current."""
    sensors = dim.filter("is_current").select("sensor_key", "location_id")
    return fact.join(sensors, "sensor_key", "left").select(
        "sensor_key", "location_id", "event_hour", "is_weekend", "pedestrian_count"
    )


def located(facts: DataFrame, locations: DataFrame) -> DataFrame:
    """Rows of known sensors with name and position."""
    return facts.join(locations, "location_id", "inner")


# --- aggregates ----------------------------------------------------------------


def headline_metrics(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count("pedestrian_count").alias("total_readings"),
        F.countDistinct("sensor_key").alias("distinct_sensors"),
        # As one struct, so that a pair with a NULL in it still counts.
        F.countDistinct(F.struct("date_key", "event_hour")).alias("distinct_hours"),
        F.max("pedestrian_count").alias("peak_count"),
    )


def busiest_sensors(facts: DataFrame, top_n: int = 10) -> DataFrame:
    return (
        facts.filter(F.col("sensor_key").isNotNull())
        .groupBy("sensor_key")
        .agg(F.coalesce(F.sum("pedestrian_count"), F.lit(0)).alias("total_pedestrians"))
        .orderBy(F.desc("total_pedestrians"), "sensor_key")
        .limit(top_n)
    )


def average_by_hour(facts: DataFrame) -> DataFrame:
    return (
        facts.filter(F.col("event_hour").isNotNull())
        .groupBy("event_hour")
        .agg(F.avg("pedestrian_count").alias("avg_count"))
        .orderBy("event_hour")
    )


def day_type() -> Column:
    return F.when(F.col("is_weekend"), "weekend").when(~F.col("is_weekend"), "weekday")


def hourly_profile(facts: DataFrame) -> DataFrame:
    """Mean by hour and day type, one row per pair that occurs."""
    return (
        facts.filter(F.col("event_hour").isNotNull() & F.col("is_weekend").isNotNull())
        .groupBy("event_hour", day_type().alias("day_type"))
        .agg(F.avg("pedestrian_count").alias("avg_count"))
        .orderBy("event_hour", "day_type")
    )


def profile_slots(spark: SparkSession) -> DataFrame:
    """All 24 hours of both day types."""
    return spark.range(24).select(
        F.col("id").cast("int").alias("event_hour"),
        F.explode(F.array(*[F.lit(d) for d in DAY_TYPES])).alias("day_type"),
    )


def dense_hourly_profile(facts: DataFrame) -> DataFrame:
    return in_all_slots(hourly_profile(facts))


def in_all_slots(profile: DataFrame) -> DataFrame:
    """A profile as whole numbers with 0 for hours nobody reported."""
    slots = profile_slots(profile.sparkSession)
    return slots.join(profile, ["event_hour", "day_type"], "left").select(
        "event_hour", "day_type", truncated_mean(F.col("avg_count")).alias("avg_count")
    )


def sensor_totals(facts: DataFrame) -> DataFrame:
    """Total per sensor and ``current``, the mean at its largest hour of day.

    Facts are reduced to at most 24 rows per sensor first, so nothing is
    ranked or joined within a busy sensor.
    """
    by_hour = (
        facts.filter(F.col("location_id").isNotNull())
        .groupBy("location_id", "event_hour")
        .agg(
            F.sum("pedestrian_count").alias("hour_total"),
            F.count("pedestrian_count").alias("hour_rows"),
        )
    )
    return totals_of_hours(by_hour)


def totals_of_hours(by_hour: DataFrame) -> DataFrame:
    """The same from a sensor's sums by hour of day."""
    last_hour = F.max_by(F.struct("hour_total", "hour_rows"), "event_hour")
    return (
        by_hour.groupBy("location_id")
        .agg(
            F.coalesce(F.sum("hour_total"), F.lit(0)).alias("total"),
            last_hour.alias("last_hour"),
        )
        .select(
            "location_id",
            "total",
            truncated_mean(
                F.try_divide("last_hour.hour_total", "last_hour.hour_rows")
            ).alias("current"),
        )
    )


def latest_hour_counts(facts: DataFrame) -> DataFrame:
    """Count at each sensor's latest hour, by date and hour."""
    return (
        facts.filter(F.col("location_id").isNotNull())
        .groupBy("location_id")
        .agg(F.max(F.struct("date_key", "event_hour", "pedestrian_count")).alias("latest"))
        .select("location_id", "latest.*")
    )


def snapshot_meta(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count("pedestrian_count").alias("total_readings"),
        F.count("*").alias("gold_facts"),
        F.countDistinct("sensor_key").alias("sensor_versions"),
    )


def with_load(sensors: DataFrame, value: str = "current") -> DataFrame:
    """Share of the largest value and its band; no share where all are 0.

    The maximum is a scalar subquery: one number, not a window over all rows.
    """
    largest = sensors.agg(F.max(value)).scalar()
    load = F.when(largest > 0, F.col(value) / largest)
    band = F.when(load > 0.66, "high").when(load > 0.33, "medium").otherwise("low")
    return sensors.withColumn("load", load).withColumn("band", band)


def top_bars(sensors: DataFrame, top_n: int = 8) -> DataFrame:
    """Largest totals with each one's share of the largest, in percent."""
    top = sensors.orderBy(F.desc("total"), "location_id").limit(top_n)
    return with_load(top, "total").select(
        "location_id", "total", F.round(F.col("load") * 100, 1).alias("width_pct")
    )


# --- snapshot ------------------------------------------------------------------


def profile_outlook(dense: DataFrame) -> DataFrame:
    """Weekday profile at the hours shown as past and as coming.

    The coming hours repeat the profile; they are not model output.
    """
    shown = [("actual", h) for h in ACTUAL_HOURS] + [("predicted", h) for h in OUTLOOK_HOURS]
    series = F.explode(
        F.array(*[F.struct(F.lit(s).alias("series"), F.lit(h).alias("hour")) for s, h in shown])
    )
    weekday = dense.filter("day_type = 'weekday'").select("event_hour", "avg_count")
    return (
        dense.sparkSession.range(1)
        .select(series.alias("slot"))
        .select("slot.*", F.pmod(F.col("slot.hour"), F.lit(24)).alias("event_hour"))
        .join(weekday, "event_hour", "left")
        .select("series", "hour", F.coalesce("avg_count", F.lit(0)).alias("avg_count"))
    )


def fact_summary(facts: DataFrame) -> DataFrame:
    """Sums by sensor, hour of day and day type, at most 72 rows a sensor: all
    that a snapshot needs to know of the facts, in one pass over them."""
    return facts.groupBy("sensor_key", "location_id", "event_hour", "is_weekend").agg(
        F.sum("pedestrian_count").alias("total"),
        F.count("pedestrian_count").alias("readings"),
        F.count("*").alias("facts"),
    )


def snapshot(facts: DataFrame, locations: DataFrame) -> DataFrame:
    return snapshot_of_summary(fact_summary(facts), locations)


def snapshot_of_summary(summary: DataFrame, locations: DataFrame) -> DataFrame:
    """One nested row with everything the page shows.

    Its lists are cut from the summary, which callers store first. Only bounded
    lists are collected: the located sensors, 48 profile slots and 14 outlook
    slots.
    """
    by_hour = (
        summary.filter(F.col("location_id").isNotNull())
        .groupBy("location_id", "event_hour")
        .agg(F.sum("total").alias("hour_total"), F.sum("readings").alias("hour_rows"))
    )
    profile = (
        summary.filter(F.col("event_hour").isNotNull() & F.col("is_weekend").isNotNull())
        .groupBy("event_hour", day_type().alias("day_type"))
        .agg(F.try_divide(F.sum("total"), F.sum("readings")).alias("avg_count"))
    )
    meta = summary.agg(
        F.coalesce(F.sum("readings"), F.lit(0)).alias("total_readings"),
        F.coalesce(F.sum("facts"), F.lit(0)).alias("gold_facts"),
        F.countDistinct("sensor_key").alias("sensor_versions"),
    )

    def ordered(frame: DataFrame, order: list[str], *fields: str) -> DataFrame:
        entry = F.struct(*order, *[f for f in fields if f not in order])
        return frame.agg(F.sort_array(F.collect_list(entry)).alias("entries"))

    sensors = located(totals_of_hours(by_hour), locations)
    dense = in_all_slots(profile)
    outlook = profile_outlook(dense)

    sensor_list = ordered(sensors, ["location_id"], "name", "lat", "lon", "total", "current")
    profiles = {
        d: ordered(dense.filter(F.col("day_type") == d), ["event_hour"], "avg_count")
        for d in DAY_TYPES
    }
    outlooks = {
        s: ordered(outlook.filter(F.col("series") == s), ["hour"], "avg_count")
        for s in ("actual", "predicted")
    }

    lists = {"sensor_list": sensor_list, **profiles, **outlooks}
    collected = meta.select(
        "*", *[frame.scalar().alias(name) for name, frame in lists.items()]
    )

    def counts(name: str) -> Column:
        return F.transform(name, lambda e: e["avg_count"]).alias(name)

    def as_entry(e: Column) -> Column:
        rest = [e[c].alias(c) for c in ("name", "lat", "lon", "total", "current")]
        return F.struct(e["location_id"].alias("id"), *rest)

    return collected.select(
        F.transform("sensor_list", as_entry).alias("sensors"),
        F.struct(*[counts(d) for d in DAY_TYPES]).alias("hourly"),
        F.struct(
            F.lit(ACTUAL_HOURS[-1]).alias("from_hour"), counts("actual"), counts("predicted")
        ).alias("forecast"),
        F.struct("total_readings", "gold_facts", "sensor_versions").alias("meta"),
    )
