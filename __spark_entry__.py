
from __future__ import annotations

import importlib
import sys
import uuid
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles  # noqa: E402
from kerbside.functions import columns as C  # noqa: E402
from kerbside.operators import (  # noqa: E402
    bronze_reports,
    features,
    forecast,
    gold,
    incremental,
    quality,
    scd2,
    serving,
    silver,
)
from kerbside.plans import gold as gold_plan  # noqa: E402
from kerbside.plans import poll as poll_plan  # noqa: E402
from kerbside.plans import scd2 as scd2_plan  # noqa: E402
from kerbside.plans import silver as silver_plan  # noqa: E402
from kerbside.session import ensure_checkpoint_dir, pin_utc  # noqa: E402
from kerbside.sources import bronze as bronze_source  # noqa: E402
from kerbside.sources import event_feed  # noqa: E402
from kerbside.streaming import landing, rolling  # noqa: E402
from kerbside.streaming import silver as silver_stream  # noqa: E402

SMOKE_FOLDER = "/root/testdata/sf0.001"
AS_OF_DAY = "2024-01-15"
AS_OF_TIME = "2024-01-15 12:00:00"
ARRIVAL_WINDOW = ("2024-01-10", "2024-01-12")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LANDED: dict[tuple[str, str], str] = {}
TRAINED: dict[tuple[str, str], tuple[str, str, str]] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(pin_utc(spark), folder)

    QUERIES[fn.__name__] = run
    return run


# --- shared inputs -------------------------------------------------------------


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return event_feed.read_table(spark, folder, "events")


def _bronze(spark: SparkSession, folder: str) -> DataFrame:
    return event_feed.bronze_from_events(_events(spark, folder))


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    return silver.parse_and_type(_bronze(spark, folder))


def _silver(spark: SparkSession, folder: str) -> DataFrame:
    return silver.transform(_bronze(spark, folder))[0]


def _stg(spark: SparkSession, folder: str) -> DataFrame:
    return gold.staging_view(_silver(spark, folder))


def _star(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The marts from stored hourly counts, as the publishing job builds them."""
    return gold.star_schema_from_hourly(_stored(gold.hourly_counts(_stg(spark, folder))))


def _fact(spark: SparkSession, folder: str) -> DataFrame:
    return _star(spark, folder)["fact_footfall_hourly"]


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts as the dashboard reads them: with date and location."""
    star = _star(spark, folder)
    return serving.facts_of_current_sensors(star["fact_footfall_hourly"], star["dim_sensor"])


def _feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    return features.build_features(_fact(spark, folder).select(*oracles.FACT_SLICE))


def _stored(df: DataFrame) -> DataFrame:
    """Written out and read back, for steps that go over their input repeatedly."""
    path = f"{_work_folder(df.sparkSession)}/stored"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _work_folder(spark: SparkSession) -> str:
    """A fresh folder on the shared storage the cluster names."""
    return f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


def _landed_bronze(spark: SparkSession, folder: str) -> str:
    """Bronze files as the landing job leaves them, once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in LANDED:
        root = f"{_work_folder(spark)}/bronze"
        (
            event_feed.with_arrival(_bronze(spark, folder))
            .hint("rebalance", "dt", "hour")
            .write.partitionBy("dt", "hour")
            .option("compression", "gzip")
            .json(root)
        )
        LANDED[key] = root
    return LANDED[key]


def _rebuilt_silver(spark: SparkSession, folder: str, root: str) -> str:
    silver_plan.rebuild_silver(spark, _landed_bronze(spark, folder), f"{root}/silver")
    return f"{root}/silver"


def _arrival_loads(bronze: DataFrame, loads: int = 3) -> list[tuple[str, str]]:
    """All arrival days of a table, first to last, as some successive loads."""
    first, last = bronze.agg(F.min("dt"), F.max("dt")).first()
    days = bronze_source.arrival_days(str(first), str(last))
    size = -(-len(days) // loads)
    parts = [days[at : at + size] for at in range(0, len(days), size)]
    return [(part[0], part[-1]) for part in parts]


# --- Bronze ----------------------------------------------------------------------


@query
def bronze_rows(spark, folder):
    return _bronze(spark, folder)


@query
def bronze_landed(spark, folder):
    """Written as partitioned gzip NDJSON, read back with the fixed schema."""
    return bronze_source.read_bronze(spark, _landed_bronze(spark, folder))


@query
def bronze_window(spark, folder):
    """Declared arrival days only, listed instead of discovered."""
    landed = _landed_bronze(spark, folder)
    return bronze_source.read_bronze(spark, landed, *ARRIVAL_WINDOW)


@query
def bronze_day(spark, folder):
    arrived = event_feed.with_arrival(_bronze(spark, folder))
    return bronze_source.on_arrival_day(arrived, AS_OF_DAY)


@query
def bronze_summary(spark, folder):
    return bronze_reports.summary(_bronze(spark, folder))


@query
def bronze_busiest(spark, folder):
    return bronze_reports.busiest(_bronze(spark, folder))


@query
def bronze_duplicates(spark, folder):
    return bronze_reports.duplicates(_bronze(spark, folder))


@query
def bronze_latest_lag(spark, folder):
    return bronze_reports.latest_lag(_bronze(spark, folder))


@query
def ingest_lag_stats(spark, folder):
    return bronze_reports.lag_by_sensor(_bronze(spark, folder))


@query
def page_parse(spark, folder):
    pages = event_feed.pages_from_events(_events(spark, folder))
    return bronze_source.parse_pages(pages)[0]


@query
def page_skips(spark, folder):
    pages = event_feed.pages_from_events(_events(spark, folder))
    return bronze_source.parse_pages(pages)[1]


@query
def page_coercion(spark, folder):
    """Counts that come as every kind of JSON value."""
    pages = event_feed.pages_of_all_kinds(_events(spark, folder))
    return bronze_source.parse_pages(pages)[0].select(
        "location_id", "sensing_datetime", "direction_1", "direction_2"
    )


@query
def stream_records(spark, folder):
    """Readings with key and ingestion time, as JSON lines keyed by sensor."""
    records = bronze_source.to_records(
        _bronze(spark, folder), F.lit(AS_OF_TIME).cast("timestamp")
    )
    return bronze_source.to_ndjson(records)


# --- Silver ----------------------------------------------------------------------


@query
def typed(spark, folder):
    return _typed(spark, folder)


@query
def valid_rows(spark, folder):
    return silver.split_valid_and_quarantine(_typed(spark, folder))[0]


@query
def quarantine_rows(spark, folder):
    return silver.split_valid_and_quarantine(_typed(spark, folder))[1]


@query
def clean_counts(spark, folder):
    return silver.clean_counts(_bronze(spark, folder))


@query
def dedup_latest(spark, folder):
    return silver.deduplicate(_typed(spark, folder))


@query
def dedup_lineitem(spark, folder):
    """The same step on another natural key and recency."""
    lines = event_feed.read_table(spark, folder, "lineitem")
    return silver.deduplicate(lines, ["l_orderkey", "l_linenumber"], "l_shipdate")


@query
def silver_rows(spark, folder):
    return _silver(spark, folder)


@query
def silver_table(spark, folder):
    """Silver written by the rebuild job from landed Bronze, read back."""
    stored = _rebuilt_silver(spark, folder, _work_folder(spark))
    return silver_plan.read_silver(spark, stored)


@query
def silver_incremental(spark, folder):
    """Silver after loads of successive arrival days, each merged into it."""
    landed, root = _landed_bronze(spark, folder), _work_folder(spark)
    for start, end in _arrival_loads(bronze_source.read_bronze(spark, landed)):
        silver_plan.add_arrivals(spark, landed, f"{root}/silver", start, end)
    return silver_plan.read_silver(spark, f"{root}/silver")


@query
def quarantine_table(spark, folder):
    """The quarantine the same job writes, by reported date."""
    rebuilt = _rebuilt_silver(spark, folder, _work_folder(spark))
    return silver_plan.read_quarantine(spark, rebuilt).groupBy("sensing_date").agg(
        F.count("*").alias("quarantined_rows"),
        F.count("location_id").alias("with_location"),
        F.count("event_ts_utc").alias("with_time"),
    )


@query
def late_flag(spark, folder):
    return _silver(spark, folder).select(
        "dedupe_key", "event_ts_utc", "ingested_ts_utc", silver.is_late().alias("is_late")
    )


# --- Gold ------------------------------------------------------------------------


@query
def stg(spark, folder):
    return _stg(spark, folder)


@query
def hourly_counts(spark, folder):
    return gold.hourly_counts(_stg(spark, folder))


@query
def sensor_observations(spark, folder):
    return gold.observe_sensors(_stg(spark, folder))


@query
def observed_dates(spark, folder):
    return gold.observed_dates(_stg(spark, folder))


@query
def dim_date(spark, folder):
    return gold.dim_date(_stg(spark, folder))


@query
def dim_sensor(spark, folder):
    return gold.dim_sensor(gold.observe_sensors(_stg(spark, folder)))


@query
def fact_hourly(spark, folder):
    return _fact(spark, folder)


@query
def gold_published(spark, folder):
    """The fact as published by the job that checks every rule first."""
    root = _work_folder(spark)
    stored = _rebuilt_silver(spark, folder, root)
    gold_plan.publish_gold(spark, stored, f"{root}/gold")
    return gold_plan.read_marts(spark, f"{root}/gold")["fact_footfall_hourly"]


@query
def marts_by_name(spark, folder):
    """The published marts as SQL consumers find them: by name."""
    root = _work_folder(spark)
    stored = _rebuilt_silver(spark, folder, root)
    gold_plan.publish_gold(spark, stored, f"{root}/gold")
    gold_plan.register_marts(spark, f"{root}/gold", stored)
    return spark.sql("""
        SELECT location_id, d.is_weekend, count(*) AS hours,
            sum(pedestrian_count) AS pedestrians
        FROM fact_footfall_hourly
        JOIN dim_sensor USING (sensor_key)
        JOIN dim_date d ON d.date_day = date_key
        GROUP BY location_id, d.is_weekend
    """)


@query
def scd2_versions(spark, folder):
    return scd2.build_versions(event_feed.attribute_feed(_events(spark, folder)), ["status"])


@query
def scd2_merged(spark, folder):
    """The first half of the feed as versions, then the second half merged in."""
    feed = event_feed.attribute_feed(_events(spark, folder))
    middle = F.lit(AS_OF_TIME).cast("timestamp")
    first = scd2.build_versions(feed.filter(F.col("observed_ts") < middle), ["status"])
    rest = feed.filter(F.col("observed_ts") >= middle)
    seen = feed.filter(F.col("observed_ts") < middle)
    return scd2.merge_versions(first, seen, rest, ["status"])


@query
def scd2_merged_late(spark, folder):
    """The second half of the feed first, and then, late, the first half."""
    feed = event_feed.attribute_feed(_events(spark, folder))
    middle = F.lit(AS_OF_TIME).cast("timestamp")
    seen = feed.filter(F.col("observed_ts") >= middle)
    late = feed.filter(F.col("observed_ts") < middle)
    return scd2.merge_versions(scd2.build_versions(seen, ["status"]), seen, late, ["status"])


@query
def scd2_log(spark, folder):
    """Versions kept up from a feed that comes in two loads, out of order."""
    feed = event_feed.attribute_feed(_events(spark, folder))
    root, half = _work_folder(spark), F.pmod(F.xxhash64("observed_ts"), F.lit(2))
    for k in range(2):
        scd2_plan.add_observations(spark, root, feed.filter(half == k), ["status"])
    return scd2_plan.read_versions(spark, root, ["status"])


@query
def scd2_point_in_time(spark, folder):
    """Readings with the sensor's status at their minute."""
    readings = _silver(spark, folder).select(
        "location_id", "event_ts_utc", "dedupe_key", "total_of_directions"
    )
    versions = scd2.build_versions(event_feed.attribute_feed(_events(spark, folder)), ["status"])
    versions = versions.select("location_id", "status", "valid_from", "valid_to")
    return scd2.point_in_time_join(readings, _stored(versions), "event_ts_utc")


# --- quality ------------------------------------------------------------------------


@query
def dq_report(spark, folder):
    rows = _stored(_silver(spark, folder))
    hourly = _stored(gold.hourly_counts(gold.staging_view(rows)))
    star = gold.star_schema_from_hourly(hourly)
    return quality.run_checks({"silver_pedestrian": rows, **star})


@query
def dq_repeated_keys(spark, folder):
    return quality.repeated_values(_bronze(spark, folder), "dedupe_key")


@query
def dq_minutes_bound(spark, folder):
    fact = _fact(spark, folder)
    return fact.select(
        "footfall_key",
        quality.minutes_bound(dst_aware=True).cast("int").alias("minutes_bound"),
        quality.too_many_minutes(dst_aware=True).alias("too_many"),
    )


@query
def orphan_facts(spark, folder):
    """Facts of sensors the dimension no longer has, once every sensor that
    fell silent before the last day is dropped from it."""
    star = _star(spark, folder)
    dim = star["dim_sensor"]
    last_day = F.to_date(dim.agg(F.max("last_seen")).scalar())
    recent = dim.filter(F.to_date("last_seen") == last_day)
    fact = star["fact_footfall_hourly"].select("footfall_key", "sensor_key", "date_key")
    return quality.orphans(fact, "sensor_key", recent, "sensor_key")


@query
def orphan_orders(spark, folder):
    """Orders per customer unknown among customers with a positive balance."""
    orders = event_feed.read_table(spark, folder, "orders")
    known = event_feed.read_table(spark, folder, "customer").filter("c_acctbal > 0")
    return quality.orphan_keys(orders, "o_custkey", known, "c_custkey")


@query
def reconcile(spark, folder):
    rows = _typed(spark, folder)
    return quality.reconcile(rows, _silver(spark, folder), silver.is_valid())


@query
def freshness(spark, folder):
    mark = F.lit(AS_OF_TIME).cast("timestamp")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return quality.freshness(_bronze(spark, folder), mark, now)


@query
def quarantine_rate(spark, folder):
    return quality.quarantine_rate(_typed(spark, folder), silver.is_valid())


# --- serving --------------------------------------------------------------------------


@query
def serving_facts_inner(spark, folder):
    return _facts(spark, folder)


@query
def serving_facts_left(spark, folder):
    star = _star(spark, folder)
    return serving.facts_with_current_sensor(star["fact_footfall_hourly"], star["dim_sensor"])


@query
def sensor_lookup(spark, folder):
    totals = serving.sensor_totals(_facts(spark, folder))
    return serving.located(totals, serving.sensor_locations(spark))


@query
def headline(spark, folder):
    return serving.headline_metrics(_facts(spark, folder))


@query
def busiest_sensors(spark, folder):
    return serving.busiest_sensors(_facts(spark, folder))


@query
def avg_by_hour(spark, folder):
    return serving.average_by_hour(_facts(spark, folder))


@query
def hourly_profile(spark, folder):
    return serving.hourly_profile(_facts(spark, folder))


@query
def hourly_profile_dense(spark, folder):
    return serving.dense_hourly_profile(_facts(spark, folder))


@query
def profile_outlook(spark, folder):
    return serving.profile_outlook(serving.dense_hourly_profile(_facts(spark, folder)))


@query
def sensor_totals_current(spark, folder):
    return serving.sensor_totals(_facts(spark, folder))


@query
def latest_hour_counts(spark, folder):
    return serving.latest_hour_counts(_facts(spark, folder))


@query
def snapshot_meta(spark, folder):
    return serving.snapshot_meta(_facts(spark, folder))


@query
def load_bands(spark, folder):
    return serving.with_load(serving.sensor_totals(_facts(spark, folder)))


@query
def top_bars(spark, folder):
    return serving.top_bars(serving.sensor_totals(_facts(spark, folder)))


@query
def snapshot(spark, folder):
    star = _star(spark, folder)
    facts = serving.facts_with_current_sensor(star["fact_footfall_hourly"], star["dim_sensor"])
    summary = _stored(serving.fact_summary(facts))
    document = serving.snapshot_of_summary(summary, serving.sensor_locations(spark))
    return document.select(F.to_json(F.struct("*")).alias("document"))


# --- features and forecast --------------------------------------------------------------


def _rounded(df: DataFrame) -> DataFrame:
    """Sines and cosines to six digits, for comparison between engines."""
    waves = [c for c in ("hour_sin", "hour_cos", "dow_sin", "dow_cos") if c in df.columns]
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in waves})


@query
def time_features(spark, folder):
    return _rounded(features.add_time_features(_fact(spark, folder).select(*oracles.FACT_SLICE)))


@query
def lag_features(spark, folder):
    return features.add_lag_features(_fact(spark, folder).select(*oracles.FACT_SLICE))


@query
def lag_features_calendar(spark, folder):
    fact = _fact(spark, folder).select(*oracles.FACT_SLICE)
    return features.add_target(features.add_lag_features(fact, calendar=True), calendar=True)


@query
def target(spark, folder):
    return features.add_target(_fact(spark, folder).select(*oracles.FACT_SLICE))


@query
def feature_rows(spark, folder):
    return _rounded(_feature_rows(spark, folder))


@query
def feature_rows_chunked(spark, folder):
    """The same with windows per sensor and week."""
    fact = _stored(_fact(spark, folder).select(*oracles.FACT_SLICE))
    return _rounded(features.build_features(fact, chunk="week"))


@query
def time_split(spark, folder):
    return forecast.with_split(_stored(_feature_rows(spark, folder))).select(
        "sensor_key", "date_key", "event_hour", "split"
    )


@query
def split_sizes(spark, folder):
    return forecast.split_sizes(forecast.with_split(_stored(_feature_rows(spark, folder))))


@query
def naive_metrics(spark, folder):
    marked = forecast.with_split(_stored(_feature_rows(spark, folder)))
    metrics = forecast.error_metrics(marked, forecast.seasonal_naive)
    return metrics.select(
        F.round("mae", 6).alias("mae"), F.round("mape", 6).alias("mape"), "n_train", "n_test"
    )


def _train(spark: SparkSession, folder: str) -> tuple[str, str, str]:
    """Folders of features, saved model and metrics, for later queries as well."""
    root = _work_folder(spark)
    rows = _stored(_feature_rows(spark, folder))
    model, metrics = forecast.train(rows)
    forecast.save_model(model, f"{root}/model")
    rows.write.parquet(f"{root}/features")
    metrics.write.parquet(f"{root}/metrics")
    trained = tuple(f"{root}/{name}" for name in ("features", "model", "metrics"))
    TRAINED[spark.sparkContext.applicationId, folder] = trained
    return trained


@query
def gbt_metrics(spark, folder):
    """The library's model, all its 300 trees, fitted on all training rows."""
    return spark.read.parquet(_train(spark, folder)[2])


@query
def gbt_reloaded(spark, folder):
    """Test rows as the saved and reloaded model scores them: each has a forecast
    that is finite and not negative."""
    key = (spark.sparkContext.applicationId, folder)
    rows, model, _ = TRAINED.get(key) or _train(spark, folder)
    test = forecast.with_split(spark.read.parquet(rows)).filter(F.col("split") == "test")
    value = F.col("prediction")
    usable = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    return forecast.score(forecast.load_model(model), test).select(
        "sensor_key", "date_key", "event_hour", F.coalesce(usable, F.lit(False)).alias("usable")
    )


# --- increments and streams ---------------------------------------------------------------


@query
def incremental_new(spark, folder):
    timed = incremental.with_event_time(_bronze(spark, folder))
    return incremental.filter_new(timed, F.lit(AS_OF_TIME).cast("timestamp"))


@query
def watermark_max(spark, folder):
    return incremental.newest_event(incremental.with_event_time(_bronze(spark, folder)))


@query
def poll_summary(spark, folder):
    """Counters of a poll that lands everything newer than a stored mark."""
    root = _work_folder(spark)
    mark = spark.sql(f"SELECT timestamp '{AS_OF_TIME}'").first()[0]
    poll_plan.write_mark(spark, f"{root}/mark", mark, 0)
    summary = poll_plan.land_new(
        spark, _bronze(spark, folder), f"{root}/mark", lambda df: df.write.json(f"{root}/landed")
    )
    landed = bronze_source.read_readings(spark, f"{root}/landed")
    return landed.agg(F.count("*").alias("landed")).select(
        F.lit(summary["status"]).alias("status"),
        *[F.lit(summary[k]).cast("bigint").alias(k) for k in ("fetched", "new", "emitted")],
        "landed",
    )


@query
def poll_pages(spark, folder):
    """What polls of a capped page each land from a stored mark on, in any number,
    and once more after the last: every reading newer than the mark, once."""
    root = _work_folder(spark)
    mark = spark.sql(f"SELECT timestamp '{AS_OF_TIME}'").first()[0]
    poll_plan.write_mark(spark, f"{root}/mark", mark, 0)
    readings = _stored(_bronze(spark, folder))
    cap = readings.count() // 5 + 1

    def sink(df):
        df.write.mode("append").json(f"{root}/landed")

    poll_plan.land_pages(spark, readings, f"{root}/mark", sink, cap)
    poll_plan.land_pages(spark, readings, f"{root}/mark", sink, cap)
    return bronze_source.read_readings(spark, f"{root}/landed").drop("ingested_at")


@query
def current_state(spark, folder):
    return incremental.current_state(_silver(spark, folder))


@query
def rolling_hourly_batch(spark, folder):
    return incremental.rolling_counts(_silver(spark, folder))


@query
def tumbling_hourly_batch(spark, folder):
    return incremental.rolling_counts(_silver(spark, folder), slide=None)


@query
def stream_landing(spark, folder):
    """JSON lines, some of them cut short, landed by the streaming job."""
    root = _work_folder(spark)
    lines = _bronze(spark, folder).select(F.to_json(F.struct("*")).alias("value"))
    cut = F.when(F.col("value").contains("not-a-time"), F.expr("left(value, 20)"))
    lines.select(F.coalesce(cut, "value").alias("value")).write.text(f"{root}/lines")
    source = landing.read_lines(spark, f"{root}/lines")
    landing.land(source, f"{root}/landed", f"{root}/c", once=True).awaitTermination()
    bronze = landing.bronze_folder(f"{root}/landed")
    landed = bronze_source.read_bronze(spark, bronze).drop("dt", "hour")
    errors = landing.read_errors(spark, f"{root}/landed")
    return landed.agg(
        F.count("*").alias("landed_rows"),
        F.countDistinct("dedupe_key").alias("landed_keys"),
        F.sum("direction_1").alias("landed_direction_1"),
    ).withColumn("error_rows", errors.agg(F.count("*")).scalar())


@query
def stream_silver(spark, folder):
    """Silver as the streaming job leaves it after several micro-batches."""
    root, landed = _work_folder(spark), _landed_bronze(spark, folder)
    source = silver_stream.read_bronze_stream(spark, landed, files_per_trigger=400)
    silver_stream.stream_silver(source, f"{root}/silver", f"{root}/c", once=True).awaitTermination()
    return silver_plan.read_silver(spark, f"{root}/silver")


@query
def stream_rolling(spark, folder):
    """Tumbling sums of a Bronze stream, kept up in a table."""
    root, landed = _work_folder(spark), _landed_bronze(spark, folder)
    readings = rolling.typed_stream(
        silver_stream.read_bronze_stream(spark, landed, files_per_trigger=10_000)
    )
    windows = rolling.stream_rolling(readings, slide=None, drop_copies=False)
    rolling.stream_rolling_table(
        windows, f"{root}/windows", f"{root}/c", once=True
    ).awaitTermination()
    return rolling.read_windows(spark, f"{root}/windows")


@query
def stream_state(spark, folder):
    """Latest reading per sensor kept up by the streaming job."""
    root, landed = _work_folder(spark), _landed_bronze(spark, folder)
    readings = rolling.typed_stream(
        silver_stream.read_bronze_stream(spark, landed, files_per_trigger=400)
    )
    rolling.stream_state(readings, f"{root}/state", f"{root}/c", once=True).awaitTermination()
    return rolling.read_state(spark, f"{root}/state")


# --- scalar functions -------------------------------------------------------------------------


@query
def scalar_functions(spark, folder):
    """The expressions the operators are made of, over every reading."""
    ts = F.col("event_ts_utc")
    day = F.col("event_date")
    return _typed(spark, folder).select(
        "dedupe_key",
        "ingested_at",
        C.iso_timestamp("sensing_datetime", strict=True).alias("strict_ts"),
        C.iso_text(ts).alias("iso_text"),
        C.local_time(ts).alias("local_ts"),
        F.date_format(day, "yyyy-MM-dd").alias("day_text"),
        C.iso_weekday(day).alias("iso_weekday"),
        C.hour_index(day, "event_hour").alias("hour_index"),
        C.seconds_between(ts, "ingested_ts_utc").alias("lag_seconds"),
        C.natural_key("location_id", "sensing_datetime").alias("natural_key"),
        C.surrogate_key(C.key_text("location_id"), C.key_text(ts, timestamp=True)).alias(
            "surrogate_key"
        ),
        C.zero_if_null("direction_1").alias("zero_if_null"),
        C.at_least("total_of_directions", 1.0).alias("at_least_one"),
        F.round(F.log1p(F.col("total_of_directions").cast("double")), 6).alias("log1p"),
        F.round(F.expm1(F.col("event_hour").cast("double") / 24), 6).alias("expm1"),
        C.whole_number("sensing_time").alias("not_a_number"),
        F.pmod(F.col("event_hour") + 15, F.lit(24)).alias("wrapped_hour"),
    )


# --- contract -------------------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Hourly counts per sensor, from raw readings."""
    return QUERIES["fact_hourly"](spark, SMOKE_FOLDER)


def _module(name: str):
    """A module of the training-data operators, or None in an installation
    without them. Any other failure to import is raised."""
    try:
        return importlib.import_module(name)
    except ModuleNotFoundError as error:
        if error.name in ("kerbside.llm", "kerbside.llm.queries", "corpus_pipeline"):
            return None
        raise


LLM = _module("kerbside.llm.queries")
PIPELINE = _module("corpus_pipeline")


def queries() -> dict[str, Query]:
    added = dict(LLM.QUERIES) if LLM else {}
    if PIPELINE:
        added["pipeline"] = PIPELINE.run
    return {**QUERIES, **added}


def oracle_sql() -> dict[str, str]:
    added = dict(LLM.ORACLE_SQL) if LLM else {}
    if PIPELINE and PIPELINE.ORACLE_SQL:
        added["pipeline"] = PIPELINE.ORACLE_SQL
    return {**oracles.all_sql(), **added}
