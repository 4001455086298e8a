"""Stream landing: raw JSON lines into Bronze, unreadable ones set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbside.schemas import BRONZE_SCHEMA, CORRUPT_COLUMN
from kerbside.sources.bronze import bronze_schema

FLUSH = "60 seconds"
BRONZE, MALFORMED = "bronze", "malformed_json"


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Landed text lines as a replayable stream with ``value`` per record."""
    return (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
    )


def read_topic(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """The same from Kafka (needs its connector on the cluster). Messages keyed
    by sensor stay in order within their partition."""
    stream = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return stream.select(
        F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrived_at")
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed readings per line, its text kept where it is no readable object."""
    options = {"columnNameOfCorruptRecord": CORRUPT_COLUMN, "mode": "PERMISSIVE"}
    schema = bronze_schema(keep_corrupt=True)
    arrived = F.col("arrived_at") if "arrived_at" in lines.columns else F.current_timestamp()
    return lines.select(
        F.from_json("value", schema, options).alias("reading"),
        "value",
        arrived.alias("arrived_at"),
    )


def is_readable() -> Column:
    return F.col("reading").isNotNull() & F.col(f"reading.{CORRUPT_COLUMN}").isNull()


def arrival_partitions() -> list[Column]:
    return [
        F.date_format("arrived_at", "yyyy-MM-dd").alias("dt"),
        F.date_format("arrived_at", "HH").alias("hour"),
    ]


def sink_lines(parsed: DataFrame) -> DataFrame:
    """A line of text for each record and the sink it goes to: ``bronze``, or an
    error type with the text that could not be read."""
    reading = F.struct(*[F.col(f"reading.{name}").alias(name) for name in BRONZE_SCHEMA.fieldNames()])
    error = F.struct("value", F.lit(MALFORMED).alias("error_type"))
    return parsed.select(
        F.when(is_readable(), F.to_json(reading)).otherwise(F.to_json(error)).alias("line"),
        F.when(is_readable(), BRONZE).otherwise(MALFORMED).alias("sink"),
        *arrival_partitions(),
    )


def write_batch(lines: DataFrame, batch_id: int, root: str) -> None:
    """All sinks of a batch in one write. Its folders bear its number, so a batch
    that is run again replaces what it left, whichever sinks it had reached."""
    (
        lines.withColumn("batch", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "gzip")
        .partitionBy("sink", "dt", "hour", "batch")
        .text(root)
    )


def land(lines: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Gzip NDJSON below ``sink`` and ``dt``/``hour`` of arrival, each line once.

    One query reads the source once and feeds every sink. The time of arrival is
    the source's or the batch's, which a batch that is run again keeps. There is
    no shuffle: a source partition's records keep their order, and a sensor that
    sends a third of all lines is spread as the source spreads it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, root)

    trigger = {"availableNow": True} if once else {"processingTime": FLUSH}
    return (
        sink_lines(parse_lines(lines))
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def bronze_folder(root: str) -> str:
    return f"{root}/sink={BRONZE}"


def read_errors(spark: SparkSession, root: str) -> DataFrame:
    """Lines that could not be read, with their arrival partitions."""
    schema = "value string, error_type string, dt string, hour string, batch bigint"
    return spark.read.schema(schema).json(f"{root}/sink={MALFORMED}")
