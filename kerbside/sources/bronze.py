"""Raw readings: landed NDJSON partitions and raw API pages."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions.columns import (
    is_empty_value,
    iso_text,
    natural_key,
    text_value,
    value_kind,
    whole_value,
)
from kerbside.schemas import (
    ARRIVAL_FIELDS,
    BRONZE_SCHEMA,
    CORRUPT_COLUMN,
    READING_FIELDS,
    SOURCE_COLUMN,
)

TEXT_IDENTITY = ["sensing_datetime", "sensing_date", "sensing_time"]
COUNT_FIELDS = ["direction_1", "direction_2", "total_of_directions"]


def bronze_schema(partitioned: bool = False, keep_corrupt: bool = False) -> T.StructType:
    fields = list(BRONZE_SCHEMA.fields)
    if keep_corrupt:
        fields.append(T.StructField(CORRUPT_COLUMN, T.StringType()))
    return T.StructType(fields + (ARRIVAL_FIELDS if partitioned else []))


def arrival_days(start: str, end: str) -> list[str]:
    """Every declared arrival day, both ends included."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    return [(first + timedelta(days=n)).isoformat() for n in range((last - first).days + 1)]


def read_readings(spark: SparkSession, path: str | list[str], keep_corrupt: bool = False) -> DataFrame:
    """NDJSON files with the fixed schema; a malformed line becomes a NULL row,
    its text kept in the corrupt column when asked for."""
    reader = spark.read.schema(bronze_schema(keep_corrupt=keep_corrupt))
    return reader.option("columnNameOfCorruptRecord", CORRUPT_COLUMN).json(path)


def with_source_file(bronze: DataFrame) -> DataFrame:
    """Names the landed file of each row, by arrival partition and file name;
    it is the same however and whenever the file is read."""
    name = F.concat_ws("/", "dt", "hour", "_metadata.file_name")
    return bronze.select("*", name.alias(SOURCE_COLUMN))


def read_bronze(
    spark: SparkSession,
    root: str,
    start: str | None = None,
    end: str | None = None,
    keep_corrupt: bool = False,
    with_source: bool = False,
) -> DataFrame:
    """The table partitioned by arrival ``dt`` and ``hour``.

    With a day range only those folders are listed, so the listing does not
    grow with the age of the table; days without a folder add no rows.
    """
    def named(rows: DataFrame) -> DataFrame:
        # Landing adds a folder a batch below the hour; it is no column of Bronze.
        rows = with_source_file(rows) if with_source else rows
        return rows.drop("batch")

    schema = bronze_schema(partitioned=True, keep_corrupt=keep_corrupt)
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
    if start is None and end is None:
        return named(reader.json(root))
    if start is None or end is None:
        raise ValueError("give both ends of the arrival range, or neither")
    days = ",".join(arrival_days(start, end))
    try:
        return named(reader.option("basePath", root).json(f"{root.rstrip('/')}/dt={{{days}}}"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        none = spark.createDataFrame([], schema)
        return none.withColumn(SOURCE_COLUMN, F.lit("")) if with_source else none


def on_arrival_days(bronze: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of declared arrival days; on a file scan this prunes partitions."""
    return bronze.filter(F.col("dt").between(start, end))


def on_arrival_day(bronze: DataFrame, as_of: str | date | Column) -> DataFrame:
    """Rows of one arrival day, given instead of read off the clock."""
    day = as_of if isinstance(as_of, Column) else F.lit(str(as_of))
    return bronze.filter(F.col("dt") == day)


# --- API pages --------------------------------------------------------------


def explode_pages(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per record of each page, its values as they came, numbers apart
    from text and from booleans. Pages without a list of results give none."""
    page = F.try_parse_json(payload)
    records = F.try_variant_get(page, "$.results", "array<variant>")
    return pages.select(F.explode(records).alias("record"))


def coerce_records(records: DataFrame) -> DataFrame:
    """Typed reading columns plus ``is_malformed`` per exploded record.

    Identity keys must be present and the id and counts must be whole numbers as
    :func:`whole_value` reads them. A count that is absent, null or empty is 0. A
    text field that is present but null stays NULL, which Silver quarantines.
    """

    def field(name: str) -> Column:
        return F.try_variant_get("record", f"$.{name}", "variant")

    present = records.select(*[field(name).alias(name) for name in READING_FIELDS])
    numbers = ["location_id", *COUNT_FIELDS]
    known = present.withColumns({f"kind_{n}": value_kind(F.col(n)) for n in numbers})

    def whole(name: str) -> Column:
        return whole_value(F.col(name), F.col(f"kind_{name}"))

    def count(name: str) -> Column:
        empty = is_empty_value(F.col(name), F.col(f"kind_{name}"))
        return F.when(empty, F.lit(0)).otherwise(whole(name))

    typed = F.struct(
        whole("location_id").alias("location_id"),
        *[text_value(F.col(name)).alias(name) for name in TEXT_IDENTITY],
        *[count(name).alias(name) for name in COUNT_FIELDS],
        reduce(and_, [F.col(name).isNotNull() for name in TEXT_IDENTITY]).alias("has_texts"),
    )
    # Rows of a generator: a filter above does not compute the values once more.
    rows = known.select(F.inline(F.array(typed)))
    sound = reduce(and_, [F.col(name).isNotNull() for name in numbers], F.col("has_texts"))
    return rows.withColumn("is_malformed", ~sound).drop("has_texts")


def parse_pages(pages: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Readings from raw pages, and the one-row count of records skipped."""
    coerced = coerce_records(explode_pages(pages, payload))
    readings = coerced.filter(~F.col("is_malformed")).select(*READING_FIELDS)
    skipped = coerced.agg(
        F.count("*").alias("records"), F.count_if("is_malformed").alias("skipped")
    )
    return readings, skipped


def to_records(readings: DataFrame, ingested_at: Column) -> DataFrame:
    """Bronze rows: the source fields plus natural key and ingestion time."""
    return readings.select(
        *READING_FIELDS,
        natural_key("location_id", "sensing_datetime").alias("dedupe_key"),
        iso_text(ingested_at).alias("ingested_at"),
    )


def to_ndjson(records: DataFrame) -> DataFrame:
    """One JSON object per row and its sensor as key, as a stream sink takes it."""
    return records.select(
        F.col("location_id").cast("string").alias("key"),
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"),
    )
