"""Bronze to Silver jobs: rebuild from all arrivals, or add new ones.

Silver and quarantine are tables of one versioned root: one pass over Bronze
writes both, one commit shows both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.operators.silver import deduplicate_silver, is_valid, silver_and_quarantine
from kerbside.schemas import (
    ARRIVAL_FIELDS,
    BRONZE_SCHEMA,
    CORRUPT_COLUMN,
    SILVER_COLUMNS,
    SILVER_SCHEMA,
    SOURCE_COLUMN,
)
from kerbside.sources import versions
from kerbside.sources.bronze import read_bronze
from kerbside.sources.sinks import in_silver_layout
from kerbside.sources.versions import PART, TABLE, parted

SILVER, QUARANTINE = "silver", "quarantine"

# Quarantine keeps the Bronze columns, where a row came from, and what could be
# derived of it. Its parts are days as reported, Silver's are event dates.
_derived = [f for f in SILVER_SCHEMA.fields if f.name not in BRONZE_SCHEMA.fieldNames()]
_texts = [T.StructField(name, T.StringType()) for name in (CORRUPT_COLUMN, SOURCE_COLUMN)]
QUARANTINE_SCHEMA = T.StructType([*BRONZE_SCHEMA.fields, *ARRIVAL_FIELDS, *_texts, *_derived])
SCHEMAS = {
    SILVER: parted(SILVER_SCHEMA, T.DateType()),
    QUARANTINE: parted(QUARANTINE_SCHEMA, T.DateType()),
}


def _as_silver(rows: DataFrame) -> DataFrame:
    """The event date is read off the part, so that filters on it prune parts."""
    return rows.withColumn("event_date", F.col(PART)).select(*SILVER_COLUMNS)


def read_silver(spark: SparkSession, root: str) -> DataFrame:
    return _as_silver(versions.read(spark, root, SILVER))


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    return versions.read(spark, root, QUARANTINE).drop(PART)


def observe_quality(bronze: DataFrame) -> tuple[DataFrame, Observation]:
    """Counts rows and unusable rows while another job reads the frame."""
    seen = Observation()
    bad = ~is_valid()
    observed = bronze.observe(
        seen, F.count(F.lit(1)).alias("bronze_rows"), F.count_if(bad).alias("quarantined_rows")
    )
    return observed, seen


def write_load(bronze: DataFrame, root: str, load: str) -> dict[str, int]:
    """Bronze rows as parts of Silver and quarantine, in one pass and one write."""
    seen: list[Observation] = []

    def watched(typed: DataFrame) -> DataFrame:
        observed, observation = observe_quality(typed)
        seen.append(observation)
        return observed

    rows = silver_and_quarantine(bronze, QUARANTINE_SCHEMA, watch=watched)
    rows = rows.withColumnsRenamed({"table": TABLE, "day": PART})
    versions.write_tables(in_silver_layout(rows, TABLE, PART), root, load)
    return seen[0].get


def rebuild_silver(spark: SparkSession, bronze_root: str, root: str) -> dict[str, int]:
    """All of Bronze into Silver and quarantine, in place of what they held.

    The tables are written once, beside the old ones, which readers see until
    the commit; a rebuild that dies before it has changed nothing.
    """
    load = versions.new_load()
    bronze = read_bronze(spark, bronze_root, keep_corrupt=True, with_source=True)
    counts = write_load(bronze, root, load)
    versions.commit(spark, root, load, SCHEMAS, full=True)
    return counts


def upsert(spark: SparkSession, bronze: DataFrame, root: str) -> dict[str, int]:
    """Merge Bronze rows into both tables, part by part; repeating it is harmless.

    A key holds the event's instant, so its copies share an event date and
    deduplicating whole dates is exact. Quarantined rows replace those that
    came of the same files before. Parts without new rows stay as they are.
    """
    fresh, load = versions.new_load(), versions.new_load()
    counts = write_load(bronze, root, fresh)
    for name, schema in SCHEMAS.items():
        parts = versions.written_parts(spark, root, fresh, name, schema)
        if not parts:
            continue
        new = versions.read_load(spark, root, fresh, name, schema)
        if versions.exists(spark, root, name):
            stored = versions.read(spark, root, name, parts)
            if name == SILVER:
                both = _as_silver(new).unionByName(_as_silver(stored))
                new = deduplicate_silver(both).withColumn(PART, F.col("event_date"))
            else:
                files = new.select(SOURCE_COLUMN).distinct()
                new = stored.join(files, SOURCE_COLUMN, "left_anti").unionByName(new)
        versions.write(in_silver_layout(new, PART), root, load, name, F.col(PART))
    versions.commit(spark, root, load, SCHEMAS)
    versions.discard(spark, root, fresh)
    return counts


def add_arrivals(
    spark: SparkSession, bronze_root: str, root: str, start: str, end: str
) -> dict[str, int]:
    """Whole arrival days into Silver and quarantine."""
    bronze = read_bronze(spark, bronze_root, start, end, keep_corrupt=True, with_source=True)
    return upsert(spark, bronze, root)
