"""Gold to the nested document a dashboard loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbside.operators.serving import (
    fact_summary,
    facts_with_current_sensor,
    sensor_locations,
    snapshot_of_summary,
)
from kerbside.plans.gold import FACT, read_marts
from kerbside.sources.sinks import write_json, write_table


def export_snapshot(
    spark: SparkSession, gold_root: str, path: str, locations: DataFrame | None = None
) -> DataFrame:
    """Facts are read and joined once, for their summary, which is kept beside
    the document; the document's lists come from that."""
    marts = read_marts(spark, gold_root)
    summary = fact_summary(facts_with_current_sensor(marts[FACT], marts["dim_sensor"]))
    write_table(summary, f"{path}.summary")
    stored = spark.read.schema(summary.schema).parquet(f"{path}.summary")
    document = snapshot_of_summary(stored, locations or sensor_locations(spark))
    write_json(document, path)
    return spark.read.schema(document.schema).json(path)
