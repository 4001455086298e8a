"""Silver to Gold: build the star schema, check it, publish it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.operators.gold import (
    dim_date,
    dim_sensor,
    fact_hourly,
    hourly_counts,
    observe_sensors_hourly,
    staging_view,
)
from kerbside.operators.quality import RuleSet, require_passed, run_checks, standard_rules
from kerbside.plans.silver import read_silver
from kerbside.sources import versions
from kerbside.sources.sinks import gather, register_view
from kerbside.sources.versions import PART, parted

FACT = "fact_footfall_hourly"
MARTS = ["dim_date", "dim_sensor", FACT]


def _as_mart(name: str, rows: DataFrame) -> DataFrame:
    """The fact's date key is read off the part, so that readers prune by it."""
    if name == FACT:
        rows = rows.withColumn("date_key", F.col(PART))
    return rows.drop(PART)


def read_marts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The marts of the newest publication, all of the same one."""
    return {name: _as_mart(name, versions.read(spark, root, name)) for name in MARTS}


def register_marts(spark: SparkSession, root: str, silver_root: str | None = None) -> None:
    """The published tables by name, for SQL: a snapshot until called again."""
    for name, mart in read_marts(spark, root).items():
        register_view(mart, name)
    if silver_root is not None:
        silver = read_silver(spark, silver_root)
        register_view(silver, "silver_pedestrian")
        register_view(staging_view(silver), "stg_pedestrian")


class Candidate:
    """The marts of one load, written but not committed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.load = spark, root, versions.new_load()
        self.schemas: dict[str, T.StructType] = {}

    def store(self, name: str, df: DataFrame, part: str | None = None) -> DataFrame:
        """Writes a table into the load and returns it read back."""
        kind = df.schema[part].dataType if part else T.StringType()
        self.schemas[name] = parted(df.schema, kind)
        versions.write(df, self.root, self.load, name, F.col(part) if part else None)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        schema = self.schemas[name]
        return _as_mart(name, versions.read_load(self.spark, self.root, self.load, name, schema))

    def publish(self) -> int:
        marts = {name: self.schemas[name] for name in MARTS}
        return versions.commit(self.spark, self.root, self.load, marts, full=True)


def build_candidate(spark: SparkSession, silver_root: str, gold_root: str) -> Candidate:
    """The marts, written next to the published ones.

    Silver is read once, for the hourly counts; everything else is built from
    those, which are stored first so that no table repeats the aggregation.
    """
    stg = staging_view(read_silver(spark, silver_root))
    register_view(stg, "stg_pedestrian")
    candidate = Candidate(spark, gold_root)
    hourly = candidate.store("hourly", hourly_counts(stg))
    candidate.store("dim_date", dim_date(hourly))
    sensors = candidate.store("dim_sensor", dim_sensor(observe_sensors_hourly(hourly)))
    candidate.store(FACT, gather(fact_hourly(hourly, sensors), "date_key"), "date_key")
    return candidate


def publish_gold(
    spark: SparkSession, silver_root: str, gold_root: str, rules: RuleSet | None = None
) -> DataFrame:
    """Build and publish, unless a rule fails; returns the rule report.

    The checked tables are the published ones: publication is one commit of all
    three, nothing is copied, and until it readers see the former marts.
    """
    candidate = build_candidate(spark, silver_root, gold_root)
    marts = {name: candidate.read(name) for name in MARTS}
    checked = {"silver_pedestrian": read_silver(spark, silver_root), **marts}
    report = candidate.store("report", run_checks(checked, rules or standard_rules()))
    require_passed(report)
    candidate.publish()
    return report
