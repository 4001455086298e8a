"""Data-quality rules, evaluated per table in as few passes as they allow."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.columns import (
    iso_timestamp,
    seconds_between,
    utc_hours_of_local_hour,
)
from kerbside.schemas import LOCAL_ZONE

MINUTES_PER_HOUR = 60
FRESH_SECONDS = 900


@dataclass(frozen=True)
class RowRule:
    """Counts rows for which ``broken`` holds; all of a table share one pass."""

    table: str
    name: str
    broken: Column


@dataclass(frozen=True)
class UniqueRule:
    """Counts non-NULL values that occur more than once."""

    table: str
    column: str

    @property
    def name(self) -> str:
        return f"unique_{self.column}"


@dataclass(frozen=True)
class ReferenceRule:
    """Counts rows whose non-NULL ``column`` is missing from the parent table."""

    table: str
    column: str
    parent: str
    parent_column: str

    @property
    def name(self) -> str:
        return f"reference_{self.column}"


@dataclass(frozen=True)
class RuleSet:
    rows: list[RowRule] = field(default_factory=list)
    unique: list[UniqueRule] = field(default_factory=list)
    references: list[ReferenceRule] = field(default_factory=list)


def not_null(table: str, *columns: str) -> list[RowRule]:
    return [RowRule(table, f"not_null_{c}", F.col(c).isNull()) for c in columns]


def in_range(table: str, column: str, low: int, high: int) -> RowRule:
    return RowRule(table, f"range_{column}", ~F.col(column).between(low, high))


def minutes_bound(dst_aware: bool = False, zone: str = LOCAL_ZONE) -> Column:
    """Minutes a local hour can have: 60, or 120 for the one that DST repeats."""
    if not dst_aware:
        return F.lit(MINUTES_PER_HOUR)
    hours = utc_hours_of_local_hour(F.col("date_key"), F.col("event_hour"), zone)
    return hours * F.lit(MINUTES_PER_HOUR)


def too_many_minutes(dst_aware: bool = False, zone: str = LOCAL_ZONE) -> Column:
    return F.col("minutes_reported") > minutes_bound(dst_aware, zone)


def standard_rules(dst_aware: bool = False, zone: str = LOCAL_ZONE) -> RuleSet:
    silver, dates, sensors, fact = (
        "silver_pedestrian",
        "dim_date",
        "dim_sensor",
        "fact_footfall_hourly",
    )
    return RuleSet(
        rows=[
            *not_null(silver, "dedupe_key"),
            *not_null(dates, "date_day"),
            *not_null(sensors, "sensor_key", "location_id", "is_current"),
            *not_null(fact, "footfall_key", "pedestrian_count", "event_hour"),
            in_range(fact, "event_hour", 0, 23),
            RowRule(fact, "minutes_within_bounds", too_many_minutes(dst_aware, zone)),
        ],
        unique=[
            UniqueRule(silver, "dedupe_key"),
            UniqueRule(dates, "date_day"),
            UniqueRule(sensors, "sensor_key"),
            UniqueRule(fact, "footfall_key"),
        ],
        references=[
            ReferenceRule(fact, "sensor_key", sensors, "sensor_key"),
            ReferenceRule(fact, "date_key", dates, "date_day"),
        ],
    )


# --- single checks -----------------------------------------------------------------


def repeated_values(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
    )


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows pointing at no parent; NULL points nowhere and is no orphan."""
    known = parent.select(F.col(parent_column).alias(column)).filter(F.col(column).isNotNull())
    return child.filter(F.col(column).isNotNull()).join(known, column, "left_anti")


def orphan_keys(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """Orphaned values with their number of rows. Rows are counted per value
    before the join, so a value on very many rows joins as one."""
    counted = child.groupBy(column).agg(F.count("*").alias("child_rows"))
    return orphans(counted, column, parent, parent_column)


# --- the report -----------------------------------------------------------------------


def _report(rows: DataFrame) -> DataFrame:
    return rows.select(
        "rule", "table_name", "violations", (F.col("violations") == 0).alias("passed")
    )


def _row_rules(table: str, df: DataFrame, rules: list[RowRule]) -> DataFrame:
    counted = df.agg(*[F.count_if(r.broken).alias(r.name) for r in rules])
    entries = [
        F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("violations")) for r in rules
    ]
    return counted.select(F.explode(F.array(*entries)).alias("entry")).select(
        "entry.rule", F.lit(table).alias("table_name"), "entry.violations"
    )


def _named_count(rule: str, table: str, df: DataFrame, violations: Column) -> DataFrame:
    return df.agg(violations.alias("violations")).select(
        F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), "violations"
    )


def run_checks(tables: dict[str, DataFrame], rules: RuleSet | None = None) -> DataFrame:
    """One row per rule: its table, how many violations, whether it passed."""
    rules = rules or standard_rules()
    parts = []
    for table in dict.fromkeys(r.table for r in rules.rows):
        own = [r for r in rules.rows if r.table == table]
        parts.append(_row_rules(table, tables[table], own))
    for rule in rules.unique:
        repeated = repeated_values(tables[rule.table], rule.column)
        parts.append(_named_count(rule.name, rule.table, repeated, F.count("*")))
    for rule in rules.references:
        missing = orphan_keys(
            tables[rule.table], rule.column, tables[rule.parent], rule.parent_column
        )
        lost = F.coalesce(F.sum("child_rows"), F.lit(0))
        parts.append(_named_count(rule.name, rule.table, missing, lost))
    return _report(reduce(DataFrame.unionByName, parts))


class QualityError(RuntimeError):
    """Raised instead of publishing tables that break a rule."""


def require_passed(report: DataFrame) -> None:
    """The publish gate: stops the caller when any rule failed."""
    failed = report.filter(~F.col("passed")).orderBy("table_name", "rule").collect()
    if failed:
        listed = ", ".join(f"{r['table_name']}.{r['rule']}={r['violations']}" for r in failed)
        raise QualityError(f"rules failed: {listed}")


# --- pipeline health ---------------------------------------------------------------------


def reconcile(typed_bronze: DataFrame, silver: DataFrame, is_valid: Column) -> DataFrame:
    """Bronze rows = Silver rows + copies removed + quarantined rows.

    Copies are counted by themselves from Bronze (valid rows minus distinct
    keys, no key counting as one), so that the equality says something.
    """
    valid = F.coalesce(is_valid, F.lit(False))
    key = F.when(valid, F.struct("dedupe_key"))
    counted = typed_bronze.agg(
        F.count("*").alias("bronze_rows"),
        F.count_if(~valid).alias("quarantined_rows"),
        (F.count_if(valid) - F.countDistinct(key)).alias("duplicate_rows"),
    )
    stored = silver.agg(F.count("*")).scalar()
    return counted.withColumn("silver_rows", stored).select(
        "bronze_rows",
        "silver_rows",
        "duplicate_rows",
        "quarantined_rows",
        (
            F.col("bronze_rows")
            == F.col("silver_rows") + F.col("duplicate_rows") + F.col("quarantined_rows")
        ).alias("reconciled"),
    )


def freshness(
    bronze: DataFrame, processed_to: Column, as_of: Column, limit_seconds: int = FRESH_SECONDS
) -> DataFrame:
    """Is there anything newer than was processed, and has it waited too long?"""
    ingested = iso_timestamp("ingested_at")
    waiting = ingested > processed_to
    return bronze.agg(
        F.max(ingested).alias("newest_ingested"),
        F.count_if(waiting).alias("waiting_rows"),
        F.min(F.when(waiting, ingested)).alias("oldest_waiting"),
    ).select(
        "newest_ingested",
        "waiting_rows",
        (F.col("waiting_rows") > 0).alias("has_new_data"),
        seconds_between(F.col("oldest_waiting"), as_of).alias("waited_seconds"),
        F.coalesce(
            seconds_between(F.col("oldest_waiting"), as_of) > limit_seconds, F.lit(False)
        ).alias("is_stale"),
    )


def quarantine_rate(typed: DataFrame, is_valid: Column) -> DataFrame:
    """Share of unusable rows per reported date, to spot an upstream change."""
    bad = ~F.coalesce(is_valid, F.lit(False))
    return typed.groupBy("sensing_date").agg(
        F.count("*").alias("bronze_rows"),
        F.count_if(bad).alias("quarantined_rows"),
        (F.count_if(bad) / F.count("*")).alias("quarantine_ratio"),
    )
