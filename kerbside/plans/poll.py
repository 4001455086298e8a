"""One poll: what is new since the mark, landed page by page, mark advanced.

The mark is a cursor: an event time and, after a page that ended within it, the
key of the last reading landed. Beside it lie a ledger of the unreadable readings
landed, which no time can tell from new ones, and the page being landed.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kerbside.functions.columns import iso_text, iso_timestamp
from kerbside.operators.incremental import (
    EPOCH,
    is_after,
    is_up_to,
    page_end,
    with_position,
)
from kerbside.sources.bronze import to_records
from kerbside.sources.sinks import write_table

MARK_SCHEMA = (
    "last_event_ts string, updated_at string, last_record_count bigint, "
    "last_at bigint, last_key string"
)
LEDGER_SCHEMA = "key string"


def _read_or_none(read: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_cursor(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Event time in microseconds and key of the furthest mark; the epoch when
    there is none to read.

    Marks are only ever added and the greatest counts, so a slow run that ends
    late cannot move the mark back. One without key is beyond all keys.
    """
    marks = _read_or_none(lambda: spark.read.schema(MARK_SCHEMA).json(path))
    if marks is None:
        return 0, None
    at = F.coalesce("last_at", F.unix_micros(iso_timestamp("last_event_ts")))
    furthest = F.struct(at.alias("at"), F.col("last_key").isNull(), F.col("last_key").alias("key"))
    newest = marks.filter(at.isNotNull()).agg(F.max(furthest).alias("m")).select("m.at", "m.key")
    found = newest.first()
    return (0, None) if found["at"] is None else (found["at"], found["key"])


def read_mark(spark: SparkSession, path: str) -> datetime:
    """The event time of the mark; the epoch when there is none to read."""
    at, _ = read_cursor(spark, path)
    return spark.range(1).select(F.timestamp_micros(F.lit(at))).first()[0] if at else EPOCH


def write_cursor(
    spark: SparkSession, path: str, at: int, key: str | None, record_count: int
) -> None:
    """Add a mark, unless one at least as far is there."""
    seen, seen_key = read_cursor(spark, path)
    if (at, key is None, key or "") <= (seen, seen_key is None, seen_key or ""):
        return
    row = spark.range(1).select(
        iso_text(F.timestamp_micros(F.lit(at))).alias("last_event_ts"),
        iso_text(F.current_timestamp()).alias("updated_at"),
        F.lit(record_count).cast("bigint").alias("last_record_count"),
        F.lit(at).cast("bigint").alias("last_at"),
        F.lit(key).cast("string").alias("last_key"),
    )
    row.coalesce(1).write.mode("append").json(path)


def write_mark(spark: SparkSession, path: str, event_ts: datetime, record_count: int) -> None:
    """A mark that has passed everything up to a time."""
    at = spark.range(1).select(F.unix_micros(F.lit(event_ts))).first()[0]
    write_cursor(spark, path, at, None, record_count)


def land_new(
    spark: SparkSession,
    readings: DataFrame,
    mark_path: str,
    sink: Callable[[DataFrame], int | None],
    ingested_at: datetime | None = None,
    max_records: int | None = None,
) -> dict[str, object]:
    """Write readings newer than the mark through ``sink``; returns the counters.

    With ``max_records`` only the first so many by event time and key are landed,
    and copies of the last one; ``more`` tells whether others wait for the next poll.
    Readings without a readable time come first and land once.

    The page is stored before the sink sees it, so what is counted is what is
    landed, whatever the sink does with it. A sink may return how many readings it
    has refused. Mark and ledger advance only after the sink has returned and
    taken them all: otherwise the next run offers the same readings again.
    """
    started = ingested_at or datetime.now(timezone.utc).replace(tzinfo=None)
    seen = Observation()
    columns = [*readings.columns, "event_ts_utc", "at", "key"]
    offered = with_position(readings).observe(seen, F.count(F.lit(1)).alias("fetched"))
    new = F.col("new")
    marked = offered.withColumn("new", is_after(*read_cursor(spark, mark_path)))
    ledger_path, page_path = f"{mark_path}.unreadable", f"{mark_path}.page"
    ledger = _read_or_none(lambda: spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path))
    if ledger is not None:
        known = ledger.distinct().withColumn("landed", F.lit(True))
        marked = marked.join(known, "key", "left").withColumn(
            "new", new & ~(F.col("at").isNull() & F.coalesce("landed", F.lit(False)))
        )
    waiting = marked.filter(new)
    end = page_end(waiting, max_records) if max_records else None
    chosen = waiting if end is None else waiting.filter(is_up_to(*end))
    chosen = chosen.select(*columns)
    write_table(chosen, page_path)
    page = spark.read.schema(chosen.schema).parquet(page_path)

    counted = page.agg(F.count("*").alias("new"), F.max("at").alias("at")).first()
    failed = sink(to_records(page, F.lit(started))) or 0
    if not failed:
        unreadable = page.filter(F.col("at").isNull()).select("key").distinct()
        if not unreadable.isEmpty():
            unreadable.write.mode("append").parquet(ledger_path)
        if counted["at"] is not None:
            key = None if end is None else end[1]
            write_cursor(spark, mark_path, counted["at"], key, counted["new"])
    status = "partial_failure" if failed else "ok" if counted["new"] else "no_new_data"
    summary = {
        "status": status,
        "fetched": seen.get["fetched"],
        "new": counted["new"],
        "emitted": counted["new"] - failed,
        "failed": failed,
    }
    return summary if max_records is None else {**summary, "more": end is not None}


def land_pages(
    spark: SparkSession,
    readings: DataFrame,
    mark_path: str,
    sink: Callable[[DataFrame], int | None],
    max_records: int,
) -> list[dict[str, object]]:
    """Polls of one page each until nothing is left or a page fails."""
    done = []
    while True:
        done.append(land_new(spark, readings, mark_path, sink, max_records=max_records))
        if done[-1]["status"] != "ok" or not done[-1]["more"]:
            return done
