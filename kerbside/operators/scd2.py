"""Versioned dimension: build versions from a feed, join facts as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.columns import key_text, surrogate_key
from kerbside.operators.chunks import (
    CHUNK,
    carry,
    chunk_order,
    in_chunk,
    neighbours,
    summarise,
    with_chunk,
)


def build_versions(
    feed: DataFrame,
    attributes: list[str],
    key: str = "location_id",
    ts: str = "observed_ts",
    chunk: str = "hour",
) -> DataFrame:
    """Versions of each key: a new one opens whenever an attribute changes.

    Validity is half-open, ``[valid_from, valid_to)``, and the last version is
    open. Of several observations at one instant the greatest attributes count.
    """
    state = F.struct(*attributes)
    observed = feed.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        key, F.col(ts).alias("valid_from"), state.alias("state")
    )
    observed = with_chunk(observed, "valid_from", chunk)

    # Last state before each chunk, to compare the chunk's first row with.
    last = summarise(
        observed, [key], last=F.max(F.struct("valid_from", "state"))["state"]
    )
    before = neighbours(last, [key], state_before=F.lag("last").over(chunk_order([key])))

    in_time = in_chunk([key]).orderBy("valid_from", "state")
    settled = observed.withColumn("next_ts", F.lead("valid_from").over(in_time)).filter(
        F.col("next_ts").isNull() | (F.col("next_ts") > F.col("valid_from"))
    )
    compared = carry(
        settled.withColumn("previous", F.lag("state").over(in_time)), before, [key]
    )
    starts = compared.filter(
        ~F.col("state").eqNullSafe(F.coalesce("previous", "state_before"))
    ).select(key, CHUNK, "valid_from", "state")

    return close_versions(starts, attributes, key, chunk)


def close_versions(
    starts: DataFrame, attributes: list[str], key: str = "location_id", chunk: str = "hour"
) -> DataFrame:
    """Versions from their beginnings (``valid_from``, ``state``): each one ends
    where the next of its key begins."""
    starts = with_chunk(starts, "valid_from", chunk)
    # First start after each chunk, to close the chunk's last version with.
    first = summarise(starts, [key], first=F.min("valid_from"))
    after = neighbours(first, [key], start_after=F.lead("first").over(chunk_order([key])))
    closed = carry(
        starts.withColumn(
            "next_start", F.lead("valid_from").over(in_chunk([key]).orderBy("valid_from"))
        ),
        after,
        [key],
    )
    valid_to = F.coalesce("next_start", "start_after")
    return closed.select(
        # The time is taken whole: versions may start within one second.
        surrogate_key(key_text(key), key_text("valid_from")).alias("sensor_key"),
        key,
        *[F.col("state")[name].alias(name) for name in attributes],
        "valid_from",
        valid_to.alias("valid_to"),
        valid_to.isNull().alias("is_current"),
    )


def merge_versions(
    versions: DataFrame,
    observations: DataFrame,
    feed: DataFrame,
    attributes: list[str],
    key: str = "location_id",
    ts: str = "observed_ts",
    chunk: str = "hour",
) -> DataFrame:
    """Versions after new feed rows, in whatever order these arrive.

    Versions alone do not say when their state was seen again, which decides
    where a late row ends and the earlier state resumes. So the keys that the
    feed names are built anew from ``observations``, the feed so far, together
    with the new rows; versions of all other keys stay as they are.
    """
    touched = feed.select(key).distinct()
    columns = [key, ts, *attributes]
    seen = observations.select(*columns).join(touched, key, "left_semi")
    rebuilt = build_versions(
        seen.unionByName(feed.select(*columns)), attributes, key, ts, chunk
    )
    return versions.join(touched, key, "left_anti").select(*rebuilt.columns).unionByName(rebuilt)


def point_in_time_join(
    readings: DataFrame,
    versions: DataFrame,
    ts: str,
    key: str = "location_id",
    chunk: str = "hour",
) -> DataFrame:
    """Each reading with the version of its time, or with none.

    That is the latest version begun by then, if it has not ended: of versions
    that overlap the later one counts, and where it ends none does, whatever an
    earlier one says. A reading keeps its row, once, with any dimension.

    Versions and readings are laid on one time line per key; a version comes
    before the readings of its own instant.
    """
    added = [c for c in versions.columns if c != key]
    version = F.struct(*[F.col(c) for c in added])
    usable = F.col(key).isNotNull() & F.col(ts).isNotNull()
    timeline = (
        readings.filter(usable)
        .select(key, F.col(ts).alias("at"), F.struct("*").alias("reading"))
        .unionByName(
            versions.filter(F.col(key).isNotNull()).select(
                key, F.col("valid_from").alias("at"), version.alias("version")
            ),
            allowMissingColumns=True,
        )
    )
    timeline = with_chunk(timeline, "at", chunk)

    last = summarise(timeline, [key], last=F.max_by("version", F.when(
        F.col("version").isNotNull(), F.col("at"))))
    earlier = chunk_order([key]).rowsBetween(Window.unboundedPreceding, -1)
    before = neighbours(
        last, [key], version_before=F.last("last", ignorenulls=True).over(earlier)
    )
    so_far = in_chunk([key]).orderBy("at", F.col("version").isNull())
    begun = F.last("version", ignorenulls=True).over(
        so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = carry(timeline.withColumn("begun", begun), before, [key]).filter(
        F.col("reading").isNotNull()
    )
    latest: Column = F.coalesce("begun", "version_before")
    still_valid = latest["valid_to"].isNull() | (F.col("at") < latest["valid_to"])
    joined = matched.withColumn("version", F.when(still_valid, latest)).select(
        "reading.*", *[F.col("version")[c].alias(c) for c in added]
    )
    unusable = readings.filter(~F.coalesce(usable, F.lit(False)))
    return joined.unionByName(unusable, allowMissingColumns=True)
