"""A versioned dimension kept up from a feed that comes in any order.

Versions alone do not say when a state was seen again, which decides where a late
row's version ends. So the root holds, committed together: ``observations``, what
was seen, in parts by day; ``starts``, where versions begin, in parts by day; and
``spans``, when each key was first and last seen, in buckets of keys. A load
reads and writes the days it has rows for, and looks beyond them only for the
nearest observation on either side.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.operators.scd2 import close_versions
from kerbside.sources import versions
from kerbside.sources.sinks import gather
from kerbside.sources.versions import PART, parted

OBSERVATIONS, STARTS, SPANS = "observations", "starts", "spans"
BUCKETS = 16


def _bucket() -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows to join by a shuffle: those of a load compress so well in files that
    Spark takes them for small and sends them whole through the driver."""
    return rows.hint("merge")


def settled(rows: DataFrame) -> DataFrame:
    """One state per key and instant: the greatest of those observed."""
    return rows.groupBy("key", "at").agg(F.max("state").alias("state"))


class FeedLoad:
    """One load of feed rows into a root."""

    def __init__(self, spark: SparkSession, root: str, feed: DataFrame):
        self.spark, self.root, self.load = spark, root, versions.new_load()
        self.live = versions.live(spark, root)
        by_day = parted(feed.schema, T.DateType()), F.to_date("at")
        self.kinds = {OBSERVATIONS: by_day, STARTS: by_day}
        spans = feed.groupBy("key").agg(F.min("at").alias("first"), F.max("at").alias("last"))
        self.kinds[SPANS] = (parted(spans.schema, T.IntegerType()), _bucket())
        # The rows are stored first: they are asked for their days, then used.
        self.fresh = versions.new_load()
        self._store(self.fresh, OBSERVATIONS, settled(feed))
        self._store(self.fresh, SPANS, spans)
        self.days = self._parts(self.fresh, OBSERVATIONS)

    def _store(self, load: str, name: str, rows: DataFrame) -> None:
        part = self.kinds[name][1]
        laid = gather(rows.withColumn(PART, part), PART).drop(PART)
        versions.write(laid, self.root, load, name, part)

    def _parts(self, load: str, name: str) -> list[str]:
        return versions.written_parts(self.spark, self.root, load, name, self.kinds[name][0])

    def _written(self, load: str, name: str) -> DataFrame:
        return versions.read_load(self.spark, self.root, load, name, self.kinds[name][0])

    def _stored(self, name: str, parts: list[str]) -> DataFrame:
        if not self.live:
            return self.spark.createDataFrame([], self.kinds[name][0])
        return versions.read(self.spark, self.root, name, parts, self.live)

    def merge_observations(self) -> None:
        new = self._written(self.fresh, OBSERVATIONS).unionByName(
            self._stored(OBSERVATIONS, self.days)
        )
        self._store(self.load, OBSERVATIONS, settled(new.drop(PART)))
        spans = self._written(self.fresh, SPANS).unionByName(
            self._stored(SPANS, self._parts(self.fresh, SPANS))
        )
        merged = spans.groupBy("key").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        self._store(self.load, SPANS, merged)

    def nearest(self, touched: DataFrame, before: bool) -> DataFrame:
        """(key, day, near): the last observation before each touched day of a
        key, or the first after it, for those that have one.

        Days are searched outward in windows that grow fourfold, for the keys not yet
        found; a feed that reports daily is done after the first.
        """
        spans = self._written(self.load, SPANS)
        beyond = F.col("first") < F.col("day") if before else F.to_date("last") > F.col("day")
        waiting = touched.join(_dealt(spans), "key").filter(beyond).select("key", "day")
        stored = [r.part for r in self.live if r.name == OBSERVATIONS and r.part is not None]
        every = sorted({*stored, *self.days})
        side = "before" if before else "after"
        waiting = self._kept(waiting, f"waiting-{side}-0")
        own, found, width = set(self.days), None, 1
        while not waiting.isEmpty():
            wanted = self._window(every, width, before)
            seen = self._stored(OBSERVATIONS, [p for p in wanted if p not in own])
            changed = self._written(self.load, OBSERVATIONS)
            changed = changed.filter(F.col(PART).cast("string").isin([*own.intersection(wanted)]))
            seen = seen.unionByName(changed)
            gap = F.date_diff("day", PART) if before else F.date_diff(PART, F.col("day"))
            hit = _dealt(waiting).join(seen, "key").filter(gap.between(1, width))
            pick = F.max if before else F.min
            near = hit.groupBy("key", "day").agg(pick(F.struct("at", "state")).alias("near"))
            near = self._kept(near, f"near-{side}-{width}")
            found = near if found is None else found.unionByName(near)
            waiting = waiting.join(_dealt(near), ["key", "day"], "left_anti")
            waiting = self._kept(waiting, f"waiting-{side}-{width}")
            width *= 4
        if found is None:
            near = f"struct<at:timestamp,state:{self._state_type()}>"
            found = touched.limit(0).withColumn("near", F.lit(None).cast(near))
        return found

    def _state_type(self) -> str:
        return self.kinds[OBSERVATIONS][0]["state"].dataType.simpleString()

    def _window(self, every: list[str], width: int, before: bool) -> list[str]:
        """Parts that lie up to ``width`` days beside a touched one."""
        wanted = set()
        for text in self.days:
            day = date.fromisoformat(text)
            ends = (day - timedelta(width), day) if before else (day, day + timedelta(width))
            low, high = (e.isoformat() for e in ends)
            wanted.update(p for p in every if low <= p <= high and p != text)
        return sorted(wanted)

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        """Stored within the fresh load, which goes when all is done."""
        path = f"{self.root}/data/{versions.LOAD}={self.fresh}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def merge_starts(self) -> None:
        touched = self._written(self.fresh, OBSERVATIONS).select("key", F.col(PART).alias("day"))
        touched = self._kept(touched.distinct(), "touched")
        earlier = self.nearest(touched, before=True).select("key", "day", F.col("near.state").alias("was"))
        later = self.nearest(touched, before=False)

        day = Window.partitionBy("key", "day").orderBy("at")
        rows = (
            self._written(self.load, OBSERVATIONS)
            .withColumnRenamed(PART, "day")
            .join(_dealt(touched), ["key", "day"], "left_semi")
            .join(_dealt(earlier.withColumn("known", F.lit(True))), ["key", "day"], "left")
            .withColumn("first", F.row_number().over(day) == 1)
            .withColumn("previous", F.lag("state").over(day))
        )
        begins = F.when(
            F.col("first"), F.col("known").isNull() | ~F.col("state").eqNullSafe(F.col("was"))
        ).otherwise(~F.col("state").eqNullSafe(F.col("previous")))
        computed = rows.filter(begins).select("key", "at", "state")

        # The next observation begins a version, or does so no longer, by what
        # its key's day now ends with; on a touched day that is settled above.
        ends = rows.groupBy("key", "day").agg(F.max_by("state", "at").alias("ended"))
        edge = (
            later.join(_dealt(ends), ["key", "day"])
            .select("key", "near.*", "ended", F.to_date("near.at").alias("day"))
            .join(_dealt(touched), ["key", "day"], "left_anti")
        )
        edge = self._kept(edge, "edges")
        resumed = edge.filter(~F.col("state").eqNullSafe(F.col("ended"))).select(
            "key", "at", "state"
        )
        days = [r[0] for r in edge.select(F.col("day").cast("string")).distinct().collect()]
        kept = (
            self._stored(STARTS, sorted({*self.days, *days}))
            .withColumnRenamed(PART, "day")
            .join(_dealt(touched), ["key", "day"], "left_anti")
            .join(_dealt(edge.select("key", "at")), ["key", "at"], "left_anti")
            .select("key", "at", "state")
        )
        self._store(self.load, STARTS, kept.unionByName(computed).unionByName(resumed))

    def commit(self) -> None:
        schemas = {name: schema for name, (schema, _) in self.kinds.items()}
        versions.commit(self.spark, self.root, self.load, schemas)
        versions.discard(self.spark, self.root, self.fresh)


def add_observations(
    spark: SparkSession,
    root: str,
    feed: DataFrame,
    attributes: list[str],
    key: str = "location_id",
    ts: str = "observed_ts",
) -> None:
    """Feed rows into the root, in whatever order they arrive; repeating a load
    changes nothing. Rows without key or time are left out."""
    usable = feed.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("key"), F.col(ts).alias("at"), F.struct(*attributes).alias("state")
    )
    load = FeedLoad(spark, root, usable)
    if not load.days:
        return versions.discard(spark, root, load.fresh)
    load.merge_observations()
    load.merge_starts()
    load.commit()


def read_versions(
    spark: SparkSession,
    root: str,
    attributes: list[str],
    key: str = "location_id",
) -> DataFrame:
    """The versions as ``build_versions`` gives them for the feed so far."""
    starts = versions.read(spark, root, STARTS).select(
        F.col("key").alias(key), F.col("at").alias("valid_from"), "state"
    )
    return close_versions(starts, attributes, key)
