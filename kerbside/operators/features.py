"""Forecast features over the hourly fact.

A series is one sensor's hours in order. At the fact's grain a sensor has at
most one row per local hour, 24 a day, however many raw readings it sent, so a
window per sensor is bounded by the length of the calendar. For frames that do
not keep that grain, ``chunk`` cuts a series into calendar pieces with equal
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.columns import cyclic, hour_index
from kerbside.operators.chunks import CHUNK, carry, chunk_order, in_chunk, neighbours, summarise
from kerbside.operators.chunks import with_chunk
from kerbside.schemas import LAG_HOURS, ROLLING_WINDOWS, TARGET_COLUMN, feature_columns

SERIES_KEY = "sensor_key"
SERIES_ORDER = ["date_key", "event_hour"]
COUNT = "pedestrian_count"


def series() -> Window:
    return Window.partitionBy(SERIES_KEY).orderBy(*SERIES_ORDER)


def with_sensor(df: DataFrame) -> DataFrame:
    """Rows of no known sensor belong to no series."""
    return df.filter(F.col(SERIES_KEY).isNotNull())


def add_time_features(df: DataFrame) -> DataFrame:
    hour_sin, hour_cos = cyclic("event_hour", 24)
    dow_sin, dow_cos = cyclic("day_of_week", 7)
    return df.withColumns(
        {
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "dow_sin": dow_sin,
            "dow_cos": dow_cos,
            "is_weekend": F.col("is_weekend").cast("int"),
        }
    )


def _rolling_mean(frame: Window, width: int) -> Column:
    """Mean over a frame, NULL unless every one of its hours has a count."""
    return F.when(F.count(COUNT).over(frame) == width, F.avg(COUNT).over(frame))


def add_lag_features(
    df: DataFrame, calendar: bool = False, chunk: str | None = None
) -> DataFrame:
    """Earlier counts of the same sensor and means over past hours only.

    A lag of n is the n-th row before, as upstream has it. With ``calendar`` it
    is the count exactly n clock hours before, NULL across a gap.
    """
    df = with_sensor(df)
    if chunk is not None:
        if calendar:
            raise ValueError("calendar lags and chunks cannot be combined")
        return _chunked_lags(df, chunk)
    if calendar:
        clock = Window.partitionBy(SERIES_KEY).orderBy(hour_index("date_key", "event_hour"))
        lags = {f"lag_{n}h": F.max(COUNT).over(clock.rangeBetween(-n, -n)) for n in LAG_HOURS}
        means = {
            f"roll_mean_{w}h": _rolling_mean(clock.rangeBetween(-w, -1), w)
            for w in ROLLING_WINDOWS
        }
    else:
        lags = {f"lag_{n}h": F.lag(COUNT, n).over(series()) for n in LAG_HOURS}
        means = {
            f"roll_mean_{w}h": _rolling_mean(series().rowsBetween(-w, -1), w)
            for w in ROLLING_WINDOWS
        }
    return df.withColumns({**lags, **means})


def add_target(df: DataFrame, calendar: bool = False) -> DataFrame:
    """The next row's count, or with ``calendar`` that of the next clock hour."""
    if calendar:
        clock = Window.partitionBy(SERIES_KEY).orderBy(hour_index("date_key", "event_hour"))
        following = F.max(COUNT).over(clock.rangeBetween(1, 1))
    else:
        following = F.lead(COUNT, 1).over(series())
    return with_sensor(df).withColumn(TARGET_COLUMN, following)


def complete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=[*feature_columns(), TARGET_COLUMN])


def build_features(
    facts: DataFrame, calendar: bool = False, chunk: str | None = None
) -> DataFrame:
    """Facts with all features and the target; incomplete rows are dropped."""
    featured = add_time_features(facts).transform(add_lag_features, calendar, chunk)
    if chunk is None:
        featured = add_target(featured, calendar)
    return complete_rows(featured)


def _chunked_lags(df: DataFrame, unit: str) -> DataFrame:
    """Row lags, means and target with windows per sensor and calendar chunk.

    A chunk's first rows look back into a carried list of the latest counts
    before it. Each chunk that exists holds a row at least, so the ``reach``
    latest counts lie within the ``reach`` chunks before.
    """
    keys, reach = [SERIES_KEY], max(LAG_HOURS)
    df = with_chunk(df, F.col("date_key").cast("timestamp"), unit)
    in_time = in_chunk(keys).orderBy(*SERIES_ORDER)
    newest_first = in_chunk(keys).orderBy(*[F.col(c).desc() for c in SERIES_ORDER])

    entry = F.struct(*SERIES_ORDER, COUNT)
    tails = (
        df.select(SERIES_KEY, CHUNK, *SERIES_ORDER, COUNT)
        .withColumn("from_end", F.row_number().over(newest_first))
        .filter(F.col("from_end") <= reach)
        .transform(summarise, keys, tail=F.sort_array(F.collect_list(entry), asc=False))
    )
    heads = summarise(df, keys, head=F.min(entry))
    order = chunk_order(keys)
    recent = F.flatten(F.collect_list("tail").over(order.rowsBetween(-reach, -1)))
    latest = F.slice(F.sort_array(recent, asc=False), 1, reach)
    carried = neighbours(
        tails.join(heads, [*keys, CHUNK]),
        keys,
        counts_before=F.transform(latest, lambda e: e[COUNT]),
        head_after=F.lead("head").over(order),
    )

    numbered = carry(
        df.withColumns(
            {
                "position": F.row_number().over(in_time),
                "following": F.lead(F.struct(COUNT)).over(in_time),
                **{f"back_{n}": F.lag(COUNT, n).over(in_time) for n in _needed_lags()},
            }
        ),
        carried,
        keys,
    )

    def back(n: int) -> Column:
        before_chunk = F.get("counts_before", F.lit(n) - F.col("position"))
        return F.when(F.col("position") > n, F.col(f"back_{n}")).otherwise(before_chunk)

    def mean(width: int) -> Column:
        # NULL as soon as one term is: the window has to be full.
        total = sum((back(n) for n in range(2, width + 1)), back(1))
        return total.cast("double") / F.lit(width)

    following = F.coalesce(F.col("following"), F.struct(F.col(f"head_after.{COUNT}")))
    return numbered.withColumns(
        {
            **{f"lag_{n}h": back(n) for n in LAG_HOURS},
            **{f"roll_mean_{w}h": mean(w) for w in ROLLING_WINDOWS},
            TARGET_COLUMN: following[COUNT],
        }
    ).drop(
        CHUNK,
        "position",
        "following",
        "counts_before",
        "head_after",
        *[f"back_{n}" for n in _needed_lags()],
    )


def _needed_lags() -> list[int]:
    return sorted({*LAG_HOURS, *range(1, max(ROLLING_WINDOWS) + 1)})
