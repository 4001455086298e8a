"""Ordered computations over a key that may hold a large share of all rows.

A window over such a key is one task's work. Here a key's history is cut into
calendar chunks: windows run per (key, chunk), and what a chunk needs to know
of its neighbours travels in a summary of one row per chunk. The summary is
aggregated map-side and a key has at most one row per chunk in it, so the
windows over it are bounded by the calendar, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "chunk_start"


def with_chunk(df: DataFrame, ts: Column | str, unit: str) -> DataFrame:
    return df.withColumn(CHUNK, F.date_trunc(unit, ts))


def in_chunk(keys: list[str]) -> Window:
    return Window.partitionBy(*keys, CHUNK)


def summarise(df: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    return df.groupBy(*keys, CHUNK).agg(*[v.alias(name) for name, v in values.items()])


def neighbours(summary: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """Per chunk, values computed over the key's other chunks in time order."""
    return summary.select(*keys, CHUNK, *[v.alias(name) for name, v in values.items()])


def chunk_order(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(CHUNK)


def carry(df: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the carried values to every row of their chunk.

    Both sides are grouped by (key, chunk) already, and keys are never NULL. The
    carried rows grow with the data, so they are never sent whole to all machines.
    """
    return df.join(carried.hint("merge"), [*keys, CHUNK], "left")
