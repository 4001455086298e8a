"""Plain writers, layouts and folder helpers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything to read in this folder?"""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def _file_system(spark: SparkSession, path: str):
    """Spark's own interface can neither delete nor list folders."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    files, target = _file_system(spark, path)
    if not files.exists(target):
        return []
    return [status.getPath().getName() for status in files.listStatus(target)]


def gather(df: DataFrame, *partition_columns: str) -> DataFrame:
    """Few files per partition value: ``rebalance`` brings a value's rows
    together and, at run time, splits a value with far more rows than the rest."""
    return df.hint("rebalance", *partition_columns)


def write_table(df: DataFrame, path: str) -> None:
    """A whole table, replaced at once."""
    df.write.mode("overwrite").parquet(path)


def in_silver_layout(silver: DataFrame, *before: str) -> DataFrame:
    """Rows in date, sensor, minute order, in ranges of equal size.

    A range holds one date or few, so few files come of each date however large
    one date or sensor is; a sensor's hour stays together, which lets the hourly
    sums shrink sixtyfold before their shuffle and readers skip by sensor. The
    key comes last: it splits ranges where all else is alike.
    """
    order = [*before, "location_id", "event_ts_utc", "dedupe_key"]
    return silver.repartitionByRange(*order).sortWithinPartitions(*order)


def register_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def write_json(df: DataFrame, path: str, **options: str) -> None:
    df.write.mode("overwrite").options(**options).json(path)
