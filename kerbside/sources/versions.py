"""Tables that change all at once: data in folders by load, readers led by commits.

A root holds the tables of one job. Each load writes its rows below
``data/load_of=<load>/table_of=<name>/part_of=<part>`` and touches nothing that
readers use. It counts from the moment its commit appears: one small file with a
row for each part the load replaces, put in place by one rename. A reader takes,
for every part, the load of the newest commit. So readers see all tables of a
root as one commit left them, and a job that dies leaves only folders that no
commit names; doing it again is the repair. One writer a root is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.sources.sinks import children, gather, remove

LOAD, TABLE, PART = "load_of", "table_of", "part_of"
NULL_PART = "__HIVE_DEFAULT_PARTITION__"  # fixed value: how Spark names a folder of NULLs
# A commit that is full forgets the parts of earlier ones. A table without rows
# has a row without part, and a part that is gone one without load.
COMMIT = "version bigint, full boolean, name string, part string, load string, columns string"


def new_load() -> str:
    return f"l{uuid.uuid4().hex}"


def commits(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(COMMIT).json(f"{root}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def live(spark: SparkSession, root: str, version: int | None = None) -> list[Row]:
    """(name, part, load, columns) of all parts, now or as of a version."""
    log = commits(spark, root)
    if version is not None:
        log = log.filter(F.col("version") <= version)
    since = log.groupBy("name").agg(F.max(F.when(F.col("full"), F.col("version"))).alias("since"))
    newest = F.max_by(F.struct("load", "columns"), "version").alias("newest")
    parts = (
        log.join(since, "name")
        .filter(F.col("since").isNull() | (F.col("version") >= F.col("since")))
        .groupBy("name", "part")
        .agg(newest)
        .select("name", "part", "newest.*")
    )
    return [r for r in parts.collect() if r.load is not None or r.part is None]


def exists(spark: SparkSession, root: str, name: str) -> bool:
    return not commits(spark, root).filter(F.col("name") == name).isEmpty()


def _folder(root: str, load: str, name: str) -> str:
    return f"{root}/data/{LOAD}={load}/{TABLE}={name}"


def read(
    spark: SparkSession,
    root: str,
    name: str,
    parts: Iterable[str] | None = None,
    resolved: list[Row] | None = None,
) -> DataFrame:
    """A table as its newest commit left it, the part as its last column.

    Only folders of live parts are listed, with ``parts`` only those among them.
    The schema is the committed one; nothing is inferred. ``resolved`` is what
    :func:`live` has returned, for jobs that read several times.
    """
    rows = [r for r in resolved or live(spark, root) if r.name == name]
    if not rows:
        raise ValueError(f"no version of {name} in {root}")
    schema = T.StructType.fromDDL(rows[0]["columns"])
    wanted = None if parts is None else set(parts)
    folders = [
        f"{_folder(root, r.load, name)}/{PART}={r.part}"
        for r in rows
        if r.part is not None and (wanted is None or r.part in wanted)
    ]
    if not folders:
        return spark.createDataFrame([], schema)
    return read_folders(spark, root, schema, folders)


def read_folders(
    spark: SparkSession, root: str, schema: T.StructType, folders: list[str]
) -> DataFrame:
    reader = spark.read.schema(schema).option("basePath", f"{root}/data")
    return reader.parquet(*folders).select(*schema.fieldNames())


def read_load(
    spark: SparkSession, root: str, load: str, name: str, schema: T.StructType
) -> DataFrame:
    """What one load has written of a table, committed or not."""
    return read_folders(spark, root, schema, [_folder(root, load, name)])


def write(df: DataFrame, root: str, load: str, name: str, part: Column | None = None) -> None:
    """Rows of a table into a load; a table without parts has one, ``all``."""
    parted = df.withColumn(PART, F.lit("all") if part is None else part)
    parted.write.mode("overwrite").partitionBy(PART).parquet(_folder(root, load, name))


def write_tables(df: DataFrame, root: str, load: str) -> None:
    """Rows of several tables at once, told apart by ``table_of`` and ``part_of``."""
    df.write.mode("overwrite").partitionBy(TABLE, PART).parquet(f"{root}/data/{LOAD}={load}")


def written_parts(
    spark: SparkSession, root: str, load: str, name: str, schema: T.StructType
) -> list[str]:
    """The parts a load holds of a table: file footers are read, no columns."""
    try:
        rows = read_load(spark, root, load, name, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    text = F.coalesce(F.col(PART).cast("string"), F.lit(NULL_PART))
    return [r[0] for r in rows.select(text).distinct().collect()]


def commit(
    spark: SparkSession,
    root: str,
    load: str,
    schemas: dict[str, T.StructType],
    full: bool = False,
) -> int:
    """Make a load's parts of the named tables the current ones, all at once.

    With ``full`` the tables consist of this load alone; else parts that the
    load does not have stay as they are.
    """
    rows: list[tuple] = []
    version = (commits(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    for name, schema in schemas.items():
        parts = written_parts(spark, root, load, name, schema)
        columns = schema.toDDL()
        rows += [(version, full, name, part, load, columns) for part in parts]
        if not parts and (full or not exists(spark, root, name)):
            rows.append((version, full, name, None, None, columns))
    if rows:
        _append(spark, root, rows)
    return version


def _append(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    """One commit, in one file: it is there or it is not."""
    log = spark.createDataFrame(rows, COMMIT).coalesce(1)
    log.write.mode("append").json(f"{root}/commits")


def parted(schema: T.StructType, kind: T.DataType) -> T.StructType:
    """A table's columns and, last, its part of the given type."""
    fields = [T.StructField(f.name, f.dataType) for f in schema.fields]
    return T.StructType([*fields, T.StructField(PART, kind)])


def discard(spark: SparkSession, root: str, load: str) -> None:
    """Deletes a load that was only a step on the way to another."""
    remove(spark, f"{root}/data/{LOAD}={load}")


def merge(
    new: DataFrame,
    root: str,
    name: str,
    part: Column,
    combine: Callable[[DataFrame, DataFrame], DataFrame],
) -> int:
    """Combine new rows with the stored ones of their parts, and commit these.

    ``combine`` gets new and stored rows and returns all rows of the parts that
    the new ones lie in. Other parts are neither read nor written. The new rows
    are written first, since they are asked for their parts before they are used.
    """
    spark = new.sparkSession
    marked = new.withColumn(PART, part)
    schema = parted(new.schema, marked.schema[PART].dataType)
    fresh, load = new_load(), new_load()
    write(new, root, fresh, name, part)
    parts = written_parts(spark, root, fresh, name, schema)
    if parts:
        rows = read_load(spark, root, fresh, name, schema).drop(PART)
        if exists(spark, root, name):
            rows = combine(rows, read(spark, root, name, parts).drop(PART))
        write(gather(rows.withColumn(PART, part), PART).drop(PART), root, load, name, part)
    version = commit(spark, root, load, {name: schema})
    discard(spark, root, fresh)
    return version


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes parts that none of the newest ``keep`` versions uses, and what no
    commit names: loads that died, working tables of others. Gathers the log of
    commits into one full commit; returns the number of parts and tables deleted.

    Readers that resolved one of those versions finish undisturbed; one that
    reads the log just now may have to do so again. The writer runs it, between
    loads: a load that is under way is named by no commit either.
    """
    log = commits(spark, root)
    latest = log.agg(F.max("version")).first()[0]
    if latest is None:
        return 0
    used = {
        (r.name, r.part, r.load)
        for v in range(max(1, latest - keep + 1), latest + 1)
        for r in live(spark, root, v)
    }
    every = log.filter(F.col("load").isNotNull()).select("name", "part", "load").distinct().collect()
    dead = [tuple(r) for r in every if tuple(r) not in used]
    files = [r[0] for r in log.select("_metadata.file_path").distinct().collect()]
    rows = [(latest + 1, True, r.name, r.part, r.load, r["columns"]) for r in live(spark, root)]
    _append(spark, root, rows)
    for name, part, load in dead:
        remove(spark, f"{_folder(root, load, name)}/{PART}={part}")
    for file in files:
        remove(spark, file)
    in_use = {_folder(root, load, name) for name, _, load in used if load is not None}
    named = {_folder(root, r["load"], r["name"]) for r in every}
    unused = [
        folder
        for load in children(spark, f"{root}/data")
        for table in children(spark, f"{root}/data/{load}")
        if (folder := f"{root}/data/{load}/{table}") not in in_use and table.startswith(f"{TABLE}=")
    ]
    for folder in unused:
        remove(spark, folder)
    return len(dead) + len(set(unused) - named)
