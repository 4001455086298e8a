"""Runs registered queries next to their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

KINDS = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "integer": "int32",
    "bigint": "int64", "double": "float64", "string": "text", "varchar": "text",
    "boolean": "bool", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp",
}


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def spark_rows(df) -> tuple[dict[str, str], Counter]:
    names = sorted(df.columns)
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), "?") for f in df.schema.fields}
    rows = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    return {n: kinds[n] for n in names}, rows


def duck_rows(con, sql: str) -> tuple[dict[str, str], Counter]:
    result = con.execute(sql)
    columns = [(d[0], str(d[1]).lower()) for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i][0])
    rows = Counter(tuple(_plain(r[i]) for i in order) for r in result.fetchall())
    return {columns[i][0]: KINDS.get(columns[i][1], columns[i][1]) for i in order}, rows


def differences(df, con, sql: str) -> list[str]:
    """What differs, in words; empty when the results agree."""
    spark_kinds, left = spark_rows(df)
    duck_kinds, right = duck_rows(con, sql)
    found = []
    if spark_kinds != duck_kinds:
        found.append(f"columns: spark {spark_kinds} sql {duck_kinds}")
    if left != right:
        found.append(f"rows: spark {left.total()} sql {right.total()}")
        found.append(f"only spark: {list((left - right).items())[:3]}")
        found.append(f"only sql: {list((right - left).items())[:3]}")
    return found


def main(folder: str, names: list[str]) -> None:
    import __spark_entry__ as entry
    from kerbside.session import build_session

    spark = build_session(
        "compare",
        **{
            "spark.master": "local[8]",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(folder), entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            if name in sqls:
                found = differences(fn(spark, folder), con, sqls[name])
            else:
                print("   rows only:", fn(spark, folder).limit(3).collect())
                found = []
        except Exception as error:  # noqa: BLE001
            found = [repr(error)[:1500]]
        print(f"{'ok  ' if not found else 'DIFF'} {name} {time.time() - began:.1f}s", flush=True)
        for line in found:
            print("    ", line[:1500])


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
