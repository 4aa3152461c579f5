"""Run a registered query and its SQL on one folder and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    """One spelling for a value, whichever engine it came from."""
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


TYPE_NAMES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz",
}


def compare(spark, con, build, sql: str, folder: str) -> str | None:
    """None when both give the same columns, types and rows, else what differs."""
    df = build(spark, folder)
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {d[0]: TYPE_NAMES.get(str(d[1]), str(d[1])) for d in cursor.description}
    mine = {f.name: f.dataType.simpleString() for f in df.schema}
    if kinds != mine:
        return f"types {set(mine.items()) ^ set(kinds.items())}"
    if got != want:
        extra, lost = got - want, want - got
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}; "
            f"only here {[str(r)[:400] for r in list(extra)[:2]]}; only there {[str(r)[:400] for r in list(lost)[:2]]}"
        )
    return None
