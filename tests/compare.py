"""Run registered queries beside their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
import time

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return value if value == value else "nan"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr
    )


def spark_result(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_result(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def check(spark, folder, name, query, sql, con):
    start = time.time()
    df = query(spark, folder)
    cols, rows = spark_result(df)
    took = time.time() - start
    if sql is None:
        return True, len(rows), took, "rows only"
    ocols, orows = duck_result(con, sql)
    if cols != ocols:
        return False, len(rows), took, f"columns {cols} != {ocols}"
    if rows != orows:
        mine, theirs = set(map(repr, rows)), set(map(repr, orows))
        diff, odiff = sorted(mine - theirs)[:3], sorted(theirs - mine)[:3]
        return False, len(rows), took, f"{len(rows)} vs {len(orows)} rows; spark {diff} duckdb {odiff}"
    return True, len(rows), took, "equal"
