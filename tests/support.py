"""Comparing a query with its SQL: rows as sorted text, columns by name."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v) -> str:
    if v is None:
        return "\\N"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(value, v)) + "]"
    return str(v)


def lines(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("\t".join(value(r[i]) for i in order) for r in rows)


def spark_lines(df) -> tuple[list[str], list[str]]:
    return sorted(df.columns), lines(df.columns, df.collect())


def duckdb_over(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def duckdb_lines(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[str]]:
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), lines(columns, cur.fetchall())
