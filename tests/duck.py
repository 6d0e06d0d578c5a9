"""Compares a DataFrame with DuckDB's rows for a SQL text."""

import decimal
import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.sql(f"create view {name} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def rows_of_sql(con, sql):
    r = con.sql(sql)
    columns = sorted(r.columns)
    at = [r.columns.index(c) for c in columns]
    return columns, sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())
