"""Comparison of a query's rows with SQL run by DuckDB over the same tables."""

import glob
import math
import os

import duckdb


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return str(round(float(v), 5) + 0.0)
    return str(v)


def rows_of_sql(sql, folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return names, got.fetchall()


def same_rows(df, sql, folder):
    names, expected = rows_of_sql(sql, folder)
    cols = sorted(names)
    assert sorted(df.columns) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in expected)
    have = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert have == want
