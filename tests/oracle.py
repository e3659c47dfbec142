"""Compares a query with its DuckDB oracle as multisets of rows."""

import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}"
        con.execute(f"create view {name.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows_of(spark_df):
    cols = sorted(spark_df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in spark_df.collect()), key=repr)


def oracle_rows(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)
