"""Runs a query and its SQL over one data folder and compares the rows."""

import math
import os
from collections import Counter

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "dtype") or isinstance(v, (int, float)):
        return round(float(v), 6)
    return str(v)


def rows(df):
    return Counter(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def compare(spark, folder, make, sql):
    ours, theirs = make(spark, folder).toPandas(), connect(folder).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
