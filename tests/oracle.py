"""Comparing a query with its SQL twin."""

import glob
import numbers
import os

import duckdb
import numpy as np
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def connection(folder=SMALL):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(v):
    """Text of a value; numbers alike whether or not a null made their column a float one."""
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return ""
    return f"{float(v):.6f}" if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


def compare(spark, query, sql, con, folder=SMALL):
    got, want = query(spark, folder).toPandas(), con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
