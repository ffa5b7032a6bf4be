"""Runs a query in Spark and its SQL in DuckDB, and compares the rows."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def same(spark_df, sql, con):
    a, b = spark_df.toPandas(), con.execute(sql).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        bad = [(x, y) for x, y in zip(a[c], b[c]) if not ((pd.isna(x) and pd.isna(y)) or (not pd.isna(x) and not pd.isna(y) and x == y))]
        assert not bad, (c, bad[:3])
