"""Runs a query's SQL in DuckDB and compares rows, whatever their order."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connect(folder: str = DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if v != v else int(v) if v == int(v) else round(v, 9)
    if isinstance(v, list | np.ndarray):
        return tuple(plain(x) for x in v)
    return plain(v.item()) if hasattr(v, "item") else v


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


def check(spark, query, sql: str, con, folder: str = DATA) -> None:
    got, want = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
