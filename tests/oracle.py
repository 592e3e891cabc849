"""Comparison of a Spark result with DuckDB's, order aside."""

import glob
import os

import duckdb


def _plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == v // 1 and abs(v) < 2**53 else f"{v:.9g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def rows(frame, columns):
    import pandas as pd

    return sorted(tuple("null" if v is pd.NA or v is pd.NaT else _plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


def same(df, sql, sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.execute(sql).df()
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
