"""Comparison of a query with its SQL counterpart in DuckDB."""

import glob
import numbers
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    plain = lambda v: float(v) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)
    return cols, sorted(tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False))
