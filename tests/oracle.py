"""Runs a query's SQL in DuckDB and compares it with Spark's rows, whatever their order."""

import os

import duckdb
import numpy as np


def connect(sf):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v) or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return f"{float(v):.9g}"
    return str(v)


def rows_of(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(tuple(plain(x) for x in r) for r in pdf[columns].itertuples(index=False))
