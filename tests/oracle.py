"""Comparison of a query's rows with its DuckDB SQL."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer, float, np.floating, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (datetime.datetime, pd.Timestamp)):
        return str(v)[:19]
    return v


def spark_rows(df) -> list:
    columns = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)


def sql_rows(sql: str, sf_dir: str, columns: list[str]) -> list:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=str)
