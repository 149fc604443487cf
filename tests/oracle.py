"""Comparing a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from glob import glob

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def rows(columns: list[str], data) -> list[tuple]:
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(df, sql: str, sf_dir: str) -> None:
    c = tables(sf_dir).execute(sql)
    columns = [d[0] for d in c.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, c.fetchall())
