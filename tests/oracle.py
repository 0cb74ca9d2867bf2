"""Comparison of a query with its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    if hasattr(v, "year"):
        return str(v)[:10]
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(_cell, r)) for r in frame[columns].itertuples(index=False))


def assert_same(query, sql, spark, data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = rows(query(spark, data).toPandas()), rows(con.execute(sql).df())
    assert got == want
