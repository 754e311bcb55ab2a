"""Comparison of a query with its SQL by value, whatever the order of rows and columns."""

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda x: None if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x) else round(float(x), 6) if isinstance(x, float) else str(x))
    return sorted(map(repr, df.astype(object).itertuples(index=False, name=None)))


def sql_rows(sql: str, directory: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    for f in os.listdir(directory):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{directory}/{f}'")
    return con.execute(sql).df()
