"""Runs a query and its SQL side by side."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [None if pd.isna(v) else round(float(v), 9) if isinstance(v, float) else str(v) for v in df[c]]
    return sorted(map(repr, df.itertuples(index=False, name=None)))
