"""Schemas of the tables, and checks of columns when a plan is made."""

from __future__ import annotations

from pyspark.sql import DataFrame

BARS = "date date, ticker bigint, adj_close double, volume double"
SCORED = "date date, ticker bigint, prob double, adj_close double, fwd_ret double"
STINTS = "ticker string, start_date string, end_date string"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
