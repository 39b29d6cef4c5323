"""Borrow rates from volatility ranks, their sources in order, concentration of a short book."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import step_schedule
from ..functions.windows import pct_rank_avg, rolling

#: Annual rate up to each percentile of same-date volatility; an unknown one counts as general collateral, the first. Fixed values.
SCHEDULE = [(0.80, 0.005), (0.90, 0.015), (0.95, 0.03), (0.99, 0.08), (1.00, 0.20)]


def realised_volatility(panel: DataFrame, n: int = 63) -> DataFrame:
    """Annualised deviation of daily returns; needs a quarter of the window, five at least."""
    return panel.withColumn("rv", rolling(F.stddev_samp, F.col("ret_1d"), n, least=max(5, n // 4)) * 252**0.5)


def estimated_rates(panel: DataFrame, schedule=SCHEDULE) -> DataFrame:
    return panel.withColumn("rate", step_schedule(pct_rank_avg(F.col("rv"), "date"), schedule))


def resolve_rates(panel: DataFrame, flat: float, supplied: DataFrame | None = None, column: str | None = None, proxy: bool = False) -> DataFrame:
    """Rates from the first source given: a table, a panel column, the volatility proxy; gaps and no source take the flat rate."""
    if supplied is not None:
        rates = panel.select("date", "ticker").join(supplied.select("date", "ticker", "rate"), ["date", "ticker"], "left")
    elif column is not None:
        rates = panel.select("date", "ticker", F.col(column).alias("rate"))
    elif proxy:
        rates = estimated_rates(panel).select("date", "ticker", "rate")
    else:
        rates = panel.select("date", "ticker", F.lit(None).cast("double").alias("rate"))
    return rates.withColumn("rate", F.coalesce("rate", F.lit(flat)))


def concentration(shorts: DataFrame, rates: DataFrame) -> DataFrame:
    """Mean rate of the short names, of all names, and their ratio."""
    held = shorts.select("date", "ticker").distinct().withColumn("_s", F.lit(1))
    j = rates.join(held, ["date", "ticker"], "left")
    return j.agg(F.avg(F.when(F.col("_s") == 1, F.col("rate"))).alias("short_rate"), F.avg("rate").alias("all_rate")).withColumn("ratio", F.try_divide("short_rate", "all_rate"))
