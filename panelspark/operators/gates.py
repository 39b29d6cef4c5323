"""Checks that fail inside the plan: rows pass through, and a one-row aggregate beside them raises if it is bad.

The check is a branch of a union that never has a row. It runs in the same job as the rows, needs no join, and no action while the
plan is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def gated(rows: DataFrame, facts: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """``rows``, unless ``ok`` is not true of a row of ``facts`` (one row, an aggregate)."""
    message = F.lit(message) if isinstance(message, str) else message
    never = F.when(F.coalesce(ok, F.lit(False)), F.lit(False)).otherwise(F.raise_error(message).cast("boolean"))
    return rows.unionByName(facts.where(never).select(*(F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes)))


def not_empty(rows: DataFrame, message: str) -> DataFrame:
    return gated(rows, rows.limit(1).agg(F.count("*").alias("n")), F.col("n") > 0, message)


def two_dates(scored: DataFrame) -> DataFrame:
    """A panel of one date has no return to measure."""
    return gated(scored, scored.agg(F.min("date").alias("a"), F.max("date").alias("b")), F.col("a") < F.col("b"), "a scored panel needs two dates at least")


def coverage_by_cohort(requested: DataFrame, bars: DataFrame, active: DataFrame) -> DataFrame:
    """cohort, n_requested, n_covered, coverage of current members, of departed ones, and of all requested tickers."""
    has = bars.groupBy("ticker").agg(F.count("adj_close").alias("_n"))
    now = active.select("ticker").distinct().withColumn("_now", F.lit(True))
    rows = requested.select("ticker").distinct().join(has, "ticker", "left").join(now, "ticker", "left")
    cohorts = F.explode(F.array(F.lit("all"), F.when(F.col("_now"), "current").otherwise("departed"))).alias("cohort")
    made = rows.select("_n", cohorts).groupBy("cohort").agg(F.count("*").alias("n_requested"), F.count_if(F.col("_n") > 0).alias("n_covered"))
    return made.withColumn("coverage", F.col("n_covered") / F.col("n_requested"))


def covered(bars: DataFrame, requested: DataFrame, active: DataFrame | None, least: float = 0.9) -> DataFrame:
    """``bars``, unless too few of the current members (of all requested tickers without any of them) have a price. Departed names that
    no source has any more are a gap to report (``coverage_by_cohort``), not a fault. Nothing requested is a fault."""
    cohorts = coverage_by_cohort(requested, bars, requested.limit(0) if active is None else active)
    share = F.coalesce(*(F.max(F.when(F.col("cohort") == c, F.col("coverage"))) for c in ("current", "all")))
    facts = cohorts.agg(share.alias("share"))
    message = F.concat(F.lit("prices cover "), F.coalesce(F.format_number(100 * F.col("share"), 1), F.lit("none")), F.lit(f" % of the tickers that must be there, less than {100 * least:g} %"))
    return gated(bars, facts, F.col("share") >= least, message)
