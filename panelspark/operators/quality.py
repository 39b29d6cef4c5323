"""Coverage, drift, digests and freshness of tables; audited writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window, functions as F

from .gates import gated


def coverage(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """n_requested, n_covered, coverage: share of requested tickers with any price."""
    has = bars.groupBy("ticker").agg(F.count("adj_close").alias("_n"))
    j = requested.select("ticker").distinct().join(has, "ticker", "left")
    return j.agg(F.count("*").alias("n_requested"), F.count_if(F.col("_n") > 0).alias("n_covered")).withColumn("coverage", F.try_divide("n_covered", "n_requested"))


def recent_coverage(bars: DataFrame, sessions: int) -> DataFrame:
    """ticker, coverage: share of the last sessions (as many as exist) with a positive price."""
    last = bars.select("date").distinct().orderBy(F.desc("date")).limit(sessions)
    n = last.agg(F.count("*").alias("_n"))
    seen = bars.join(F.broadcast(last), "date", "left_semi").groupBy("ticker").agg(F.count_if(F.col("adj_close") > 0).alias("_k"))
    return bars.select("ticker").distinct().join(seen, "ticker", "left").join(F.broadcast(n)).select("ticker", (F.coalesce("_k", F.lit(0)) / F.col("_n")).alias("coverage"))


def thin_names(bars: DataFrame, sessions: int, least: float) -> DataFrame:
    return recent_coverage(bars, sessions).where(F.col("coverage") < least)


def universe_digest(tickers: DataFrame) -> DataFrame:
    """16 hex digits of the sorted tickers, and how many they are; a dimension, so that all fit into one value."""
    names = F.collect_set(F.col("ticker").cast("string"))
    return tickers.agg(F.substring(F.sha2(F.array_join(F.array_sort(names), "|"), 256), 1, 16).alias("digest"), F.size(names).alias("n"))


def universe_drift(trained: DataFrame, current: DataFrame) -> DataFrame:
    a, b = trained.select("ticker").distinct().withColumn("_a", F.lit(1)), current.select("ticker").distinct().withColumn("_b", F.lit(1))
    j = a.join(b, "ticker", "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.agg(F.count_if(both).alias("tradable"), F.count_if(F.col("_a").isNull()).alias("new"), F.count_if(F.col("_b").isNull()).alias("gone"), F.try_divide(F.count_if(both), F.count("_b")).alias("coverage"))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, known: share of rows with a value."""
    one = df.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns))
    return one.unpivot([], columns, "column", "known")


def span(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bucket, n of values clipped to [low, high]; the top value falls into the last bucket."""
    x = F.least(F.greatest(F.col(column), F.lit(low)), F.lit(high))
    bucket = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def freshness(tables: DataFrame, sessions: DataFrame, as_of, max_age_years: float = 1.0, max_sessions: int = 5) -> DataFrame:
    """name, kind, severity, amount for tables (name, built, last_date): findings, the severest first. The calendar is one
    broadcast row, so no row meets it day by day in a join."""
    as_of = F.lit(as_of).cast("date")
    t = tables.withColumn("age", F.datediff(as_of, F.col("built")) / 365.25)
    days = sessions.where(F.col("date") <= as_of).agg(F.collect_list("date").alias("_days"))
    missed = F.size(F.filter("_days", lambda d: d > F.col("last_date"))).cast("double")
    behind = t.join(F.broadcast(days)).select("name", missed.alias("amount"))
    old = t.where(F.col("age") > max_age_years).select("name", F.lit("model_age").alias("kind"), F.lit("error").alias("severity"), F.col("age").alias("amount"))
    late = behind.where(F.col("amount") > 0).select("name", F.lit("data_age").alias("kind"), F.when(F.col("amount") > max_sessions, "error").otherwise("warning").alias("severity"), "amount")
    return old.unionByName(late).orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "name", "kind")


def gate_scores(scored: DataFrame, probability_weighted: bool, regime: str | None = None) -> DataFrame:
    """``scored``; the query fails if scores are negative under probability weighting, or if no value of the regime column is known.
    A missing column is refused at once."""
    if regime is not None and regime not in scored.columns:
        raise ValueError(f"missing column: {regime}")
    if probability_weighted:
        scored = gated(scored, scored.agg(F.coalesce(F.min("prob"), F.lit(0.0)).alias("least")), F.col("least") >= 0, "negative scores cannot be weights")
    if regime is not None:
        scored = gated(scored, scored.agg(F.count(regime).alias("known")), F.col("known") > 0, f"no value of {regime} is known")
    return scored


def write_audited(df: DataFrame, path: str) -> dict:
    """Write Parquet; rows and an order-free content hash, counted in the same pass."""
    seen = Observation("audit")
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("hash")).write.mode("overwrite").parquet(path)
    return seen.get


def content_hash(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("hash"))
