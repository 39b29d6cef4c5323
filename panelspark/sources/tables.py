"""Scans of landed files and set operations on batches of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import normalise_ticker
from ..functions.windows import last_known
from ..operators.gates import not_empty
from ..schemas import SCORED, STINTS


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """A scored panel, Parquet or CSV by the path's suffix."""
    return spark.read.csv(path, schema=SCORED, header=True) if path.endswith(".csv") else spark.read.parquet(path)


def read_stints(spark: SparkSession, path: str) -> DataFrame:
    return clean_stints(spark.read.csv(path, schema=STINTS, header=True))


def clean_stints(raw: DataFrame) -> DataFrame:
    """Tickers normalised; dates that do not parse become null."""
    return raw.select(normalise_ticker(F.col("ticker")).alias("ticker"), F.expr("try_to_date(start_date)").alias("start_date"), F.expr("try_to_date(end_date)").alias("end_date"))


def bars_between(bars: DataFrame, tickers: DataFrame, start, end) -> DataFrame:
    return bars.where(F.col("date").between(start, end)).join(tickers.select("ticker").distinct(), "ticker", "left_semi")


def macro_from_series(series: DataFrame, names: list[str]) -> DataFrame:
    """Long (series, date, value) to one row a date, filled forward; a series without rows is a null column."""
    wide = series.groupBy("date").agg(*(F.first(F.when(F.col("series") == n, F.col("value")), ignorenulls=True).alias(n) for n in names))
    return wide.select("date", *(last_known(F.col(n)).alias(n) for n in names))


def benchmark_series(bars: DataFrame, ticker) -> DataFrame:
    return bars.where((F.col("ticker") == ticker) & F.col("adj_close").isNotNull()).select(F.to_date("date").alias("date"), F.col("adj_close").alias("close"))


def id_map(rows: DataFrame) -> DataFrame:
    """ticker, cik: normalised ticker and id padded to ten digits."""
    return rows.select(normalise_ticker(F.col("ticker")).alias("ticker"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"))


def resolve_ids(tickers: DataFrame, primary: DataFrame, cache: DataFrame) -> DataFrame:
    """ticker, cik, layer: from the first map that knows the ticker."""
    j = tickers.join(primary.select("ticker", F.col("cik").alias("_a")), "ticker", "left").join(cache.select("ticker", F.col("cik").alias("_b")), "ticker", "left")
    return j.select("ticker", F.coalesce("_a", "_b").alias("cik"), F.when(F.col("_a").isNotNull(), "primary").when(F.col("_b").isNotNull(), "cache").otherwise("missing").alias("layer"))


def insider_purchases(transactions: DataFrame, submissions: DataFrame, owners: DataFrame) -> DataFrame:
    """Purchases (code P) with their filing, first owner, value, and if they were planned (null if unknown)."""
    first = owners.groupBy("accession").agg(F.min("owner").alias("owner"))
    t = transactions.where("code = 'P' and shares > 0 and price > 0")
    return t.join(submissions, "accession", "left").join(first, "accession", "left").select(
        normalise_ticker(F.col("symbol")).alias("ticker"), F.expr("try_to_date(filed, 'dd-MMM-yyyy')").alias("filed"), (F.col("shares") * F.col("price")).alias("value"), "owner",
        F.when(F.col("aff10b5one").isin("1", "true"), True).when(F.col("aff10b5one").isin("0", "false"), False).alias("planned"))


def earnings_dates(raw: DataFrame) -> DataFrame:
    return raw.select("ticker", F.to_date("earnings_date").alias("earnings_date")).where("earnings_date is not null").distinct()


def wide_to_long(prices: DataFrame, volumes: DataFrame, tickers: list[str]) -> DataFrame:
    """Two wide frames (date and a column for each ticker) to long bars; a cell known to either stays."""
    p = prices.unpivot(["date"], tickers, "ticker", "adj_close").where("adj_close is not null")
    v = volumes.unpivot(["date"], tickers, "ticker", "volume").where("volume is not null")
    return p.join(v, ["date", "ticker"], "full_outer")


def arrays_to_long(prices: DataFrame, volumes: DataFrame) -> DataFrame:
    """Two frames of a row a date (``tickers`` and an array ``adj_close`` or ``volume``) to long bars; a cell known to either stays."""
    long = [df.select("date", F.inline(F.arrays_zip(F.col("tickers").alias("ticker"), c))).where(F.col(c).isNotNull()) for df, c in ((prices, "adj_close"), (volumes, "volume"))]
    return long[0].join(long[1], ["date", "ticker"], "full_outer")


def work_list(requested: DataFrame, landed: DataFrame, as_of, max_age_days: int) -> DataFrame:
    """Requested tickers that have not landed, or landed too long ago; empty landings count as landed."""
    fresh = landed.where(F.datediff(F.lit(as_of).cast("date"), F.col("landed_on")) <= max_age_days)
    return requested.select("ticker").distinct().join(fresh, "ticker", "left_anti")


def ticker_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """All rows of the first source for tickers with a price there, of the second for the others."""
    usable = primary.groupBy("ticker").agg(F.count("adj_close").alias("_n")).where("_n > 0")
    return primary.join(usable, "ticker", "left_semi").unionByName(secondary.join(usable, "ticker", "left_anti"))


def union_later_wins(batches: list[DataFrame]) -> DataFrame:
    """Rows of all batches; of one (date, ticker) the row of the last batch."""
    both = batches[0].withColumn("_b", F.lit(0))
    for i, b in enumerate(batches[1:], 1):
        both = both.unionByName(b.withColumn("_b", F.lit(i)))
    r = F.row_number().over(Window.partitionBy("date", "ticker").orderBy(F.desc("_b")))
    return both.withColumn("_r", r).where("_r = 1").drop("_b", "_r")


def live_universe(trained: DataFrame, current: DataFrame) -> DataFrame:
    """Tickers of both; the query fails if there are none, as a model that old has nothing to trade."""
    return not_empty(trained.select("ticker").intersect(current.select("ticker")), "no trained ticker is a member now")


def departed(trained: DataFrame, current: DataFrame) -> DataFrame:
    return trained.select("ticker").distinct().join(current, "ticker", "left_anti")


def event_dates(scheduled: DataFrame, unscheduled: DataFrame) -> DataFrame:
    """date, kind; countdowns use scheduled rows only."""
    return scheduled.select("date", F.lit("scheduled").alias("kind")).unionByName(unscheduled.select("date", F.lit("unscheduled").alias("kind"))).distinct()


def write_panel(df: DataFrame, path: str) -> None:
    df.withColumn("month", F.trunc("date", "month")).write.mode("overwrite").partitionBy("month").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A panel as CSV with headers, a file for each task; ``read_scored`` reads them all."""
    df.write.mode("overwrite").csv(path, header=True)


def write_report(df: DataFrame, path: str) -> None:
    """A small ranked report as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
