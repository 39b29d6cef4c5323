"""Features of a long (date, ticker) panel: time windows by ticker, cross-sections by date, date-level series.

Stages come in a fixed order: time windows on the full history, then the membership filter, then same-date
features, then date-level joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import calendar_parts
from ..functions.windows import lag, last_known, pct_rank_avg, ratio_change, rolling, rolling_max
from .pit import days_to_next

LAGS = (1, 5, 10, 21, 63, 252)
#: Bytes of a method that HotSpot still compiles.
HUGE_METHOD = 8000


def returns(bars: DataFrame, price: str = "adj_close", lags=LAGS) -> DataFrame:
    return bars.withColumns({f"ret_{n}d": ratio_change(F.col(price), n) for n in lags})


def momentum(df: DataFrame) -> DataFrame:
    return df.withColumn("mom_21_5", F.col("ret_21d") - F.col("ret_5d"))


def volatility(df: DataFrame, windows=(10, 21)) -> DataFrame:
    return df.withColumns({f"vol_{n}d": rolling(F.stddev_samp, F.col("ret_1d"), n) for n in windows})


def rsi(df: DataFrame, n: int = 14, price: str = "adj_close") -> DataFrame:
    """Relative strength by simple means of gains and losses; only gains give 100, no change at all 50."""
    change = F.col(price) - lag(F.col(price), 1)
    df = df.withColumns({"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0))})
    df = df.withColumns({"_gain": rolling(F.avg, F.when(change.isNotNull(), F.col("_gain")), n), "_loss": rolling(F.avg, F.when(change.isNotNull(), F.col("_loss")), n)})
    value = F.when((F.col("_loss") == 0) & (F.col("_gain") == 0), 50.0).when(F.col("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("_gain"), F.col("_loss"))))
    return df.withColumn("rsi_14", F.when(F.col("_gain").isNotNull(), value)).drop("_gain", "_loss")


def price_to_mean(df: DataFrame, windows=(20, 50), price: str = "adj_close") -> DataFrame:
    return df.withColumns({f"px_sma_{n}": F.col(price) / rolling(F.avg, F.col(price), n) - 1 for n in windows})


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0, price: str = "adj_close") -> DataFrame:
    mean, spread = rolling(F.avg, F.col(price), n), rolling(F.stddev_samp, F.col(price), n)
    return df.withColumn("bb_pos", (F.col(price) - (mean - width * spread)) / (2 * width * spread + 1e-9))


def highs(df: DataFrame, price: str = "adj_close") -> DataFrame:
    df = rolling_max(df, F.col(price), {"_top_252": 252, "_top_63": 63})
    return df.withColumns({"high_252": F.col(price) / F.col("_top_252"), "drawdown_63": F.col(price) / F.col("_top_63") - 1}).drop("_top_252", "_top_63")


def volume_features(df: DataFrame, volume: str = "volume") -> DataFrame:
    """z-score (21), ratio to the mean (5), trend (10 over 21), and price change against volume change."""
    v = F.col(volume)
    return df.withColumns({
        "vol_z": F.try_divide(v - rolling(F.avg, v, 21), rolling(F.stddev_samp, v, 21)),
        "vol_ratio": F.try_divide(v, rolling(F.avg, v, 5)),
        "vol_trend": F.try_divide(rolling(F.avg, v, 10), rolling(F.avg, v, 21)),
        "pv_divergence": F.col("ret_5d") - ratio_change(v, 5)})


def join_volume(panel: DataFrame, volume: DataFrame) -> DataFrame:
    return panel.join(volume.select("date", "ticker", "volume"), ["date", "ticker"], "left")


def cross_ranks(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({f"{c}_rank": pct_rank_avg(F.col(c), "date") for c in columns})


def market_regime(df: DataFrame) -> DataFrame:
    """Same-date medians over all tickers."""
    return df.withColumns({f"mkt_{c}": F.median(c).over(Window.partitionBy("date")) for c in ("ret_5d", "ret_21d")})


def sector_spread(df: DataFrame, columns=("ret_5d", "ret_21d", "vol_10d")) -> DataFrame:
    """Difference to the median of the same date and sector; null without a sector."""
    group = Window.partitionBy("date", "sector")
    return df.withColumns({f"{c}_vs_sector": F.when(F.col("sector").isNotNull(), F.col(c) - F.median(c).over(group)) for c in columns})


def join_sectors(df: DataFrame, sectors: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Sector of each ticker; an override (ticker, sector, valid_to) holds for dates before ``valid_to``.

    Sector tables have a row for each ticker; Spark broadcasts them while they are small.
    """
    df = df.join(sectors.select("ticker", "sector"), "ticker", "left")
    if overrides is None:
        return df
    o = overrides.select(F.col("ticker").alias("_t"), F.col("sector").alias("_s"), "valid_to")
    return df.join(o, (F.col("ticker") == F.col("_t")) & (F.col("date") < F.col("valid_to")), "left").withColumn("sector", F.coalesce("_s", "sector")).drop("_t", "_s", "valid_to")


def macro_features(macro: DataFrame) -> DataFrame:
    """Yield spread, 5-row change of vix, and its percentile among the other rows of the last 252 (60 values at least).

    ``macro`` has one row for each date, so one ordering of all its rows is small.
    """
    w = Window.orderBy("date")
    before = F.collect_list(F.struct("vix")).over(w.rowsBetween(-251, -1))
    known = F.count("vix").over(w.rowsBetween(-251, 0))
    below = F.size(F.filter(before, lambda s: s["vix"] <= F.col("vix")))
    return macro.withColumns({
        "yield_spread": F.col("tnx_yield") - F.col("irx_yield"),
        "vix_change_5d": F.try_divide(F.col("vix"), F.lag("vix", 5).over(w)) - 1,
        "vix_percentile": F.when(F.col("vix").isNotNull() & (known >= 60), below / F.size(before))})


def join_macro(df: DataFrame, macro: DataFrame | None, columns=("vix", "tnx_yield", "irx_yield")) -> DataFrame:
    """Date-level join; null columns without a macro table."""
    if macro is None:
        return df.withColumns({c: F.lit(None).cast("double") for c in columns})
    return df.join(macro, "date", "left")


def merge_macro(primary: DataFrame, fallback: DataFrame, columns=("vix", "tnx_yield", "irx_yield")) -> DataFrame:
    """Union of dates; each value from the first source where known, else from the second."""
    a, b = primary.alias("a"), fallback.alias("b")
    return a.join(b, F.col("a.date") == F.col("b.date"), "full_outer").select(
        F.coalesce("a.date", "b.date").alias("date"), *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in columns))


def fill_score_date(macro: DataFrame, score_date, columns=("vix", "tnx_yield", "irx_yield")) -> DataFrame:
    """One row for the score date (a value, or a one-row frame with ``date``): the last known value of each column up to it, whether
    the table has a row of that date or not."""
    on = score_date if isinstance(score_date, DataFrame) else macro.sparkSession.range(1).select(F.lit(score_date).cast("date").alias("date"))
    on = on.select(F.col("date").alias("_on"))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in columns]
    return macro.join(F.broadcast(on), F.col("date") <= F.col("_on")).groupBy(F.col("_on").alias("date")).agg(*last)


def price_panel(bars: DataFrame) -> DataFrame:
    """All time-window features; one shuffle by ticker."""
    df = returns(bars)
    for step in (momentum, volatility, rsi, price_to_mean, bollinger, highs, volume_features):
        df = step(df)
    return df


def known_at(bars: DataFrame, facts: DataFrame, earnings: DataFrame, concepts: tuple[str, ...]) -> DataFrame:
    """``bars`` with the last value of each concept known at its date, and ``days_since_earnings``.

    ``facts`` has ticker, concept, period_end, filed, value; ``earnings`` ticker, earnings_date. Bars, filings and earnings are one
    stream of events of a ticker: one union, one shuffle, one ordering for any number of concepts. What is filed on a date
    is known on it; of one filing date the newest period counts.
    """
    names = bars.columns
    a = bars.select("*", F.col("date").alias("_at"), F.lit(1).alias("_bar"))
    b = facts.select("ticker", F.col("filed").alias("_at"), F.lit(0).alias("_bar"), F.col("period_end").alias("_period"), F.col("concept").alias("_concept"), F.col("value").alias("_value"))
    c = earnings.select("ticker", F.col("earnings_date").alias("_at"), F.lit(0).alias("_bar"), F.col("earnings_date").alias("_event"))
    w = Window.partitionBy("ticker").orderBy("_at", "_bar", "_period").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    values = {n: F.last(F.when(F.col("_concept") == n, F.col("_value")), ignorenulls=True).over(w) for n in concepts}
    both = both.withColumns({**values, "_last": F.last("_event", ignorenulls=True).over(w)}).where("_bar = 1")
    return both.select(*names, *concepts, F.datediff("date", "_last").alias("days_since_earnings"))


def feature_panel(bars: DataFrame, stints: DataFrame, sectors: DataFrame, macro: DataFrame | None, facts: DataFrame | None = None, earnings: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """The whole panel in stage order: time windows on the full history of a ticker, membership, ratios of what was known (facts as
    ``fundamentals.known_values``), same-date features of the members, and what depends on the date alone (macro, calendar).

    Rows are so wide that the one method Spark makes for a stage is beyond the 8,000 bytes up to which the JVM compiles; the
    session's bound makes Spark run such stages operator by operator, in small compiled methods."""
    from . import fundamentals
    from .pit import members_at

    bars.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD)
    if facts is not None:
        bars = known_at(bars, facts, earnings, fundamentals.RATIO_INPUTS)
    df = members_at(price_panel(bars), stints)
    if facts is not None:
        df = fundamentals.ratios(df).drop(*fundamentals.RATIO_INPUTS)
    df = cross_ranks(df, ("ret_21d", "vol_10d", "vol_z"))
    df = sector_spread(market_regime(join_sectors(df, sectors)))
    df = join_macro(df, None if macro is None else macro_features(macro))
    return df if events is None else with_calendar(df, events, "date")


def with_calendar(df: DataFrame, events: DataFrame, event_date: str, cap: int = 60, near: int = 5) -> DataFrame:
    """``df`` with ``event_countdown`` and the parts of its date. An event names the ``cap`` days up to it, so dates are met by equality
    and rows without an event ahead need no list of all dates."""
    days = F.explode(F.sequence(F.date_sub(event_date, cap), F.col(event_date))).alias("date")
    ahead = events.where(F.col(event_date).isNotNull()).select(F.col(event_date).alias("_event"), days).groupBy("date").agg(F.min(F.datediff("_event", "date")).alias("days_to_event"))
    df = df.join(ahead, "date", "left").withColumn("days_to_event", F.coalesce("days_to_event", F.lit(cap)))
    return df.withColumns({"within_5d": (F.col("days_to_event") <= near).cast("int"), **calendar_parts(F.col("date"))})


def event_countdown(dates: DataFrame, events: DataFrame, event_date: str, cap: int = 60, near: int = 5) -> DataFrame:
    """date, days_to_event (capped, also where none is ahead), within_5d (is it at most ``near`` days ahead?)."""
    return days_to_next(dates, events, event_date, cap).withColumn("within_5d", (F.col("days_to_event") <= near).cast("int"))
