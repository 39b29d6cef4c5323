"""Autocorrelation-robust (HAC) statistics, risk and relative metrics of return series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import daily_rate

YEAR = 252


def _lags(n: Column, overlap: int) -> Column:
    """Bartlett lags: the larger of the automatic rule and overlap - 1, and fewer than n."""
    auto = F.floor(4 * F.pow(n / 100, F.lit(2 / 9))).cast("int")
    return F.least(n.cast("int") - 1, F.greatest(auto, F.lit(overlap - 1)))


def _long_run(x: Column, y: Column, n: Column, lags: Column) -> Column:
    """Bartlett-weighted long-run sum of products of two arrays of n numbers."""
    dot = lambda a, b, j: F.aggregate(F.zip_with(F.slice(a, j + 1, n - j), F.slice(b, F.lit(1), n - j), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    at = lambda j: F.when(j == 0, dot(x, y, j)).otherwise((1 - j / (lags + 1)) * (dot(x, y, j) + dot(y, x, j)))
    return F.aggregate(F.transform(F.sequence(F.lit(0), lags), at), F.lit(0.0), lambda s, v: s + v)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def hac_mean(df: DataFrame, value: str, keys: list[str], overlap: int = 1) -> DataFrame:
    """keys, mean, std, t_stat (null below 3 rows), n of a series with a row for each date."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", value))).alias("_s"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    n = F.col("n").cast("int")
    rest = F.transform("_s", lambda r: r[value] - F.col("mean"))
    rows = rows.withColumn("s", F.when(n > 0, _once(rest, lambda e: _long_run(e, e, n, _lags(n, overlap)))))
    t = F.when((F.col("n") >= 3) & (F.col("s") > 1e-18), F.col("mean") * F.col("n") / F.sqrt("s"))
    return rows.where("n > 0").select(*keys, "mean", "std", t.alias("t_stat"), "n")


def hac_ols(df: DataFrame, y: str, x: str, keys: list[str], overlap: int = 1) -> DataFrame:
    """keys, alpha, beta, t_alpha, t_beta, n of y on an intercept and x."""
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*keys, "date", F.col(y).alias("_y"), F.col(x).alias("_x"))
    rows = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("date", "_y", "_x"))).alias("_s"), F.count("*").alias("n"), F.sum("_x").alias("sx"), F.sum(F.col("_x") ** 2).alias("sxx"),
        F.avg("_y").alias("my"), F.avg("_x").alias("mx"), F.try_divide(F.covar_pop("_y", "_x"), F.var_pop("_x")).alias("beta")).where("n > 0")
    rows = rows.withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
    n = F.col("n").cast("int")
    lags = _lags(n, overlap)
    scores = F.transform("_s", lambda r: F.struct((r["_y"] - F.col("alpha") - F.col("beta") * r["_x"]).alias("e"), r["_x"].alias("x")))
    pair = _once(scores, lambda z: F.struct(F.transform(z, lambda r: r["e"]).alias("e"), F.transform(z, lambda r: r["e"] * r["x"]).alias("xe")))
    sums = _once(pair, lambda p: F.struct(_long_run(p["e"], p["e"], n, lags).alias("s00"), _long_run(p["e"], p["xe"], n, lags).alias("s01"), _long_run(p["xe"], p["xe"], n, lags).alias("s11")))
    both = rows.withColumn("_sums", sums).select("*", "_sums.*")
    det = F.col("n") * F.col("sxx") - F.col("sx") ** 2
    a, b, d = F.col("sxx") / det, -F.col("sx") / det, F.col("n") / det  # inverse of X'X
    s00, s01, s11 = F.col("s00"), F.col("s01"), F.col("s11")
    var_a = a * a * s00 + 2 * a * b * s01 + b * b * s11
    var_b = b * b * s00 + 2 * b * d * s01 + d * d * s11
    return both.select(*keys, "alpha", "beta", F.try_divide(F.col("alpha"), F.sqrt(var_a)).alias("t_alpha"), F.try_divide(F.col("beta"), F.sqrt(var_b)).alias("t_beta"), "n")


def market_exposure(df: DataFrame, portfolio: str, benchmark: str, keys: list[str], overlap: int = 1, a_year: float = YEAR) -> DataFrame:
    """Beta, alpha of a year of ``a_year`` periods and their t's; returns of both cover the same period in each row."""
    return hac_ols(df, portfolio, benchmark, keys, overlap).select(*keys, "beta", "t_beta", (F.col("alpha") * a_year).alias("alpha_annual"), "t_alpha", "n")


def nav_returns(nav: DataFrame, keys: list[str], value: str = "nav") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date")
    return nav.withColumn("ret", F.try_divide(F.col(value), F.lag(value).over(w)) - 1)


def drawdowns(nav: DataFrame, keys: list[str], value: str = "nav") -> DataFrame:
    return nav.withColumn("drawdown", F.try_divide(F.col(value), F.max(value).over(Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))) - 1)


def downside_deviation(x: Column, target: float = 0.0) -> Column:
    """Root mean square shortfall over all observations."""
    return F.sqrt(F.avg(F.when(x.isNotNull(), F.pow(F.least(x - target, F.lit(0.0)), F.lit(2)))))  # least() skips nulls


def daily_excess(returns: DataFrame, cash: DataFrame) -> DataFrame:
    """``returns`` (date, ret) with x: the return less the day's part of the annual cash rate (date, rate); unknown without a rate."""
    return returns.join(cash.select("date", "rate"), "date", "left").withColumn("x", F.col("ret") - daily_rate(F.col("rate"))).drop("rate")


def performance(nav: DataFrame, keys: list[str], daily_rf: float = 0.0, cash: DataFrame | None = None) -> DataFrame:
    """total_return, cagr, sharpe, sortino, max_drawdown, calmar of NAV series; ratios over a fixed daily rate or a cash rate by date."""
    rows = drawdowns(nav_returns(nav, keys), keys)
    rows = rows.withColumn("x", F.col("ret") - daily_rf) if cash is None else daily_excess(rows, cash)
    m = rows.groupBy(*keys).agg(
        (F.try_divide(F.max_by("nav", "date"), F.min_by("nav", "date")) - 1).alias("total_return"), F.count("ret").alias("days"), F.avg("x").alias("mx"), F.stddev_samp("x").alias("sx"),
        downside_deviation(F.col("x")).alias("dx"), F.min("drawdown").alias("max_drawdown"))
    cagr = F.pow(1 + F.col("total_return"), YEAR / F.col("days")) - 1
    return m.select(
        *keys, "total_return", cagr.alias("cagr"), F.when(F.col("sx") > 1e-12, F.col("mx") / F.col("sx") * F.sqrt(F.lit(YEAR))).alias("sharpe"),
        F.when(F.col("dx") > 1e-12, F.col("mx") / F.col("dx") * F.sqrt(F.lit(YEAR))).alias("sortino"), "max_drawdown", F.when(F.col("max_drawdown") < -1e-12, cagr / -F.col("max_drawdown")).alias("calmar"))


def relative(df: DataFrame, keys: list[str], a: str = "ret", b: str = "bench", overlap: int = 1) -> DataFrame:
    """Active return, tracking error, information ratio, beta, up and down capture of returns against a benchmark; alpha
    with its robust and plain t; return and drawdown of the compounded active return."""
    x, y = F.col(a), F.col(b)
    both = df.where(x.isNotNull() & y.isNotNull())
    m = both.groupBy(*keys).agg(
        F.avg(x - y).alias("mean"), F.stddev_samp(x - y).alias("sd"), F.try_divide(F.covar_samp(x, y), F.var_samp(y)).alias("beta"), F.count("*").alias("n"),
        (F.var_pop(x) * F.count("*")).alias("sxx"), (F.covar_pop(x, y) * F.count("*")).alias("sxy"),
        F.try_divide(F.avg(F.when(y > 0, x)), F.avg(F.when(y > 0, y))).alias("up_capture"), F.try_divide(F.avg(F.when(y < 0, x)), F.avg(F.when(y < 0, y))).alias("down_capture"))
    alpha = hac_ols(both, a, b, keys, overlap).select(*keys, "alpha", "t_alpha")
    so_far = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    overlay = both.withColumn("_v", F.product(1 + x - y).over(so_far))
    overlay = overlay.withColumn("_d", F.col("_v") / F.max("_v").over(so_far) - 1).groupBy(*keys).agg((F.max_by("_v", "date") - 1).alias("overlay_return"), F.min("_d").alias("overlay_drawdown"))
    for other in (alpha, overlay):
        m = m.join(other, keys) if keys else m.join(F.broadcast(other))  # without keys each is one row
    spread = F.sqrt((F.col("sxx") - F.col("beta") * F.col("sxy")) / (F.col("n") - 1))
    return m.select(
        *keys, (F.col("mean") * YEAR).alias("active_return"), (F.col("sd") * YEAR**0.5).alias("tracking_error"), (F.try_divide("mean", "sd") * YEAR**0.5).alias("information_ratio"), "beta", "up_capture", "down_capture",
        (F.col("alpha") * YEAR).alias("alpha_annual"), "t_alpha", F.when(spread > 1e-12, F.col("alpha") / spread * F.sqrt("n")).alias("t_alpha_iid"), "overlay_return", "overlay_drawdown")


def monthly_returns(nav: DataFrame) -> DataFrame:
    """year and a column m01 .. m12 for each month's return from month end to month end."""
    ends = nav.groupBy(F.trunc("date", "month").alias("month")).agg(F.max_by("nav", "date").alias("nav"))
    ends = ends.withColumn("r", F.col("nav") / F.lag("nav").over(Window.orderBy("month")) - 1)
    return ends.groupBy(F.year("month").alias("year")).agg(*(F.max(F.when(F.month("month") == k, F.col("r"))).alias(f"m{k:02d}") for k in range(1, 13)))
