"""Dense grids, forward returns, labels, row roles and purged splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.windows import last_known, over_time, pct_rank_avg
from ..schemas import require_columns
from .gates import not_empty, two_dates


def dense_grid(bars: DataFrame) -> DataFrame:
    """Every (date, ticker), with the bar where there is one. The grid itself is the operator's result."""
    dates, tickers = bars.select("date").distinct(), bars.select("ticker").distinct()
    return dates.crossJoin(tickers).join(bars, ["date", "ticker"], "left")


def to_wide(df: DataFrame, tickers: list, value: str) -> DataFrame:
    """Export form with a column for each of the given tickers; the first value of a cell."""
    return df.groupBy("date").pivot("ticker", tickers).agg(F.first(value, ignorenulls=True))


def to_arrays(df: DataFrame, values: list[str]) -> DataFrame:
    """A row a date: ``tickers`` in order, and an array of each of ``values`` in the same order. Like a wide frame, but no column and no
    driver has to know the tickers."""
    day = F.sort_array(F.collect_list(F.struct("ticker", *values)))
    rows = df.groupBy("date").agg(day.alias("_day"))
    return rows.select("date", F.col("_day.ticker").alias("tickers"), *(F.col(f"_day.{c}").alias(c) for c in values))


def forward_returns(grid: DataFrame, horizon: int, price: str = "adj_close") -> DataFrame:
    """Return over the next ``horizon`` grid rows of the ticker."""
    return grid.withColumn("fwd_ret", F.try_divide(F.lead(price, horizon).over(over_time()), F.col(price)) - 1)


def forward_by_session(bars: DataFrame, sessions: DataFrame, horizon: int, price: str = "adj_close") -> DataFrame:
    """``bars`` with ``fwd_ret``, the return over ``horizon`` sessions; null where the name has no bar then. The dense grid is not built."""
    numbered = bars.join(sessions.select("date", "session_no"), "date")
    later = numbered.select("ticker", (F.col("session_no") - horizon).alias("session_no"), F.col(price).alias("_later"))
    return numbered.join(later, ["ticker", "session_no"], "left").withColumn("fwd_ret", F.try_divide(F.col("_later"), F.col(price)) - 1).drop("_later", "session_no")


def forward_in_order(bars: DataFrame, sessions: DataFrame, horizon: int, price: str = "adj_close") -> DataFrame:
    """What ``forward_by_session`` gives, by the ticker's own order instead of a join: for bars that other windows of a ticker need anyway."""
    ahead = Window.partitionBy("ticker").orderBy("session_no").rangeBetween(horizon, horizon)
    numbered = bars.join(F.broadcast(sessions.select("date", "session_no")), "date", "left")
    return numbered.withColumn("fwd_ret", F.try_divide(F.first(price).over(ahead), F.col(price)) - 1).drop("session_no")


def terminal_returns(df: DataFrame, price: str = "adj_close") -> DataFrame:
    """Fill ``fwd_ret`` of names that stop trading with the return to their last quote."""
    ticker, everything = Window.partitionBy("ticker"), df.agg(F.max(F.when(F.col(price).isNotNull(), F.col("date"))).alias("_end"))
    df = df.withColumns({"_last": F.max(F.when(F.col(price).isNotNull(), F.col("date"))).over(ticker), "_quote": F.max_by(price, F.when(F.col(price).isNotNull(), F.col("date"))).over(ticker)})
    df = df.join(F.broadcast(everything))
    gone = (F.col("_last") < F.col("_end")) & (F.col("date") < F.col("_last"))
    return df.withColumn("fwd_ret", F.coalesce("fwd_ret", F.when(gone, F.try_divide("_quote", price) - 1))).drop("_last", "_quote", "_end")


def row_roles(df: DataFrame, threshold: float, price: str = "adj_close") -> DataFrame:
    """is_tradable, has_label, and target: null where the future is unknown."""
    return df.withColumns({
        "is_tradable": F.coalesce(F.col(price) > 0, F.lit(False)), "has_label": F.col("fwd_ret").isNotNull(),
        "target": F.when(F.col("fwd_ret").isNotNull(), (F.col("fwd_ret") >= threshold).cast("double"))})


def label_target(df: DataFrame, kind: str = "raw", vol: str = "vol_21d", floor: float = 1e-4) -> DataFrame:
    """raw, vol_adj or excess_vol_adj (over the same-date median) forward return; null below the volatility floor."""
    x = F.col("fwd_ret")
    if kind == "excess_vol_adj":
        x = x - F.median("fwd_ret").over(Window.partitionBy("date"))
    return df.withColumn("label_target", x if kind == "raw" else F.when(F.col(vol) > floor, x / F.col(vol)))


def rank_grades(df: DataFrame, grades: int, target: str = "label_target") -> DataFrame:
    """Grades 0 .. grades-1 by same-date percent rank; an unknown target gets 0."""
    pct = pct_rank_avg(F.col(target), "date")
    return df.withColumn("grade", F.coalesce(F.greatest(F.lit(0), F.least(F.lit(grades - 1), F.ceil(pct * grades) - 1)), F.lit(0)).cast("int"))


def training_rows(df: DataFrame, features: list[str], target: str = "target", strict: bool = False) -> DataFrame:
    require_columns(df, *features, target)
    return df.where(F.col(target).isNotNull()).na.drop(subset=features if strict else ["ret_1d"])


def scoring_rows(df: DataFrame, features: list[str]) -> DataFrame:
    return require_columns(df, *features).na.drop(how="all", subset=features)


def date_slice(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows with start <= date <= end; the query fails if there are none."""
    for cond in ([F.col("date") >= start] if start is not None else []) + ([F.col("date") <= end] if end is not None else []):
        df = df.where(cond)
    return not_empty(df, f"no row lies between {start} and {end}")


def normalise_scored(df: DataFrame) -> DataFrame:
    """date, ticker, prob, adj_close and the other columns of a scored panel; a missing column is refused at once, a panel of one date when it runs."""
    if "prob" not in df.columns and "probability" in df.columns:
        df = df.withColumnRenamed("probability", "prob")
    require_columns(df, "date", "ticker", "prob", "adj_close")
    return two_dates(df.withColumn("date", F.to_date("date")))


def train_test(df: DataFrame, train_end, test_start) -> DataFrame:
    """Rows of either side with their role."""
    if not train_end < test_start:
        raise ValueError("the test must start after the training ends")
    role = F.when(F.col("date") <= train_end, "train").when(F.col("date") >= test_start, "test")
    return df.withColumn("role", role).where("role is not null")


def latest_slice(df: DataFrame, features: list[str]) -> DataFrame:
    last = df.agg(F.max("date").alias("date"))
    return scoring_rows(df.join(F.broadcast(last), "date", "left_semi"), features)


def regime_filter(df: DataFrame, threshold: float, column: str = "vix_percentile") -> DataFrame:
    return df.where(F.col(column).isNull() | (F.col(column) <= threshold))


def without(df: DataFrame, names: DataFrame) -> DataFrame:
    return df.join(names, "ticker", "left_anti")


def ffill_prices(grid: DataFrame, price: str = "adj_close") -> DataFrame:
    return grid.withColumn(price, last_known(F.col(price), "ticker"))


def purge_before(df: DataFrame, boundary, days: int) -> DataFrame:
    """Rows before the boundary, less those of its last ``days`` dates; none if there are no more dates than that."""
    before = df.where(F.col("date") < boundary)
    ranked = before.select("date").distinct().withColumn("_back", F.row_number().over(Window.orderBy(F.desc("date"))))
    return before.join(ranked.where(F.col("_back") > days).select("date"), "date", "left_semi")


def purged_folds(df: DataFrame, n_splits: int, purge: int) -> DataFrame:
    """date, fold, role: expanding training dates, ``purge`` dates left out, then an equal block of test dates."""
    dates = df.select("date").distinct()
    dates = dates.withColumns({"i": F.row_number().over(Window.orderBy("date")) - 1}).join(F.broadcast(dates.agg(F.count("*").alias("n"))))
    size = F.floor(F.col("n") / (n_splits + 1)).cast("int")
    folds = dates.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    start = F.col("n") - (n_splits - F.col("fold") + 1) * size
    role = F.when(F.col("i") < start - purge, "train").when((F.col("i") >= start) & (F.col("i") < start + size), "test")
    return folds.select("date", "fold", role.alias("role")).where("role is not null")


def inner_split(df: DataFrame, fraction: float, purge: int) -> DataFrame:
    """date, role: the last int(n * fraction) dates validate, ``purge`` dates before them are left out."""
    dates = df.select("date").distinct()
    dates = dates.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1).join(F.broadcast(dates.agg(F.count("*").alias("n"))))
    start = F.col("n") - F.floor(F.col("n") * fraction)
    role = F.when(F.col("i") >= start, "validation").when(F.col("i") < start - purge, "train")
    return dates.select("date", role.alias("role")).where("role is not null")


def walk_forward_plan(df: DataFrame, test_start, purge: int) -> DataFrame:
    """For each month from ``test_start``: last training date (purged), training and test dates counted."""
    dates = df.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))
    months = dates.where(F.col("date") >= test_start).groupBy(F.trunc("date", "month").alias("month")).agg(F.min("i").alias("first"), F.count("*").alias("n_test"))
    ends = dates.select(F.col("i").alias("_i"), F.col("date").alias("train_end"))
    return months.join(ends, F.col("_i") == F.col("first") - 1 - purge, "left").select("month", "train_end", F.greatest(F.lit(0), F.col("first") - 1 - purge).cast("long").alias("n_train"), F.col("n_test").cast("long").alias("n_test"))
