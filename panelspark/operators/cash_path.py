"""The cash path of a long-short book: interest on cash, borrow fees and trading costs, for many borrow rates at once.

Everything is per unit of the equity at a fill. Between two fills cash follows cash' = (1 + r) * cash - fee, whose solution is a
running product (the index of cash) and a running sum of discounted fees, so a period is one window; fees are linear in a flat
borrow rate, so one sum serves all rates. The equity at a fill is a running product of the periods' factors.

Only trading costs look back: what is traded depends on the equity that the last period ends with. They are the fixed point
of cost = slippage * traded(factor(cost)). A round shrinks the error by about slippage times turnover, so ``ROUNDS`` of
them leave less than 1e-9.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import daily_rate
from ..functions.windows import last_known, next_known
from ..sources.stored import stored
from .portfolio import held_days, priced
from .stats import performance

ROUNDS = 3
YEAR = 252


def cash_index(sessions: DataFrame, annual: float | DataFrame) -> DataFrame:
    """date, index: what one unit of cash has grown to at each session; the first is 1. ``annual`` is a rate, or (date, rate) with gaps."""
    if isinstance(annual, DataFrame):
        rated = sessions.select("date").join(annual.select("date", "rate"), "date", "left")
        rated = rated.select("date", F.coalesce(last_known(F.col("rate")), next_known(F.col("rate")), F.lit(0.0)).alias("rate"))
    else:
        rated = sessions.select("date", F.lit(float(annual)).alias("rate"))
    w = Window.orderBy("date")
    step = F.when(F.row_number().over(w) > 1, F.log1p(daily_rate(F.col("rate")))).otherwise(0.0)
    return rated.withColumn("_s", step).select("date", F.exp(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("index"))


def book_periods(book: DataFrame, prices: DataFrame, sessions: DataFrame, every: int) -> DataFrame:
    """k, ticker, weight, fill_date, next_fill, p0, growth of the book of every ``every``-th session, filled at the next one. The last
    period ends with the last session. Names without a price at the fill are left out."""
    book = stored(book)  # its dates and its legs are read; what ranks it runs once
    w = Window.orderBy("session_no")
    fills = sessions.withColumns({"fill_date": F.lead("date").over(w), "_end": F.max("date").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}).where((F.col("session_no") - 1) % every == 0)
    books = book.select("date").distinct()
    fills = fills.where("fill_date < _end").join(books, "date", "left_semi").withColumn("next_fill", F.coalesce(F.lead("fill_date").over(w), F.col("_end")))
    legs = book.join(fills.select("date", (F.row_number().over(w) - 1).alias("k"), "fill_date", "next_fill"), "date").select("k", "ticker", "weight", "fill_date", "next_fill")
    both = priced(stored(legs), prices, "fill_date", "next_fill").where("p0 > 0 and p1 is not null")
    return both.select("k", "ticker", "weight", "fill_date", "next_fill", "p0", (F.col("p1") / F.col("p0")).alias("growth"))


def book_trades(periods: DataFrame) -> DataFrame:
    """k, ticker, weight, held: what a fill wants, and what the period before leaves, per unit of that period's first equity."""
    left = periods.select((F.col("k") + 1).alias("k"), "ticker", (F.col("weight") * F.col("growth")).alias("held"))
    both = periods.select("k", "ticker", "weight").join(left, ["k", "ticker"], "full_outer").join(periods.select("k").distinct(), "k", "left_semi")
    return both.na.fill(0.0, ["weight", "held"])


def book_days(periods: DataFrame, prices: DataFrame, index: DataFrame, rates: DataFrame | None = None, flat: float = 0.0) -> DataFrame:
    """k, date, value (of the legs), short (notional), fee (a day's at each name's own rate, else the flat one), index, and the discounted
    running sums of short and fee, of every day after a fill up to the next one."""
    by_day = rates is not None and "date" in rates.columns
    if rates is not None and not by_day:
        periods = periods.join(rates.select("ticker", "rate"), "ticker", "left")
    days = held_days(periods.withColumns({"_from": F.date_add("fill_date", 1), "_to": F.date_add("next_fill", 1)}), prices, "_from", "_to", index)
    worth = F.col("weight") * F.col("mark") / F.col("p0")
    days = days.select("k", "fill_date", F.col("day").alias("date"), "ticker", worth.alias("worth"), *(["rate"] if rates is not None and not by_day else []))
    own = F.lit(flat)
    if rates is not None:
        days = days.join(rates.select("date", "ticker", "rate"), ["date", "ticker"], "left") if by_day else days
        own = F.coalesce("rate", F.lit(flat))
    short = F.greatest(-F.col("worth"), F.lit(0.0))
    sums = days.groupBy("k", "date").agg(F.first("fill_date").alias("fill_date"), F.sum("worth").alias("value"), F.sum(short).alias("short"), F.sum(short * own / YEAR).alias("fee"))
    start = index.select(F.col("date").alias("fill_date"), F.col("index").alias("index_0"))
    sums = sums.join(index, "date").join(start, "fill_date")
    so_far = Window.partitionBy("k").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumns({"short_sum": F.sum(F.col("short") / YEAR / F.col("index")).over(so_far), "fee_sum": F.sum(F.col("fee") / F.col("index")).over(so_far)})


def cash_path(periods: DataFrame, prices: DataFrame, sessions: DataFrame, annual_cash: float | DataFrame, borrow: list[float] | DataFrame, slippage: float = 0.0, capital: float = 100_000.0, flat: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Daily NAV (annual, date, nav) and sums (annual, traded, slippage, borrow, financing, effective_rate) of a book.

    ``borrow``: flat rates, a book for each; or (date, ticker, rate) or (ticker, rate), one book (annual is null) that pays each name's own rate, ``flat`` if
    unknown. Trading is paid on the change of each position. A book whose equity is spent stays at 0.
    """
    periods, index = stored(periods), stored(cash_index(sessions, annual_cash))
    by_name = isinstance(borrow, DataFrame)
    days, trades = stored(book_days(periods, prices, index, borrow if by_name else None, flat)), stored(book_trades(periods))
    every: Column = F.array(F.lit(None).cast("double")) if by_name else F.array(*(F.lit(float(r)) for r in borrow))
    spent = F.col("fee_sum") if by_name else F.col("annual") * F.col("short_sum")
    wants = periods.groupBy("k").agg(F.sum("weight").alias("net"))
    last = days.groupBy("k").agg(*(F.max_by(c, "date").alias(c) for c in ("value", "index", "index_0", "short_sum", "fee_sum")))
    ends = stored(last.join(wants, "k").withColumn("annual", F.explode(every)))
    rates = ["k"] if by_name else ["annual", "k"]
    costs = None
    for _ in range(ROUNDS + 1):
        held = ends if costs is None else ends.join(costs, rates, "left")
        cost = F.lit(0.0) if costs is None else F.coalesce("cost", F.lit(0.0))
        factors = held.withColumn("paid", cost).withColumn("factor", F.col("index") * ((1 - F.col("net") - F.col("paid")) / F.col("index_0") - spent) + F.col("value"))
        factors = stored(factors.select("annual", "k", "factor", "paid", "net"))
        before = factors.select(*(c for c in rates if c != "k"), (F.col("k") + 1).alias("k"), F.col("factor").alias("last"))
        first = trades.where("k = 0").withColumns({"annual": F.explode(every), "last": F.lit(1.0)})
        at = trades.join(before, "k") if not by_name else trades.join(before, "k").withColumn("annual", F.lit(None).cast("double"))
        moved = first.unionByName(at).groupBy(*rates).agg(F.sum(F.abs(F.col("weight") - F.try_divide("held", "last"))).alias("traded"))
        costs = moved.withColumn("cost", F.col("traded") * slippage)
    part, order = ([] if by_name else ["annual"]), Window.partitionBy(*([] if by_name else ["annual"])).orderBy("k")
    opening = index.join(periods.where("k = 0").select(F.col("fill_date").alias("date")).distinct(), "date").select(F.col("index").alias("open"))
    equity = factors.join(F.broadcast(opening)).withColumn("equity", capital * F.col("open") * F.coalesce(F.product("factor").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    alive = F.coalesce(F.min("factor").over(order.rowsBetween(Window.unboundedPreceding, -1)) > 0, F.lit(True))
    equity = stored(equity.withColumn("equity", F.when(alive, F.col("equity")).otherwise(0.0)).join(moved, rates, "left").select("annual", "k", "equity", "paid", "net", "traded"))
    rows = days.join(equity, "k")
    inside = F.col("index") * ((1 - F.col("net") - F.col("paid")) / F.col("index_0") - spent) + F.col("value")
    fills = periods.select("k", "fill_date", "next_fill").distinct()
    final = fills.agg(F.max("next_fill").alias("_final"))
    daily = rows.join(fills.select("k", "next_fill"), "k").join(F.broadcast(final)).where("date < next_fill or next_fill = _final").select("annual", "date", (F.col("equity") * inside).alias("nav"))
    on_fill = equity.join(fills, "k").select("annual", F.col("fill_date").alias("date"), (F.col("equity") * (1 - F.col("paid"))).alias("nav"))
    idle = index.join(F.broadcast(fills.agg(F.min("fill_date").alias("_first")))).where("date < _first").select(F.explode(every).alias("annual"), "date", (capital * F.col("index")).alias("nav"))
    nav = daily.unionByName(on_fill).unionByName(idle).withColumn("nav", F.greatest("nav", F.lit(0.0)))
    fee = F.col("fee") if by_name else F.col("annual") * F.col("short") / YEAR
    totals = rows.groupBy("annual", "k").agg(F.first("equity").alias("equity"), F.first("paid").alias("paid"), F.first("traded").alias("traded"), F.first("net").alias("net"), F.sum(fee).alias("fees"), F.sum(F.col("short") / YEAR).alias("shorts"), F.max_by(inside - F.col("value"), "date").alias("cash"))
    e = F.col("equity")
    sums = totals.groupBy("annual").agg(F.sum(e * F.col("traded")).alias("traded"), F.sum(e * F.col("paid")).alias("slippage"), F.sum(e * F.col("fees")).alias("borrow"), F.sum(e * (F.col("cash") - (1 - F.col("net") - F.col("paid")) + F.col("fees"))).alias("_earned"), F.sum(e * F.col("shorts")).alias("_shorts"))
    sums = sums.join(F.broadcast(opening)).select("annual", "traded", "slippage", "borrow", (F.col("_earned") + capital * (F.col("open") - 1)).alias("financing"), F.coalesce(F.try_divide("borrow", "_shorts"), "annual", F.lit(flat)).alias("effective_rate"))
    return nav.select("annual", "date", "nav"), sums


def borrow_curve(nav: DataFrame, sums: DataFrame, annual_cash: float) -> DataFrame:
    """annual, total_return, cagr, sharpe (over cash), max_drawdown, borrow, financing, effective_rate for each flat borrow rate."""
    made = performance(nav, ["annual"], (1 + annual_cash) ** (1 / YEAR) - 1)
    return made.select("annual", "total_return", "cagr", "sharpe", "max_drawdown").join(sums, "annual")
