"""Portfolios as set operations: cohorts, NAV, spells, long-short books, turnover, borrow, sweeps, benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import exposure_scale  # noqa: F401
from ..functions.windows import last_known, next_known
from ..sources.stored import stored
from .pit import asof_backward
from .selection import SelectionRules, targets
from .stats import downside_deviation, performance


def cohort_legs(signals: DataFrame, prices: DataFrame, sessions: DataFrame, hold: int | Column, keys: tuple[str, ...] = (), slippage: float = 0.0, per_share: float = 0.0) -> DataFrame:
    """Legs of each signal's basket: entry at the next session, exit ``hold`` sessions later; names without a price at
    either end drop out and the rest are weighed again. ``net`` is after slippage and a commission for each share at both ends.

    ``signals`` has keys, date, ticker, weight; ``prices`` hold till the name's next one, so bars will do (see ``priced``).
    """
    s = sessions.select("date", "session_no")
    hold = F.lit(hold) if isinstance(hold, int) else hold
    legs = signals.join(s, "date").withColumns({"entry_no": F.col("session_no") + 1, "exit_no": F.col("session_no") + 1 + hold})
    for end in ("entry", "exit"):
        legs = legs.join(F.broadcast(s.select(F.col("session_no").alias(f"{end}_no"), F.col("date").alias(f"{end}_date"))), f"{end}_no")
    legs = stored(legs.select(*keys, "date", "ticker", "weight", "entry_date", "exit_date"))  # few, and read twice; what ranks them runs once
    legs = priced(legs, prices, "entry_date", "exit_date").withColumnsRenamed({"p0": "entry_px", "p1": "exit_px"}).where("entry_px > 0 and exit_px is not null")
    basket = Window.partitionBy(*keys, "date")
    gross = F.col("exit_px") / F.col("entry_px") - 1
    net = (F.col("exit_px") * (1 - slippage) - 2 * per_share) / (F.col("entry_px") * (1 + slippage)) - 1
    return legs.select(*keys, F.col("date"), "ticker", (F.col("weight") / F.sum("weight").over(basket)).alias("weight"), "entry_date", "exit_date", "entry_px", "exit_px", gross.alias("gross"), net.alias("net"))


def cohort_returns(legs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    w = F.col("weight")
    return legs.groupBy(*keys, "date").agg(F.min("entry_date").alias("entry_date"), F.min("exit_date").alias("exit_date"), F.sum(w * F.col("gross")).alias("gross"), F.sum(w * F.col("net")).alias("net"), F.count("*").alias("names"))


def admit(cohorts: DataFrame, slots: int, capital: float, keys: tuple[str, ...] = ("config_id",), scale: str | None = None, per_order: float = 0.0) -> DataFrame:
    """Which cohorts are opened, and with how much: exits before a signal are settled, a free slot gets cash / free slots,
    times the column ``scale`` of the cohort if there is one. ``net`` is after a commission for each order at both ends
    (``names`` of the cohort), whose share of the amount is known only here.

    One fold over the array of a configuration's cohorts (some dozens a year); open cohorts are at most ``slots``.
    """
    fees = F.col("names") * 2 * per_order if per_order else F.lit(0.0)
    c = F.struct("date", "entry_date", "exit_date", "net", (F.col(scale) if scale else F.lit(1.0)).alias("scale"), fees.alias("fees"))
    path = cohorts.groupBy(*keys).agg(F.sort_array(F.collect_list(c)).alias("cs"))
    empty = F.expr("cast(array() as array<struct<date:date,exit_date:date,amount:double,net:double>>)")

    def step(state, x):
        settled = F.filter(state["open"], lambda o: o["exit_date"] < x["date"])
        still = F.filter(state["open"], lambda o: o["exit_date"] >= x["date"])
        cash = state["cash"] + F.aggregate(settled, F.lit(0.0), lambda a, o: a + o["amount"] * (1 + o["net"]))
        free = F.lit(slots) - F.size(still)
        amount = F.when((free > 0) & (cash > 0), cash / F.greatest(free, F.lit(1)) * x["scale"]).otherwise(0.0)
        net = x["net"] - F.coalesce(F.try_divide(x["fees"], amount), F.lit(0.0))
        opened = F.struct(x["date"].alias("date"), x["exit_date"].alias("exit_date"), amount.alias("amount"), net.alias("net"))
        taken = amount > 0
        return F.struct((cash - amount).alias("cash"), F.when(taken, F.concat(still, F.array(opened))).otherwise(still).alias("open"), F.when(taken, F.concat(state["done"], F.array(opened))).otherwise(state["done"]).alias("done"))

    start = F.struct(F.lit(float(capital)).alias("cash"), empty.alias("open"), empty.alias("done"))
    return path.select(*keys, F.explode(F.aggregate("cs", start, step)["done"]).alias("c")).select(*keys, "c.date", "c.exit_date", "c.amount", "c.net")


def cohort_equity(legs: DataFrame, admitted: DataFrame, sessions: DataFrame, prices: DataFrame, capital: float, keys: tuple[str, ...], slippage: float = 0.0) -> DataFrame:
    """keys, date, nav of all configurations: an admitted cohort's amount leaves cash at its entry, comes back with its net return at its
    exit, and is marked between against what was paid for it. ``legs`` and ``admitted`` should be stored tables."""
    held = legs.join(admitted.select(*keys, "date", "amount"), [*keys, "date"]).withColumn("units", F.col("amount") * F.col("weight") / (F.col("entry_px") * (1 + slippage)))
    opened = legs.groupBy(*keys, "date").agg(F.min("entry_date").alias("entry_date"))
    sides = F.array(F.struct(F.col("entry_date").alias("day"), (-F.col("amount")).alias("flow")), F.struct(F.col("exit_date").alias("day"), (F.col("amount") * (1 + F.col("net"))).alias("flow")))
    flows = admitted.join(opened, [*keys, "date"]).select(*keys, F.inline(sides)).groupBy(*keys, "day").agg(F.sum("flow").alias("flow"))
    marks = held_days(held, prices, "entry_date", "exit_date", sessions).groupBy(*keys, "day").agg(F.sum(F.col("units") * F.col("mark")).alias("marks"))
    events = flows.select("*", F.lit(None).cast("double").alias("marks")).unionByName(marks.select(*keys, "day", F.lit(None).cast("double").alias("flow"), "marks"))
    calendar = admitted.select(*keys).distinct().join(F.broadcast(sessions.select(F.col("date").alias("day")))).select(*keys, "day", F.lit(None).cast("double").alias("flow"), F.lit(None).cast("double").alias("marks"))
    daily = events.unionByName(calendar).groupBy(*keys, "day").agg(F.sum("flow").alias("flow"), F.sum("marks").alias("marks"))
    so_far = F.sum(F.coalesce("flow", F.lit(0.0))).over(Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return daily.select(*keys, F.col("day").alias("date"), (capital + so_far + F.coalesce("marks", F.lit(0.0))).alias("nav"))


def admitted_costs(admitted: DataFrame, legs: DataFrame, keys: tuple[str, ...], slippage: float, per_share: float, per_order: float) -> DataFrame:
    """keys, n_cohorts, win_rate, total_costs (slippage and commissions by share and by order, at both ends) of the admitted cohorts."""
    shares = legs.groupBy(*keys, "date").agg(F.sum(F.col("weight") / (F.col("entry_px") * (1 + slippage))).alias("_shares"), F.count("*").alias("_names"))
    cost = F.col("amount") * (2 * slippage + 2 * per_share * F.col("_shares")) + 2 * per_order * F.col("_names")
    return admitted.join(shares, [*keys, "date"]).groupBy(*keys).agg(F.count("*").alias("n_cohorts"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.sum(cost).alias("total_costs"))


def priced(legs: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """``legs`` (each row once) with p0 and p1, the last known prices at two dates. ``prices`` has date, ticker, adj_close where a name trades;
    one shuffle by ticker, and names without a leg do not take part."""
    known = prices.where("adj_close is not null").join(legs.select("ticker").distinct(), "ticker", "left_semi").select("ticker", "date", "adj_close")
    ends = legs.select("*", F.posexplode(F.array(start, end)).alias("_end", "_day"))
    found = asof_backward(ends, known, ["adj_close"], "_day")
    return found.groupBy(*legs.columns).agg(*(F.max(F.when(F.col("_end") == i, F.col("adj_close"))).alias(f"p{i}") for i in (0, 1)))


def held_days(legs: DataFrame, prices: DataFrame, start: str, end: str, sessions: DataFrame | None = None) -> DataFrame:
    """A row for each leg and day with a price from ``start`` to before ``end``: the leg with day and mark. Joined by ticker and
    month, so that a leg meets the months it is held and not the whole history of its ticker.

    With ``sessions``, ``prices`` are those of the days on which a name trades, and each holds till the next one: a leg meets these spells
    and then the days of both, so what is shuffled grows with bars and legs, not with the grid. Without, they are filled on the grid."""
    if sessions is not None:
        last = F.broadcast(sessions.agg(F.date_add(F.max("date"), 1).alias("_after")))
        known = prices.where("adj_close is not null").join(legs.select("ticker").distinct(), "ticker", "left_semi")
        until = F.coalesce(F.lead("date").over(Window.partitionBy("ticker").orderBy("date")), "_after")
        spells = known.join(last).select("ticker", F.col("adj_close").alias("mark"), F.col("date").alias("_since"), until.alias("_until"))
        months = [F.explode(F.sequence(F.trunc(a, "month"), F.trunc(F.date_sub(b, 1), "month"), F.expr("interval 1 month"))).alias("_month") for a, b in (("_since", "_until"), (start, end))]
        both = legs.where(F.col(start) < F.col(end)).select("*", months[1]).join(spells.where("_since < _until").select("*", months[0]), ["ticker", "_month"])
        both = both.where((F.col("_since") < F.col(end)) & (F.col("_until") > F.col(start)))
        days = sessions.select(F.trunc("date", "month").alias("_month"), F.col("date").alias("day"))
        inside = (F.col("day") >= F.greatest(start, "_since")) & (F.col("day") < F.least(end, "_until"))
        return both.join(F.broadcast(days), "_month").where(inside).drop("_month", "_since", "_until")
    month = F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))).alias("_month")
    px = prices.select("ticker", F.trunc("date", "month").alias("_month"), F.col("date").alias("day"), F.col("adj_close").alias("mark"))
    return legs.select("*", month).join(px, ["ticker", "_month"]).where((F.col("day") >= F.col(start)) & (F.col("day") < F.col(end))).drop("_month")


def daily_nav(legs: DataFrame, amounts: DataFrame, sessions: DataFrame, prices: DataFrame, capital: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """NAV of each session: cash after all flows to date plus marks of the open legs. A leg's exit day is cash already."""
    held = legs.join(amounts.select(*keys, "date", "amount"), [*keys, "date"]).withColumn("units", F.col("amount") * F.col("weight") / F.col("entry_px"))
    flows = held.select(*keys, F.col("entry_date").alias("day"), (-F.col("units") * F.col("entry_px")).alias("flow")).unionByName(held.select(*keys, F.col("exit_date").alias("day"), (F.col("units") * F.col("entry_px") * (1 + F.col("net"))).alias("flow")))
    flows = flows.groupBy(*keys, "day").agg(F.sum("flow").alias("flow"))
    marks = held_days(held, prices, "entry_date", "exit_date", sessions).groupBy(*keys, F.col("day")).agg(F.sum(F.col("units") * F.col("mark")).alias("marks"))
    days = sessions.select(F.col("date").alias("day"))
    if keys:
        days = legs.select(*keys).distinct().join(F.broadcast(days))
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    both = days.join(flows, [*keys, "day"], "left").join(marks, [*keys, "day"], "left")
    return both.select(*keys, F.col("day").alias("date"), (capital + F.sum(F.coalesce("flow", F.lit(0.0))).over(w) + F.coalesce("marks", F.lit(0.0))).alias("nav"))


def rank_hold_spells(ranking: DataFrame, top_n: int, exit_rank: int) -> DataFrame:
    """Spells of membership: in at rank <= top_n, out at rank > exit_rank or absent, unchanged between.

    ``ranking`` has every (date, ticker) of the rebalance grid with rk (null if absent).
    """
    t = Window.partitionBy("ticker").orderBy("date")
    change = F.when(F.col("rk") <= top_n, 1).when(F.col("rk").isNull() | (F.col("rk") > exit_rank), 0)
    state = ranking.withColumn("_in", F.coalesce(F.last(change, ignorenulls=True).over(t.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    state = state.withColumn("_start", ((F.col("_in") == 1) & (F.coalesce(F.lag("_in").over(t), F.lit(0)) == 0)).cast("int"))
    state = state.withColumn("spell", F.sum("_start").over(t.rowsBetween(Window.unboundedPreceding, 0))).where("_in = 1")
    return state.groupBy("ticker", "spell").agg(F.min("date").alias("entry_date"), F.max("date").alias("last_date"), F.count("*").alias("periods"))


def long_short_periods(book: DataFrame, prices: DataFrame, fills: DataFrame) -> DataFrame:
    """Growth of each leg between fills: k, ticker, weight, growth. ``fills`` has date (signal), k, fill_date, next_fill."""
    legs = book.join(fills, "date").select("k", "ticker", "weight", "fill_date", "next_fill")
    return priced(stored(legs.where("next_fill is not null")), prices, "fill_date", "next_fill").where("p0 > 0 and p1 is not null").select("k", "ticker", "weight", "fill_date", "next_fill", "p0", (F.col("p1") / F.col("p0")).alias("growth"))


def long_short_nav(periods: DataFrame, cost: float = 0.0, turnover: DataFrame | None = None, borrow: DataFrame | None = None) -> DataFrame:
    """k, factor, nav, ruined: equity after each period for a full reconstitution at every fill, less trading costs (see
    ``book_turnover``) and borrow fees (see ``borrow_accrual``), both shares of the period's first equity. Equity that is spent stays 0."""
    f = periods.groupBy("k").agg((1 + F.sum(F.col("weight") * (F.col("growth") - 1))).alias("factor"))
    if turnover is not None:
        f = f.join(turnover, "k", "left").withColumn("factor", F.col("factor") - F.coalesce("turnover", F.lit(0.0)) * cost).drop("turnover", "names")
    if borrow is not None:
        f = f.join(borrow, "k", "left").withColumn("factor", F.col("factor") - F.coalesce("borrow", F.lit(0.0))).drop("borrow")
    so_far = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ruined = F.min("factor").over(so_far) <= 0
    return f.withColumns({"ruined": ruined, "nav": F.when(ruined, 0.0).otherwise(F.product("factor").over(so_far))})


def book_turnover(periods: DataFrame) -> DataFrame:
    """k, turnover: absolute weight traded at each fill against the drifted book before it."""
    g = periods.groupBy("k").agg((1 + F.sum(F.col("weight") * (F.col("growth") - 1))).alias("_g"))
    drifted = periods.join(g, "k").select((F.col("k") + 1).alias("k"), "ticker", (F.col("weight") * F.col("growth") / F.col("_g")).alias("u"))
    kept = periods.select("k").distinct()
    both = periods.select("k", "ticker", "weight").join(drifted, ["k", "ticker"], "full_outer").join(kept, "k", "left_semi")
    return both.groupBy("k").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("u", F.lit(0.0)))).alias("turnover"), F.count("*").alias("names"))


def borrow_accrual(periods: DataFrame, prices: DataFrame, rates: DataFrame | None, flat: float, sessions: DataFrame | None = None) -> DataFrame:
    """k, borrow: cost of the short legs over a period, by the daily mark of each and its rate (a flat one if unknown). ``rates`` has date,
    ticker, rate, or ticker, rate for all days; ``prices`` and ``sessions`` are those of ``held_days``."""
    short = periods.where("weight < 0").select("k", "ticker", "weight", "fill_date", "next_fill", "p0")
    by_day = rates is not None and "date" in rates.columns
    if not by_day:
        short = short.withColumn("rate", F.lit(None).cast("double")) if rates is None else short.join(rates.select("ticker", "rate"), "ticker", "left")
    days = held_days(short, prices, "fill_date", "next_fill", sessions).withColumnsRenamed({"day": "date", "mark": "adj_close"})
    if by_day:
        days = days.join(rates.select("date", "ticker", "rate"), ["date", "ticker"], "left")
    cost = -F.col("weight") * F.col("adj_close") / F.col("p0") * F.coalesce("rate", F.lit(flat)) / 252
    return days.groupBy("k").agg(F.sum(cost).alias("borrow"))


def with_hedge(book: DataFrame, benchmark: DataFrame, beta: float, hedge_ticker: int = -1) -> DataFrame:
    """A short leg of the benchmark added to every book after selection. ``book`` is read twice, so it should be a stored table."""
    leg = book.select("date").distinct().join(benchmark.select("date", "close"), "date").select("date", F.lit(hedge_ticker).cast("long").alias("ticker"), F.col("close").alias("adj_close"), F.lit(-beta).alias("weight"))
    return book.select("date", "ticker", "adj_close", "weight").unionByName(leg)


def align(series: DataFrame, calendar: DataFrame, value: str, capital: float) -> DataFrame:
    """Series on a calendar: filled forward, then backward, scaled to start at the capital."""
    j = calendar.select("date").join(series.select("date", value), "date", "left")
    j = j.select("date", F.coalesce(last_known(F.col(value)), next_known(F.col(value))).alias("v"))
    return j.select("date", (F.col("v") / F.first("v").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * capital).alias("nav"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two NAV series on their common dates, both starting at 1."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    j = a.select("date", F.col("nav").alias("a")).join(b.select("date", F.col("nav").alias("b")), "date")
    return j.select("date", (F.col("a") / F.first("a").over(w)).alias("nav_a"), (F.col("b") / F.first("b").over(w)).alias("nav_b"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    both = overlap(a, b)
    long = both.select("date", F.lit("a").alias("strategy"), F.col("nav_a").alias("nav")).unionByName(both.select("date", F.lit("b").alias("strategy"), F.col("nav_b").alias("nav")))
    return performance(long, ["strategy"])


def sweep_signals(scored: DataFrame, configs: list[tuple[int, int, int, int]]) -> DataFrame:
    """Targets of many configurations (config_id, top_n, holding_days, rank_offset) at once: names are ranked once,
    and each row goes to the configurations whose range of ranks holds it. Configurations are literals of the plan."""
    ranked = scored.where((F.col("adj_close") > 0) & F.col("prob").isNotNull()).withColumn("_rk", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("prob"), "ticker")))
    names = ("config_id", "top_n", "holding_days", "rank_offset")
    every = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, c, strict=True))) for c in configs))
    fits = F.filter(every, lambda c: (F.col("_rk") > c["rank_offset"]) & (F.col("_rk") <= c["rank_offset"] + c["top_n"]))
    j = ranked.select("date", "ticker", F.inline(fits))
    return j.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("config_id", "date"))).select("config_id", "holding_days", "date", "ticker", "weight")


def sweep(scored: DataFrame, configs: list[tuple[int, int, int, int]], prices: DataFrame, sessions: DataFrame, slippage: float = 0.0005) -> DataFrame:
    """One row for each configuration: cohorts, mean and deviation of net returns, share of gains."""
    legs = cohort_legs(sweep_signals(scored, configs), prices, sessions, F.col("holding_days"), ("config_id",), slippage)
    c = cohort_returns(legs, ("config_id",))
    return c.groupBy("config_id").agg(F.count("*").alias("n_cohorts"), F.avg("net").alias("mean_net"), F.stddev_samp("net").alias("std_net"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), downside_deviation(F.col("net")).alias("downside"))


def cohort_costs(cohorts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, cost (what trading takes from the gross returns, in parts of capital), win_rate (share of cohorts that gain after it)."""
    return cohorts.groupBy(*keys).agg(F.sum(F.col("gross") - F.col("net")).alias("cost"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"))


def realised_rate(panel: DataFrame, column: str = "irx_yield") -> DataFrame:
    """date, rate: the first known value of each date, filled forward then backward, in parts of one."""
    d = panel.groupBy("date").agg(F.min(column).alias("v"))
    return d.select("date", (F.coalesce(last_known(F.col("v")), next_known(F.col("v"))) / 100).alias("rate"))


def run_backtest(scored: DataFrame, rules: SelectionRules, prices: DataFrame, sessions: DataFrame, hold: int, slots: int, capital: float) -> tuple[DataFrame, DataFrame]:
    """Admitted cohorts and the daily NAV of one rule set."""
    legs = cohort_legs(targets(scored, rules), prices, sessions, hold).withColumn("config_id", F.lit(1))
    admitted = admit(cohort_returns(legs, ("config_id",)), slots, capital)
    return admitted, daily_nav(legs, admitted, sessions, prices, capital, ("config_id",))
