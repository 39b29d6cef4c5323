"""Accounts and positions: valuation, halts, expiries, order sizing, the gate for new positions, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import mark_price


def valuation(accounts: DataFrame, positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """account_id, cash, invested, nav, n_stale: shares at the live quote, else the last seen price, else the entry price."""
    q = quotes.select("ticker", "quote", "seen")
    p = positions.join(q, "ticker", "left").withColumn("mark", mark_price(F.col("quote"), F.col("seen"), F.col("entry_price")))
    stale = F.coalesce(F.col("quote") <= 0, F.lit(True))
    sums = p.groupBy("account_id").agg(F.sum(F.col("shares") * F.col("mark")).alias("invested"), F.count_if(stale).alias("n_stale"))
    return accounts.join(sums, "account_id", "left").select("account_id", "cash", F.coalesce("invested", F.lit(0.0)).alias("invested"), (F.col("cash") + F.coalesce("invested", F.lit(0.0))).alias("nav"), F.coalesce("n_stale", F.lit(0)).alias("n_stale"), "high_watermark")


def halts(valued: DataFrame, limit: float) -> DataFrame:
    """Drawdown from the high watermark (or today's value, if higher), and if it halts the account."""
    top = F.greatest("high_watermark", "nav")
    return valued.select("account_id", "nav", top.alias("high_watermark"), (F.col("nav") / top - 1).alias("drawdown"), (F.col("nav") / top - 1 < -limit).alias("halted"))


def expiring(positions: DataFrame, as_of) -> DataFrame:
    return positions.where(F.col("expiry_date") <= as_of)


def cohort_pnl(positions: DataFrame, quotes: DataFrame, as_of) -> DataFrame:
    """account_id, entry_date, pnl, names of expired cohorts."""
    p = expiring(positions, as_of).join(quotes.select("ticker", "quote", "seen"), "ticker", "left")
    gain = F.col("shares") * (mark_price(F.col("quote"), F.col("seen"), F.col("entry_price")) - F.col("entry_price"))
    whole = F.sum(F.floor(gain * 10000 + 0.5))  # a sum that does not depend on the order
    return p.groupBy("account_id", "entry_date").agg((whole / 10000.0).alias("pnl"), F.count("*").alias("names"))


def size_orders(targets: DataFrame, capital: DataFrame, slippage: float, per_share: float, per_order: float) -> DataFrame:
    """Whole shares for each account's targets (account_id, rk, ticker, weight, price), spending in rank order.

    Targets of an account are a handful; one fold over them carries what is spent, fees included.
    """
    t = F.struct("rk", "ticker", "weight", "price")
    rows = targets.groupBy("account_id").agg(F.sort_array(F.collect_list(t)).alias("ts")).join(capital, "account_id")
    empty = F.expr("cast(array() as array<struct<ticker:bigint,shares:bigint,cost:double>>)")

    def step(state, x):
        fill = x["price"] * (1 + slippage)
        budget = F.least(x["weight"] * F.col("capital"), F.col("capital") - state["spent"])
        shares = F.greatest(F.lit(0), F.floor((budget - per_order) / (fill + per_share))).cast("long")
        cost = F.when(shares > 0, shares * (fill + per_share) + per_order).otherwise(0.0)
        order = F.struct(x["ticker"].alias("ticker"), shares.alias("shares"), cost.alias("cost"))
        return F.struct((state["spent"] + cost).alias("spent"), F.concat(state["orders"], F.array(order)).alias("orders"))

    start = F.struct(F.lit(0.0).alias("spent"), empty.alias("orders"))
    return rows.select("account_id", F.explode(F.aggregate("ts", start, step)["orders"]).alias("o")).select("account_id", "o.*").where("shares > 0")


def open_gate(accounts: DataFrame, signal_date, on_schedule: bool, force: bool = False) -> DataFrame:
    """May an account (halted, last_signal_date) open positions? Force passes schedule and repeats, never a halt."""
    fresh = F.coalesce(F.col("last_signal_date") < F.lit(signal_date), F.lit(True)) & F.lit(on_schedule)
    return accounts.withColumn("may_open", ~F.col("halted") & (fresh | F.lit(force)))


def signal_summary(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """account_id, buys, sells, holds, turnover (names traded over names in either basket)."""
    a = held.select("account_id", "ticker").distinct().withColumn("_h", F.lit(1))
    b = wanted.select("account_id", "ticker").distinct().withColumn("_w", F.lit(1))
    j = a.join(b, ["account_id", "ticker"], "full_outer")
    h, w = F.col("_h").isNotNull(), F.col("_w").isNotNull()
    return j.groupBy("account_id").agg(F.count_if(~h & w).alias("buys"), F.count_if(h & ~w).alias("sells"), F.count_if(h & w).alias("holds"), (F.count_if(h != w) / F.count("*")).alias("turnover"))
