"""Holding by rank: buy the best names, sell a name when its rank decays; trades, round trips and daily equity.

Membership needs ranks only: of each rebalance date the names that may stay (the best ``exit_rank``) and the best twice
``top_n`` names with a price, which is all that ``top_n`` slots can ask for. One fold over these short lists says who
enters and leaves. Then prices are joined to the changes, and one fold over the changes keeps cash. State is ``top_n``
positions at most, so both folds are bounded by the calendar, not by the universe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import commission, fill_price
from .portfolio import held_days


def membership(ranked: DataFrame, fills: DataFrame, prices: DataFrame, top_n: int, exit_rank: int) -> DataFrame:
    """k, fill_date, slots, side (1 in, -1 out), ticker, place (order of the trade within its date; exits first, by ticker).

    ``ranked`` has date, ticker, rk of the rebalance dates; ``fills`` k, date, fill_date. A held name stays while its rank is
    within ``exit_rank``; free slots go to the best names that are not held and have a price at the fill.
    """
    px = prices.select("ticker", F.col("date").alias("fill_date"), "adj_close")
    rows = ranked.join(fills, "date").join(px, ["ticker", "fill_date"], "left")
    priced = F.col("adj_close") > 0
    best = F.row_number().over(Window.partitionBy("k", priced).orderBy("rk"))
    rows = rows.withColumns({"_priced": F.coalesce(priced, F.lit(False)), "_place": best}).where(f"rk <= {exit_rank} or (_priced and _place <= {2 * top_n})")

    def names(keep):
        return F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("rk", "ticker")))), lambda s: s["ticker"])

    days = rows.groupBy("k", "fill_date").agg(names(F.col("rk") <= exit_rank).alias("stay"), names(F.col("_priced") & (F.col("_place") <= 2 * top_n)).alias("best"))
    path = days.agg(F.sort_array(F.collect_list(F.struct("k", "fill_date", "stay", "best"))).alias("days"))  # some dozens a year
    kind = dict(ranked.dtypes)["ticker"]
    no_names = F.array().cast(f"array<{kind}>")

    def step(state, x):
        kept = F.array_intersect(state["held"], x["stay"])
        slots = F.lit(top_n) - F.size(kept)
        enter = F.slice(F.array_except(x["best"], kept), F.lit(1), slots)
        change = F.struct(x["k"].alias("k"), x["fill_date"].alias("fill_date"), slots.alias("slots"), F.sort_array(F.array_except(state["held"], x["stay"])).alias("leave"), enter.alias("enter"))
        return F.struct(F.concat(kept, enter).alias("held"), F.concat(state["log"], F.array(change)).alias("log"))

    start = F.struct(no_names.alias("held"), F.expr(f"cast(array() as array<struct<k:bigint,fill_date:date,slots:int,leave:array<{kind}>,enter:array<{kind}>>>)").alias("log"))
    log = path.select(F.inline(F.aggregate("days", start, step)["log"]))
    sides = F.concat(F.transform("leave", lambda t, i: F.struct(F.lit(-1).alias("side"), t.alias("ticker"), i.alias("place"))), F.transform("enter", lambda t, i: F.struct(F.lit(1).alias("side"), t.alias("ticker"), (i + F.size("leave")).alias("place"))))
    return log.select("k", "fill_date", "slots", F.inline(sides))


def trades(changes: DataFrame, prices: DataFrame, capital: float, slippage: float = 0.0, per_share: float = 0.0, per_order: float = 0.0, scale: DataFrame | None = None) -> DataFrame:
    """k, date, ticker, side, shares, price (before slippage), flow (what cash gains), cost (slippage and commission).

    At each date the cash after exits, times ``scale`` (k, scale) if given, is dealt to the free slots; a purchase that the cash does
    not cover, commission included, is made smaller. A name without a price at its exit leaves at its entry price. A
    position keeps its slot even if the cash was too little for a share of it.
    """
    px = prices.select("ticker", F.col("date").alias("fill_date"), F.when(F.col("adj_close") > 0, F.col("adj_close")).alias("px"))
    rows = changes.join(px, ["ticker", "fill_date"], "left")
    rows = rows.withColumn("scale", F.lit(1.0)) if scale is None else rows.join(scale.select("k", "scale"), "k", "left").na.fill(1.0, ["scale"])
    first = F.row_number().over(Window.partitionBy("k", "side").orderBy("place")) == 1
    kind = dict(changes.dtypes)["ticker"]
    path = rows.withColumn("first", first).agg(F.sort_array(F.collect_list(F.struct("k", "place", "side", "ticker", "px", "slots", "scale", "first"))).alias("rows"))

    def step(state, x):
        buys = x["side"] > 0
        per = F.when(buys & x["first"], state["cash"] * x["scale"] / x["slots"]).otherwise(state["per"])
        buy_px = fill_price(x["px"], F.lit(1), slippage)
        bought = F.greatest(F.lit(0.0), F.least(per / buy_px, F.greatest(F.lit(0.0), state["cash"] - per_order) / (buy_px + per_share)))
        mine = F.filter(state["open"], lambda o: o["ticker"] == x["ticker"])
        shares = F.when(buys, bought).otherwise(F.element_at(mine, 1)["shares"])
        price = F.coalesce(x["px"], F.element_at(mine, 1)["px"])
        fee = F.when(shares > 0, commission(shares, per_share, per_order)).otherwise(0.0)
        flow = -x["side"] * shares * fill_price(price, x["side"], slippage) - fee
        made = F.struct(x["k"].alias("k"), x["ticker"].alias("ticker"), x["side"].alias("side"), shares.alias("shares"), price.alias("px"), flow.alias("flow"), (shares * price * slippage + fee).alias("cost"))
        rest = F.filter(state["open"], lambda o: o["ticker"] != x["ticker"])
        held = F.when(buys, F.concat(rest, F.array(F.struct(x["ticker"].alias("ticker"), shares.alias("shares"), price.alias("px"))))).otherwise(rest)
        return F.struct((state["cash"] + flow).alias("cash"), per.alias("per"), held.alias("open"), F.concat(state["log"], F.array(made)).alias("log"))

    start = F.struct(F.lit(float(capital)).alias("cash"), F.lit(0.0).alias("per"), F.expr(f"cast(array() as array<struct<ticker:{kind},shares:double,px:double>>)").alias("open"),
                     F.expr(f"cast(array() as array<struct<k:bigint,ticker:{kind},side:int,shares:double,px:double,flow:double,cost:double>>)").alias("log"))
    log = path.select(F.inline(F.aggregate("rows", start, step)["log"]))
    return log.join(changes.select("k", "fill_date").distinct(), "k").select("k", F.col("fill_date").alias("date"), "ticker", "side", "shares", F.col("px").alias("price"), "flow", "cost")


def round_trips(made: DataFrame) -> DataFrame:
    """ticker, entry_date, exit_date (null while open), shares, paid, received, net (return of a closed round trip), cost."""
    w = Window.partitionBy("ticker").orderBy("k", "side")
    nxt = made.withColumns({"_date": F.lead("date").over(w), "_flow": F.lead("flow").over(w), "_cost": F.lead("cost").over(w)})
    return nxt.where("side > 0").select("ticker", F.col("date").alias("entry_date"), F.col("_date").alias("exit_date"), "shares", (-F.col("flow")).alias("paid"), F.col("_flow").alias("received"), (F.try_divide(F.col("_flow"), -F.col("flow")) - 1).alias("net"), (F.col("cost") + F.coalesce("_cost", F.lit(0.0))).alias("cost"))


def equity(made: DataFrame, prices: DataFrame, sessions: DataFrame, capital: float, spells: bool = False) -> DataFrame:
    """date, nav: cash after all trades to date, and the open positions at the day's prices; with ``spells`` a price holds till the next one."""
    after = sessions.agg(F.date_add(F.max("date"), 1).alias("_after"))
    spans = round_trips(made).select("ticker", "shares", "entry_date", "exit_date").join(F.broadcast(after)).withColumn("_end", F.coalesce("exit_date", "_after"))
    marks = held_days(spans, prices, "entry_date", "_end", sessions if spells else None).groupBy(F.col("day").alias("date")).agg(F.sum(F.col("shares") * F.coalesce("mark", F.lit(0.0))).alias("marks"))
    flows = made.groupBy("date").agg(F.sum("flow").alias("flow"))
    so_far = F.sum(F.coalesce("flow", F.lit(0.0))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))  # a row a session
    return sessions.select("date").join(flows, "date", "left").join(marks, "date", "left").select("date", (capital + so_far + F.coalesce("marks", F.lit(0.0))).alias("nav"))
