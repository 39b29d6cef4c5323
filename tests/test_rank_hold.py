"""Holding by rank against a loop over dates that keeps an account."""

import datetime as dt
import random

import pytest

from panelspark.operators import rank_hold


def day(i):
    return dt.date(2000, 1, 3) + dt.timedelta(days=i)


def market(seed, days=40, names=12, every=4):
    rng = random.Random(seed)
    px = {(d, t): None if rng.random() < 0.05 else 20.0 + 3 * t + rng.gauss(0, 2) for d in range(days) for t in range(names)}
    ranks = {}
    for d in range(0, days - 1, every):
        here = [t for t in range(names) if rng.random() < 0.8]
        rng.shuffle(here)
        ranks[d] = here
    return px, ranks


def simulate(px, ranks, days, top_n, exit_rank, capital, slip, per_share, per_order, scale=None):
    cash, held, made, flows = capital, {}, [], {}
    for k, (d, order) in enumerate(sorted(ranks.items()), 1):
        for t in sorted(x for x in held if x not in order[:exit_rank]):
            shares, entry = held.pop(t)
            p = px[d + 1, t] or entry
            fee = shares * per_share + per_order if shares > 0 else 0.0
            flow = shares * p * (1 - slip) - fee
            made.append((k, t, -1, shares, p, flow, shares * p * slip + fee))
            cash += flow
            flows[d + 1] = flows.get(d + 1, 0.0) + flow
        slots, per = top_n - len(held), None
        wanted = [t for t in order if px[d + 1, t] and t not in held][:slots]
        for t in wanted:
            per = cash * (scale or {}).get(k, 1.0) / slots if per is None else per
            buy = px[d + 1, t] * (1 + slip)
            shares = per / buy
            if per + shares * per_share + per_order > cash + 1e-9:
                shares = max(0.0, cash - per_order) / (buy + per_share)
            fee = shares * per_share + per_order if shares > 0 else 0.0
            flow = -shares * buy - fee
            held[t] = (shares, px[d + 1, t])
            made.append((k, t, 1, shares, px[d + 1, t], flow, shares * px[d + 1, t] * slip + fee))
            cash += flow
            flows[d + 1] = flows.get(d + 1, 0.0) + flow
    nav, cash, open_now, by_day = [], capital, {}, {}
    for k, t, side, shares, *_ in made:
        by_day.setdefault(sorted(ranks)[k - 1] + 1, []).append((t, side, shares))
    for d in range(days):
        cash += flows.get(d, 0.0)
        for t, side, shares in by_day.get(d, []):
            open_now.pop(t, None)
            if side > 0:
                open_now[t] = shares
        nav.append(cash + sum(s * (px[d, t] or 0.0) for t, s in open_now.items()))
    return made, nav


@pytest.mark.parametrize("seed, top_n, exit_rank, fees, scaled", [(1, 3, 5, (0.0, 0.0, 0.0), False), (2, 4, 4, (0.001, 0.01, 1.0), False), (3, 5, 9, (0.002, 0.0, 2.0), True)])
def test_trades_and_equity_equal_a_loop(spark, seed, top_n, exit_rank, fees, scaled):
    px, ranks = market(seed)
    capital = 5000.0
    scale = {k: 0.5 + 0.5 * (k % 2) for k in range(1, 20)} if scaled else None
    want, want_nav = simulate(px, ranks, 40, top_n, exit_rank, capital, *fees, scale)
    prices = spark.createDataFrame([(day(d), t, p) for (d, t), p in px.items()], "date date, ticker long, adj_close double")
    ranked = spark.createDataFrame([(day(d), t, i + 1) for d, order in ranks.items() for i, t in enumerate(order)], "date date, ticker long, rk int")
    fills = spark.createDataFrame([(k, day(d), day(d + 1)) for k, d in enumerate(sorted(ranks), 1)], "k long, date date, fill_date date")
    sessions = spark.createDataFrame([(day(d), d + 1) for d in range(40)], "date date, session_no int")
    changes = rank_hold.membership(ranked, fills, prices, top_n, exit_rank)
    made = rank_hold.trades(changes, prices, capital, *fees, scale=spark.createDataFrame(list(scale.items()), "k long, scale double") if scaled else None)
    got = {(r["k"], r["ticker"], r["side"]): (r["shares"], r["price"], r["flow"], r["cost"]) for r in made.collect()}
    assert got.keys() == {m[:3] for m in want}
    for k, t, side, *values in want:
        assert got[k, t, side] == pytest.approx(tuple(values), rel=1e-9, abs=1e-9)
    nav = [r["nav"] for r in rank_hold.equity(made, prices, sessions, capital).orderBy("date").collect()]
    assert nav == pytest.approx(want_nav, rel=1e-9)
    trips = rank_hold.round_trips(made).collect()
    assert len(trips) == sum(m[2] > 0 for m in want) and sum(r["cost"] for r in trips) == pytest.approx(sum(m[6] for m in want))


def test_nothing_ranked_nothing_traded(spark):
    prices = spark.createDataFrame([(day(0), 1, 1.0)], "date date, ticker long, adj_close double")
    fills = spark.createDataFrame([(1, day(0), day(1))], "k long, date date, fill_date date")
    changes = rank_hold.membership(spark.createDataFrame([], "date date, ticker long, rk int"), fills, prices, 3, 5)
    assert rank_hold.trades(changes, prices, 100.0).count() == 0
    nav = rank_hold.equity(rank_hold.trades(changes, prices, 100.0), prices, spark.createDataFrame([(day(0), 1)], "date date, session_no int"), 100.0)
    assert [r["nav"] for r in nav.collect()] == [100.0]
