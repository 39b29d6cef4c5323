"""The cash path of a long-short book against a day-by-day simulation."""

import datetime as dt
import random

import pytest

from panelspark.operators import cash_path as cp
from panelspark.operators.stats import performance


def day(i):
    return dt.date(2000, 1, 3) + dt.timedelta(days=i)


DAYS, NAMES, EVERY = 40, 8, 6


def _market(seed, jump=0.0):
    rng = random.Random(seed)
    px = {(d, t): 0.0 for d in range(DAYS) for t in range(NAMES)}
    for t in range(NAMES):
        p = 50.0 + t
        for d in range(DAYS):
            p *= 1 + rng.gauss(0, 0.02) + (jump if d == 20 and t < 2 else 0.0)
            px[d, t] = p
    books = {}
    for d in range(0, DAYS, EVERY):
        order = list(range(NAMES))
        rng.shuffle(order)
        books[d] = {order[0]: 0.25, order[1]: 0.25, order[2]: -0.3, order[3]: -0.2}
    rates = {(d, t): 0.02 * t for d in range(DAYS) for t in range(NAMES) if t != 3}
    return px, books, rates


def simulate(px, books, cash_rate, slippage, rate_of, capital=100_000.0):
    """A loop over days and positions, as an account is kept."""
    daily, cash, shares, nav = (1 + cash_rate) ** (1 / 252) - 1, capital, {}, []
    sums = dict.fromkeys(("traded", "slippage", "borrow", "financing", "notional"), 0.0)
    for d in range(DAYS):
        if d:
            fee = sum(-s * px[d, t] * rate_of(d, t) / 252 for t, s in shares.items() if s < 0)
            sums["notional"] += sum(-s * px[d, t] / 252 for t, s in shares.items() if s < 0)
            sums["financing"] += cash * daily
            sums["borrow"] += fee
            cash += cash * daily - fee
        if d - 1 in books and d < DAYS - 1:
            equity = cash + sum(s * px[d, t] for t, s in shares.items())
            want = {t: w * equity / px[d, t] for t, w in books[d - 1].items()}
            for t in set(want) | set(shares):
                change = want.get(t, 0.0) - shares.get(t, 0.0)
                cash -= change * px[d, t] + abs(change) * px[d, t] * slippage
                sums["traded"] += abs(change) * px[d, t]
                sums["slippage"] += abs(change) * px[d, t] * slippage
            shares = want
        nav.append(cash + sum(s * px[d, t] for t, s in shares.items()))
    return nav, sums


def _frames(spark, px, books, rates):
    prices = spark.createDataFrame([(day(d), t, p) for (d, t), p in px.items()], "date date, ticker long, adj_close double")
    book = spark.createDataFrame([(day(d), t, w) for d, b in books.items() for t, w in b.items()], "date date, ticker long, weight double")
    sessions = spark.createDataFrame([(day(d), d + 1) for d in range(DAYS)], "date date, session_no int")
    own = spark.createDataFrame([(day(d), t, r) for (d, t), r in rates.items()], "date date, ticker long, rate double")
    return prices, book, sessions, own


@pytest.mark.parametrize("slippage, cash_rate", [(0.0, 0.0), (0.001, 0.05)])
def test_flat_rates_equal_a_simulation(spark, slippage, cash_rate):
    px, books, rates = _market(1)
    prices, book, sessions, _ = _frames(spark, px, books, rates)
    curve = [0.0, 0.02, 0.3]
    nav, sums = cp.cash_path(cp.book_periods(book, prices, sessions, EVERY), prices, sessions, cash_rate, curve, slippage)
    got, totals = {}, {r["annual"]: r for r in sums.collect()}
    for r in nav.collect():
        got.setdefault(r["annual"], {})[r["date"]] = r["nav"]
    for annual in curve:
        want, spent = simulate(px, books, cash_rate, slippage, lambda d, t: annual)
        assert [got[annual][day(d)] for d in range(DAYS)] == pytest.approx(want, rel=1e-8)
        for name in ("traded", "slippage", "borrow", "financing"):
            assert totals[annual][name] == pytest.approx(spent[name], rel=1e-6, abs=1e-6), name
        assert totals[annual]["effective_rate"] == pytest.approx(annual)
    table = {r["annual"]: r for r in cp.borrow_curve(nav, sums, cash_rate).collect()}
    returns = [table[a]["total_return"] for a in curve]
    assert returns == sorted(returns, reverse=True) and [table[a]["borrow"] for a in curve] == sorted(table[a]["borrow"] for a in curve)


def test_rates_by_name_equal_a_simulation(spark):
    px, books, rates = _market(2)
    prices, book, sessions, own = _frames(spark, px, books, rates)
    nav, sums = cp.cash_path(cp.book_periods(book, prices, sessions, EVERY), prices, sessions, 0.03, own, 0.0005, flat=0.07)
    want, spent = simulate(px, books, 0.03, 0.0005, lambda d, t: rates.get((d, t), 0.07))
    assert {r["date"]: r["nav"] for r in nav.collect()} == pytest.approx({day(d): v for d, v in enumerate(want)}, rel=1e-8)
    row = sums.first()
    assert row["borrow"] == pytest.approx(spent["borrow"]) and row["financing"] == pytest.approx(spent["financing"])
    assert row["effective_rate"] == pytest.approx(spent["borrow"] / spent["notional"])


def test_cash_alone_and_a_dated_cash_rate(spark):
    px, books, rates = _market(3)
    prices, book, sessions, _ = _frames(spark, px, books, rates)
    dated = sessions.select("date", (0.01 * (1 + (sessions["session_no"] > 20).cast("int"))).alias("rate")).where("dayofmonth(date) % 3 = 0")
    index = {r["date"]: r["index"] for r in cp.cash_index(sessions, dated).collect()}
    assert index[day(0)] == 1.0 and list(index.values()) == sorted(index.values())
    flat = {r["date"]: r["index"] for r in cp.cash_index(sessions, 0.05).collect()}
    assert flat[day(39)] == pytest.approx(1.05 ** (39 / 252))
    nav, _ = cp.cash_path(cp.book_periods(book.limit(0), prices, sessions, EVERY), prices, sessions, 0.05, [0.01])
    assert nav.count() == 0  # a book that is never filled has no path


def test_a_spent_book_stays_at_zero(spark):
    px, books, rates = _market(4)
    books = {d: {t: 8 * w for t, w in b.items()} for d, b in books.items()}
    for d in range(20, DAYS):
        for t in range(NAMES):
            px[d, t] *= 3.0 if books[18].get(t, 0) < 0 else 0.3
    prices, book, sessions, _ = _frames(spark, px, books, rates)
    nav, _ = cp.cash_path(cp.book_periods(book, prices, sessions, EVERY), prices, sessions, 0.0, [0.0])
    last = {r["date"]: r["nav"] for r in nav.collect()}
    assert last[day(26)] == 0.0 and last[day(DAYS - 1)] == 0.0
    assert performance(nav.where("nav > 0"), ["annual"]).count() == 1
