"""Books read prices where a name trades; the dense grid gives the same and is not built."""

import datetime as dt
import random

from pyspark.sql import functions as F

from panelspark.operators import labels, pit, portfolio


def day(i):
    return dt.date(2000, 1, 1) + dt.timedelta(days=i)


def tables(spark):
    rng = random.Random(5)
    bars = spark.createDataFrame([(day(i), t, float(rng.randint(1, 99))) for t in range(6) for i in range(0, 150, 1 if t == 0 else 2) if t == 0 or rng.random() < 0.15], "date date, ticker long, adj_close double")
    legs = spark.createDataFrame([(k, t, day(a), day(a + n)) for k, (t, a, n) in enumerate((rng.randint(0, 5), rng.randint(0, 140), rng.choice((0, 1, 5, 40))) for _ in range(60))], "k int, ticker long, start date, stop date")
    return bars, legs, pit.sessions_of(bars), labels.ffill_prices(labels.dense_grid(bars)).select("date", "ticker", "adj_close")


def test_days_of_spells_are_those_of_the_grid(spark):
    bars, legs, sessions, prices = tables(spark)
    want = portfolio.held_days(legs, prices, "start", "stop").where("mark is not null")
    got = portfolio.held_days(legs, bars, "start", "stop", sessions)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() > 100


def test_prices_at_both_ends_are_those_of_the_grid(spark):
    bars, legs, _, prices = tables(spark)
    inside = legs.where(F.col("stop") < F.lit(day(150)))
    want = {(r["ticker"], r["date"]): r["adj_close"] for r in prices.collect()}
    got = portfolio.priced(inside, bars, "start", "stop").collect()
    assert len(got) == inside.count() and all((r["p0"], r["p1"]) == (want[r["ticker"], r["start"]], want[r["ticker"], r["stop"]]) for r in got)
