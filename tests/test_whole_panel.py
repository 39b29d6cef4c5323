"""The whole feature panel: what is known when, one union of all events of a ticker, and its shuffles."""

import datetime as dt

from panelspark.operators import features, fundamentals
from panelspark.plans.base import Tables
from panelspark.plans.join_queries import whole_panel
from panelspark.sources.stored import stored


def day(i):
    return dt.date(2000, 1, 1) + dt.timedelta(days=i)


def shuffles(df):
    """Exchanges of the plan that is made first, but for broadcasts and repeated ones."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange " in line and "Broadcast" not in line for line in plan.split("\n"))


def test_values_are_known_from_the_day_they_are_filed(spark):
    bars = spark.createDataFrame([(day(d), t, 1.0) for d in range(0, 40, 10) for t in (1, 2)], "date date, ticker long, adj_close double")
    facts = spark.createDataFrame([
        (1, "assets", day(-90), day(10), 5.0), (1, "assets", day(0), day(10), 7.0), (1, "assets", day(-180), day(20), 4.0),
        (1, "equity", day(0), day(11), 3.0), (2, "assets", day(0), day(-5), 9.0), (3, "assets", day(0), day(0), 1.0)], "ticker long, concept string, period_end date, filed date, value double")
    earnings = spark.createDataFrame([(1, day(15)), (1, day(25)), (None, day(1))], "ticker long, earnings_date date")
    got = {(r["ticker"], r["date"]): (r["assets"], r["equity"], r["days_since_earnings"]) for r in features.known_at(bars, facts, earnings, ("assets", "equity")).collect()}
    assert got == {(1, day(0)): (None, None, None), (1, day(10)): (7.0, None, None), (1, day(20)): (4.0, 3.0, 5), (1, day(30)): (4.0, 3.0, 5), **{(2, day(d)): (9.0, None, None) for d in range(0, 40, 10)}}
    assert features.known_at(bars.limit(0), facts, earnings, ("assets",)).count() == 0
    assert features.known_at(bars, facts.limit(0), earnings.limit(0), ("assets",)).where("assets is not null").count() == 0


def test_a_missing_fourth_quarter_is_the_year_less_the_others(spark):
    quarters = [(1, "revenue", dt.date(y, 3 * q - 2, 1), dt.date(y, 3 * q - 2, 1) + dt.timedelta(days=90), dt.date(y, 12, 31) if q == 4 else dt.date(y, 3 * q + 2, 1), float(10 * q + y - 2000), y, f"Q{q}") for y in (2000, 2001) for q in (1, 2, 3)]
    years = [(1, "revenue", dt.date(y, 1, 1), dt.date(y, 12, 31), dt.date(y + 1, 2, 1), 100.0 + y - 2000, y, "FY") for y in (2000, 2001)]
    df = spark.createDataFrame(quarters + years, "ticker long, concept string, period_start date, period_end date, filed date, value double, fy int, fp string")
    got = {(r["period_end"], r["filed"]): r["ttm"] for r in fundamentals.trailing_year(df).collect()}
    fourth = 100.0 - 60.0
    assert got[dt.date(2000, 12, 31), dt.date(2001, 2, 1)] == 100.0  # the year itself, and four quarters that end with the derived one
    assert got[dt.date(2001, 1, 1) + dt.timedelta(days=90), dt.date(2001, 5, 1)] == 20.0 + 30.0 + fourth + 11.0
    assert fundamentals.trailing_year(df.limit(0)).count() == 0


def test_the_whole_panel_takes_six_shuffles_of_stored_tables(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    inputs = [stored(df) for df in (t.bars, t.stints, t.sectors, t.macro, t.sql("filings"), t.sql("earnings"))]
    panel = whole_panel(*inputs)
    assert shuffles(panel) <= 6
    known = panel.agg({c: "count" for c in panel.columns if c.startswith("fund_")}).first()
    assert len(known) == 11


def test_days_to_the_next_event_by_equality_equal_the_ordered_ones(spark):
    dates = spark.createDataFrame([(day(d),) for d in range(0, 400, 3)], "date date")
    events = spark.createDataFrame([(day(d),) for d in (5, 6, 150, 150, 300)] + [(None,)], "e date")
    want = {tuple(r) for r in features.event_countdown(dates, events.where("e is not null"), "e").collect()}
    assert {tuple(r) for r in features.with_calendar(dates, events, "e").select("date", "days_to_event", "within_5d").collect()} == want
