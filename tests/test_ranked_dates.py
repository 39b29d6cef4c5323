"""Books that read some dates only: the others are not ranked, and prices at fills are looked up for the few names that may be held."""

import datetime as dt
import random

from pyspark.sql import Window, functions as F

from panelspark.operators import pit, rank_hold, signals
from panelspark.plans import book_queries as bq
from panelspark.plans.base import Tables
from panelspark.sources.stored import stored


def _tables(spark, bad=True, seed=4):
    """Prices with gaps; some of them null, nothing or less, more often on the days of fills."""
    rng, rows = random.Random(seed), []
    days = [dt.date(2000, 1, 3) + dt.timedelta(days=i) for i in range(100) if i % 7 < 5]
    for d in days:
        for t in range(30):
            if rng.random() < 0.9:
                odd = bad and rng.random() < (0.5 if d.weekday() == 0 else 0.05)
                rows.append((d, t, rng.choice([0.0, -1.0, None]) if odd else rng.uniform(1, 9)))
    t = Tables(spark, "/none")
    t.__dict__["stored_bars"] = stored(spark.createDataFrame(rows, "date date, ticker long, adj_close double"))
    t.__dict__["book_sessions"] = stored(pit.sessions_of(t.stored_bars))
    return t


def test_signals_of_some_dates_are_ranked_alone_and_the_same(spark):
    """Before, all dates were shuffled and ranked, and most of them dropped."""
    t = _tables(spark)
    some = t.book_sessions.where("session_no % 21 = 0")
    got = t.signals_at(some)
    assert sorted(map(str, got.collect())) == sorted(map(str, t.signals.join(some.select("date"), "date", "left_semi").collect())) and got.count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning(date") < plan.index("LeftSemi") < plan.index("hashpartitioning(ticker")  # from the top down


def test_few_candidates_change_a_book_as_all_names_do(spark):
    """Before, all ranked names of a week were kept and met all bars for their price at the fill."""
    for seed in (4, 5):
        t = _tables(spark, seed=seed)
        weekly = pit.rebalance_dates(t.book_sessions).join(pit.shift_sessions(t.book_sessions.select("date"), t.book_sessions, 1, "fill_date"), "date").where("fill_date is not null")
        every = stored(signals.rank_within_date(t.signals.where("adj_close > 0")).select("date", "ticker", "rk").join(weekly, "date"))
        few = stored(bq._candidates(t))
        assert 0 < few.count() < every.count() and few.groupBy("date").count().agg(F.max("count")).first()[0] <= bq.LEAVE + 2 * bq.TOP

        def changes(rows):
            fills = rows.select("date", "fill_date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")).cast("long"))
            return sorted(map(tuple, rank_hold.membership(rows.select("date", "ticker", "rk"), fills, bq._known(rows, t.stored_bars), bq.TOP, bq.LEAVE).collect()))

        assert changes(few) == changes(every) and len(changes(few)) > 10
