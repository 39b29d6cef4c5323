"""Panels that are written in parts, and books that are ranked by one ordering."""

import datetime as dt
import glob
import random

import pytest

import __spark_entry__ as entry
from panelspark.operators import selection
from panelspark.plans.base import Tables
from panelspark.sources import tables


def test_a_panel_is_written_as_csv_in_parts(spark, tmp_path):
    df = spark.range(0, 1000, 1, 4).selectExpr("date'2020-01-01' AS date", "cast(id as string) AS ticker", "id / 1000 AS prob", "1.5D AS adj_close")
    tables.write_csv(df, str(tmp_path / "panel.csv"))
    assert len(glob.glob(str(tmp_path / "panel.csv" / "part-*"))) == 4
    got = tables.read_scored(spark, str(tmp_path / "panel.csv")).select("date", "ticker", "prob", "adj_close")
    assert got.exceptAll(df).count() == 0 and got.count() == 1000


def test_no_task_writes_the_whole_scored_panel(spark, monkeypatch):
    monkeypatch.setattr(tables, "write_report", lambda *_: pytest.fail("the panel went through one task"))
    assert entry.queries()["s01_read_scored"](spark, "/root/testdata/sf0.001").count() > 0


def test_the_unlabelled_panel_is_the_scored_one_less_the_return(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    want = t.scored.select(t.unlabelled.columns)
    assert t.unlabelled.exceptAll(want).count() == 0 and want.exceptAll(t.unlabelled).count() == 0 and "Join" not in t.unlabelled._jdf.queryExecution().optimizedPlan().toString()


def test_a_book_is_sorted_once_and_ties_go_to_opposite_names(spark):
    rng = random.Random(2)
    rows = [(dt.date(2020, 1, 1 + d), t, float(rng.choice([-1, 1, 2, 3])), rng.choice([None, 0.1, 0.2, 0.2, 0.3])) for d in range(5) for t in range(rng.randint(1, 40))]
    book = selection.decile_book(spark.createDataFrame(rows, "date date, ticker long, adj_close double, prob double"), 0.3)
    want = {}
    for date in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == date and r[2] > 0 and r[3] is not None]
        k = int(len(mine) * 0.3)
        for names, sign in ((sorted(mine, key=lambda r: (-r[3], r[1]))[:k], 1), (sorted(mine, key=lambda r: (r[3], -r[1]))[:k], -1)):
            want.update({(date, r[1]): sign / k for r in names})
    assert {(r["date"], r["ticker"]): r["weight"] for r in book.collect()} == pytest.approx(want) and want
    assert book._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Sort [") == 1
