"""Gates raise on bad tables and pass good ones; snapshots are visible when they are whole; landings touch what was asked."""

import datetime as dt
import os

import pytest

from panelspark.operators import gates, labels, signals
from panelspark.sources import snapshots, tables

D = dt.date


def scored(spark, dates=(1, 2)):
    return spark.createDataFrame([(D(2000, 1, d), t, 0.5, 10.0) for d in dates for t in (1, 2)], "date date, ticker long, prob double, adj_close double")


def test_date_slices_and_panels_of_one_date(spark):
    df = scored(spark)
    assert labels.date_slice(df, D(2000, 1, 2)).count() == 2
    with pytest.raises(Exception, match="no row lies between"):
        labels.date_slice(df, D(2001, 1, 1)).collect()
    assert labels.normalise_scored(df).count() == 4
    for bad in (scored(spark, (1,)), df.limit(0)):
        with pytest.raises(Exception, match="two dates"):
            labels.normalise_scored(bad).collect()


def test_live_universe_without_overlap(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "ticker long") for xs in ((1, 2), (3,)))
    assert [r[0] for r in tables.live_universe(a, a.where("ticker = 1")).collect()] == [1]
    with pytest.raises(Exception, match="no trained ticker"):
        tables.live_universe(a, b).collect()


def test_coverage_counts_current_members_and_reports_departed_ones(spark):
    requested = spark.createDataFrame([(t,) for t in range(10)], "ticker long")
    active = requested.where("ticker < 5")
    bars = spark.createDataFrame([(D(2000, 1, 1), t, 1.0 if t != 3 else None) for t in (0, 1, 2, 3, 4, 7)], "date date, ticker long, adj_close double")
    got = {r["cohort"]: (r["n_requested"], r["n_covered"]) for r in gates.coverage_by_cohort(requested, bars, active).collect()}
    assert got == {"all": (10, 5), "current": (5, 4), "departed": (5, 1)}
    assert gates.covered(bars, requested, active, 0.8).count() == 6
    with pytest.raises(Exception, match="80.0 % of the tickers"):
        gates.covered(bars, requested, active, 0.9).collect()
    with pytest.raises(Exception, match="50.0 % of the tickers"):
        gates.covered(bars, requested, None, 0.9).collect()
    with pytest.raises(Exception, match="cover none"):
        gates.covered(bars, requested.limit(0), None).collect()
    with pytest.raises(Exception, match="0.0 % of the tickers"):
        gates.covered(bars.limit(0), requested, active).collect()


def test_overall_average_precision_and_auc_of_scores_of_any_scale(spark):
    rows = [(s, float(y)) for s, y in [(-5e9, 0), (-5e9, 1), (-1.0, 0), (0.0, 1), (0.0, 0), (1e-9, 1), (3.0, 0), (7e12, 1)]]
    r = signals.overall_ap_auc(spark.createDataFrame(rows, "prob double, target double")).first()
    pairs = [(a, b) for a, x in rows if x for b, y in rows if not y]
    assert r["auc"] == pytest.approx(sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs))
    ap, seen, hit = 0.0, 0, 0
    for s in sorted({a for a, _ in rows}, reverse=True):
        of = [y for a, y in rows if a == s]
        seen, hit = seen + len(of), hit + sum(of)
        ap += sum(of) * hit / seen
    assert r["average_precision"] == pytest.approx(ap / 4) and r["base_rate"] == 0.5
    assert signals.overall_ap_auc(spark.createDataFrame([], "prob double, target double")).first()["auc"] is None


def test_snapshots_are_logged_when_whole(spark, tmp_path):
    folder, df = str(tmp_path / "s"), scored(spark)
    row = snapshots.write_snapshot(df, folder, "panel").first()
    assert (row["n_rows"], row["n_columns"], row["columns"]) == (4, 4, "date,ticker,prob,adj_close")
    path = row["path"]
    assert row["bytes"] == sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if not f.startswith("."))
    first = row["version"]
    snapshots.write_snapshot(df.limit(1), folder, "panel")
    assert snapshots.read_snapshot(spark, folder, "panel").count() == 1 and snapshots.read_snapshot(spark, folder, "panel", first).count() == 4
    os.makedirs(f"{folder}/panel/_staging-torn")  # a write that broke off
    df.write.parquet(f"{folder}/panel/_staging-torn/x")
    assert snapshots.read_snapshot(spark, folder, "panel").count() == 1 and snapshots.snapshot_log(spark, folder).count() == 2
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, folder, "other")
    assert snapshots.write_snapshot(df.limit(0), folder, "empty").first()["n_rows"] == 0


def test_landings_write_the_asked_keys_only(spark, tmp_path):
    folder = str(tmp_path / "landed")
    keys = spark.createDataFrame([(t,) for t in range(40)], "ticker long")
    answers = keys.where("ticker % 4 <> 0").selectExpr("ticker", "1.0D as value")
    snapshots.land(answers, keys, folder, D(2000, 1, 1), buckets=8)
    before = {p: os.stat(os.path.join(folder, p)).st_mtime_ns for p in os.listdir(folder) if p.startswith("bucket")}
    assert tables.work_list(keys, snapshots.landings(spark, folder), D(2000, 1, 10), 30).count() == 0  # empty answers count as landed
    one = keys.where("ticker = 8")
    snapshots.land(one.selectExpr("ticker", "2.0D as value"), one, folder, D(2000, 3, 1), buckets=8)
    got = {r["ticker"]: (r["landed_on"], r["n"]) for r in snapshots.landings(spark, folder).collect()}
    assert got == {t: (D(2000, 3, 1), 1) if t == 8 else (D(2000, 1, 1), int(t % 4 != 0)) for t in range(40)}
    after = {p: os.stat(os.path.join(folder, p)).st_mtime_ns for p in os.listdir(folder) if p.startswith("bucket")}
    assert sum(before[p] != after[p] for p in before) == 1
    assert tables.work_list(keys, snapshots.landings(spark, folder), D(2000, 3, 5), 30).count() == 39
