"""Invariants of the panel operators on small hand-written tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from panelspark.functions import scalars
from panelspark.functions.windows import pct_rank_avg
from panelspark.operators import accounts, features, fundamentals, labels, ml, pit, portfolio, quality, selection, signals, stats
from panelspark.sources import tables

D = dt.date


def day(i):
    return D(2020, 1, 1) + dt.timedelta(days=i)


def bars(spark, prices):
    rows = [(day(i), k, float(p) if p is not None else None, 1.0) for k, ps in prices.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "date date, ticker bigint, adj_close double, volume double")


def test_membership_is_half_open_and_rows_stay_single(spark):
    b = bars(spark, {1: [1, 2, 3, 4]})
    s = spark.createDataFrame([(1, day(1), day(3)), (1, day(0), day(2))], "ticker bigint, start_date date, end_date date")
    assert [r.date for r in pit.members_at(b, s).orderBy("date").collect()] == [day(0), day(1), day(2)]


def test_asof_sees_nothing_of_the_future(spark):
    left = spark.createDataFrame([(1, day(1)), (1, day(5)), (2, day(5))], "ticker bigint, date date")
    right = spark.createDataFrame([(1, day(5), 7.0), (1, day(9), 9.0)], "ticker bigint, filed date, v double")
    got = {(r.ticker, r.date): r.v for r in pit.asof_backward(left, right, ["v"], right_on="filed").collect()}
    assert got == {(1, day(1)): None, (1, day(5)): 7.0, (2, day(5)): None}


def test_rolling_needs_a_full_window(spark):
    got = features.price_to_mean(bars(spark, {1: [1, 2, None, 4, 5]}), windows=(2,)).orderBy("date").collect()
    assert [r.px_sma_2 is None for r in got] == [True, False, True, True, False]


def test_rsi_of_rising_and_flat_prices(spark):
    got = features.rsi(bars(spark, {1: range(1, 20), 2: [5] * 19})).where(F.col("date") == day(18)).orderBy("ticker").collect()
    assert [r.rsi_14 for r in got] == [100.0, 50.0]


def test_percent_rank_shares_ties_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 3.0), (1, None)], "d int, x double")
    got = sorted((r.p for r in df.select(pct_rank_avg(F.col("x"), "d").alias("p")).collect()), key=lambda v: (v is None, v))
    assert got == [0.5, 0.5, 1.0, None]


def test_label_is_unknown_at_the_end_and_terminal_for_the_gone(spark):
    b = bars(spark, {1: [10, 11, 12, 13], 2: [10, 5]})
    fwd = labels.terminal_returns(labels.forward_returns(labels.dense_grid(b), 2))
    got = {(r.ticker, r.date): r.fwd_ret for r in fwd.collect()}
    assert got[1, day(0)] == pytest.approx(0.2) and got[1, day(3)] is None
    assert got[2, day(0)] == pytest.approx(-0.5) and got[2, day(1)] is None


def test_purge_leaves_no_overlap(spark):
    b = bars(spark, {1: range(1, 31)})
    assert labels.purge_before(b, day(20), 5).agg(F.max("date")).first()[0] == day(14)
    assert labels.purge_before(b, day(4), 5).count() == 0
    folds = labels.purged_folds(b, 2, 3).groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("date"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("date"))).alias("b")).collect()
    assert all((r.b - r.a).days == 4 for r in folds)


def test_weights_sum_to_one_and_floor_counts_raw_rows(spark):
    s = spark.createDataFrame([(day(0), i, i / 10, 1.0) for i in range(1, 8)], "date date, ticker bigint, prob double, adj_close double")
    t = selection.targets(s, selection.SelectionRules(top_n=3, probability_weighted=True)).collect()
    assert sum(r.weight for r in t) == pytest.approx(1) and {r.ticker for r in t} == {5, 6, 7}
    assert selection.targets(s, selection.SelectionRules(min_cross_section=7, min_score=0.65)).count() == 1
    assert selection.targets(s, selection.SelectionRules(min_cross_section=8)).count() == 0


def test_long_short_book_is_neutral(spark):
    s = spark.createDataFrame([(day(0), i, float(i), 1.0) for i in range(20)], "date date, ticker bigint, prob double, adj_close double")
    book = selection.decile_book(s, 0.1).collect()
    assert sum(r.weight for r in book) == pytest.approx(0) and len(book) == 4


def test_admission_respects_slots_and_settles_first(spark):
    c = spark.createDataFrame([(1, day(0), day(1), day(5), 0.1), (1, day(2), day(3), day(7), 0.0), (1, day(3), day(4), day(8), 0.0), (1, day(6), day(7), day(9), 0.0)], "config_id int, date date, entry_date date, exit_date date, net double")
    got = {r.date: r.amount for r in portfolio.admit(c, 2, 100.0).collect()}
    assert got == {day(0): 50.0, day(2): 50.0, day(6): pytest.approx(55.0)}


def test_hac_without_overlap_matches_direct_sum(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(0.1, 1, 200)
    df = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(x)], "date date, v double")
    got = stats.hac_mean(df, "v", [], 5).first()
    e, n = x - x.mean(), len(x)
    lags = max(int(4 * (n / 100) ** (2 / 9)), 4)
    s = e @ e + 2 * sum((1 - j / (lags + 1)) * (e[j:] @ e[:-j]) for j in range(1, lags + 1))
    assert got.t_stat == pytest.approx(x.mean() * n / s**0.5)


def test_restatement_is_not_seen_before_it_is_filed(spark):
    f = spark.createDataFrame([(1, "assets", day(0), day(90), day(100), 5.0), (1, "assets", day(0), day(90), day(200), 6.0)], "ticker bigint, concept string, period_start date, period_end date, filed date, value double")
    panel = spark.createDataFrame([(1, day(150)), (1, day(250))], "ticker bigint, date date")
    got = [r.assets for r in fundamentals.asof_fundamentals(panel, fundamentals.dedupe_filings(f), ["assets"]).orderBy("date").collect()]
    assert got == [5.0, 6.0]


def test_first_tag_with_data_wins(spark):
    obs = lambda v, form="10-Q": {"start": "2020-01-01", "end": "2020-03-31", "val": v, "filed": "2020-05-01", "form": form, "fy": 2020, "fp": "Q1"}
    doc = {"facts": {"us-gaap": {"Old": {"units": {"USD": [obs(1.0)]}}, "New": {"units": {"USD": [obs(2.0), obs(9.0, "8-K")]}}}}}
    raw = spark.createDataFrame([(1, json.dumps(doc))], "ticker bigint, json string")
    tags = spark.createDataFrame([("revenue", "New", 1), ("revenue", "Old", 2)], "concept string, tag string, priority int")
    assert [r.value for r in fundamentals.extract_concepts(raw, tags).collect()] == [2.0]


def test_halt_and_gate(spark):
    a = spark.createDataFrame([(1, 50.0, 100.0), (2, 100.0, 100.0)], "account_id bigint, cash double, high_watermark double")
    none = spark.createDataFrame([], "account_id bigint, ticker bigint, shares double, entry_price double")
    q = spark.createDataFrame([], "ticker bigint, quote double, seen double")
    h = accounts.halts(accounts.valuation(a, none, q), 0.2).withColumn("last_signal_date", F.lit(None).cast("date"))
    assert {r.account_id: r.may_open for r in accounts.open_gate(h, day(0), False, force=True).collect()} == {1: False, 2: True}


def test_orders_stay_inside_the_budget(spark):
    t = spark.createDataFrame([(1, 1, 7, 0.5, 30.0), (1, 2, 8, 0.5, 20.0)], "account_id bigint, rk int, ticker bigint, weight double, price double")
    c = spark.createDataFrame([(1, 100.0)], "account_id bigint, capital double")
    got = accounts.size_orders(t, c, 0.0, 0.0, 1.0).collect()
    assert sum(r.cost for r in got) <= 100 and {r.ticker: r.shares for r in got} == {7: 1, 8: 2}


def test_gates_and_audit(spark, tmp_path):
    s = spark.createDataFrame([(-1.0,)], "prob double")
    with pytest.raises(Exception, match="negative scores"):
        quality.gate_scores(s, True).collect()
    assert quality.gate_scores(s, False).count() == 1
    with pytest.raises(ValueError):
        quality.gate_scores(s, False, "vix_percentile")
    assert quality.write_audited(s, str(tmp_path / "t"))["rows"] == 1


def test_later_batch_wins_and_panel_round_trip(spark, tmp_path):
    a, b = bars(spark, {1: [1, 2]}), bars(spark, {1: [9]})
    assert sorted(r.adj_close for r in tables.union_later_wins([a, b]).collect()) == [2.0, 9.0]
    tables.write_panel(a, str(tmp_path / "p"))
    assert tables.read_scored(spark, str(tmp_path / "p")).count() == 2
    tables.write_report(a, str(tmp_path / "r"))


def test_ids_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a", "b"],)], "n array<string>")
    assert df.select(scalars.decision_id(F.lit("2020-01-01"), F.col("n"))).distinct().count() == 1


def test_feature_plan_filters_after_time_windows(spark):
    b = bars(spark, {1: range(1, 9), 2: range(2, 10)})
    s = spark.createDataFrame([(1, day(6), None)], "ticker bigint, start_date date, end_date date")
    got = pit.members_at(features.returns(b, lags=(5,)), s).orderBy("date").collect()
    assert [r.ret_5d is not None for r in got] == [True, True]


def test_exposure_scale_and_scaled_admission(spark):
    rows = spark.createDataFrame([(0.2,), (0.75,), (1.0,), (None,), (float("nan"),)], "p double")
    assert [r[0] for r in rows.select(portfolio.exposure_scale(rows.p)).collect()] == [1.0, 0.5, 0.0, 1.0, 1.0]
    c = spark.createDataFrame([(1, day(0), day(1), day(5), 0.1, 0.5), (1, day(2), day(3), day(7), 0.0, 0.0), (1, day(6), day(7), day(9), 0.0, 1.0)], "config_id int, date date, entry_date date, exit_date date, net double, s double")
    got = {r.date: r.amount for r in portfolio.admit(c, 2, 100.0, scale="s").collect()}
    assert got == {day(0): 25.0, day(6): pytest.approx(51.25)}


def test_ranking_metrics_match_direct_sums(spark):
    import math
    import random

    rng = random.Random(1)
    rows = [(k, day(d), i, rng.choice([0.1, 0.2, 0.55, 0.551, 0.9]), rng.randint(0, 4), float(rng.random() < 0.4)) for k in (1, 2) for d in range(4) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, date date, ticker int, prob double, grade int, target double")
    got = {r.k: r.pr_auc for r in signals.average_precision(df, ("k",)).collect()}
    for k in (1, 2):
        mine, want = [r for r in rows if r[0] == k], 0.0
        for p in {r[3] for r in mine}:
            above = [r[5] for r in mine if r[3] >= p]
            want += sum(r[5] for r in mine if r[3] == p) * sum(above) / len(above)
        assert got[k] == pytest.approx(want / sum(r[5] for r in mine))
    got = {r.k: r.ndcg for r in signals.ndcg(df, 5, ("k",)).collect()}
    for k in (1, 2):
        days = []
        for d in range(4):
            mine = [r for r in rows if r[0] == k and r[1] == day(d)]
            dcg = lambda rs: sum((2 ** r[4] - 1) / math.log2(i + 2) for i, r in enumerate(rs[:5]))
            days.append(dcg(sorted(mine, key=lambda r: (-r[3], r[2]))) / dcg(sorted(mine, key=lambda r: -r[4])))
        assert got[k] == pytest.approx(sum(days) / len(days))


@pytest.mark.parametrize("objective", ["rank", "binary"])
def test_staged_scores_end_in_the_whole_model(spark, objective):
    rows = [(day(d), i, float((i * 7 + d) % 11), None if i == 3 else float(i), 0.1 * ((i * 7 + d) % 11), (i * 7 + d) % 5, float((i * 7 + d) % 11 > 6)) for d in range(30) for i in range(10)]
    df = spark.createDataFrame(rows, "date date, ticker int, a double, b double, fwd_ret double, grade int, target double")
    model = ml.fit_model(df, ["a", "b"], objective, trees=3, depth=2)
    whole = {(r.date, r.ticker): r.prob for r in ml.score(model, df, ["a", "b"]).collect()}
    staged = ml.staged_scores(model, df, ["a", "b"])
    assert staged.count() == 3 * len(rows)
    assert {(r.date, r.ticker): r.prob for r in staged.where("n_trees = 3").collect()} == pytest.approx(whole)
    final, n = ml.fit_final(df, ["a", "b"], objective, top_n=3, purge=1, most=3, depth=2)
    assert 1 <= n <= 3 and (len(final.trees) if objective == "rank" else final.stages[-1].getNumTrees) == n


def test_metric_must_fit_the_objective():
    assert ml.resolve_metric("auto", "rank") == "topn_excess" and ml.resolve_metric("auto", "binary") == "pr_auc"
    for metric, objective in (("ndcg", "binary"), ("pr_auc", "rank"), ("rmse", "rank")):
        with pytest.raises(ValueError):
            ml.resolve_metric(metric, objective)


def test_walk_forward_scores_every_month_that_has_a_past(spark):
    rows = [(day(d), i, float(i), 0.01 * i, i % 5, float(i > 5)) for d in range(120) for i in range(6)]
    df = spark.createDataFrame(rows, "date date, ticker int, a double, fwd_ret double, grade int, target double")
    scored = ml.walk_forward(df, ["a"], start=day(0), purge=5, trees=1)
    months = {(r.date.year, r.date.month) for r in scored.collect()}
    assert len(months) >= 2 and scored.count() == sum((day(d).year, day(d).month) in months for d in range(120)) * 6
