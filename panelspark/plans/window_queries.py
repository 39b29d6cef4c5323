"""Queries of the window, label and projection operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import borrow, features, fundamentals, labels, pit, selection, signals, stats
from .base import HORIZON, T, pct_rank, roll
from .registry import query

KEY = "date ticker "


@query("w01_returns", KEY + " ".join(f"ret_{n}d~" for n in features.LAGS), "SELECT * FROM rets")
def _(t):
    return features.returns(t.bars)


@query("w02_momentum", KEY + "mom_21_5~", "SELECT * FROM returns")
def _(t):
    return features.momentum(features.returns(t.bars))


@query("w03_volatility", KEY + "vol_10d~ vol_21d~", "SELECT * FROM returns")
def _(t):
    return t.returns


@query("w04_rsi", KEY + "rsi_14~", f"""SELECT date, ticker, CASE WHEN l = 0 AND g = 0 THEN 50 WHEN l = 0 THEN 100 WHEN g IS NOT NULL THEN 100 - 100 / (1 + g / l) END AS rsi_14 FROM (
SELECT *, {roll('avg', 'up', 14)} AS g, {roll('avg', 'down', 14)} AS l FROM (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS down FROM (
SELECT *, adj_close - lag(adj_close) OVER ({T}) AS d FROM bars)))""", digits=4)
def _(t):
    return features.rsi(t.bars)


@query("w05_price_to_mean", KEY + "px_sma_20~ px_sma_50~", f"SELECT *, adj_close / {roll('avg', 'adj_close', 20)} - 1 AS px_sma_20, adj_close / {roll('avg', 'adj_close', 50)} - 1 AS px_sma_50 FROM bars")
def _(t):
    return features.price_to_mean(t.bars)


@query("w06_bollinger", KEY + "bb_pos~", f"SELECT date, ticker, (adj_close - (m - 2 * s)) / (4 * s + 1e-9) AS bb_pos FROM (SELECT *, {roll('avg', 'adj_close', 20)} AS m, {roll('stddev_samp', 'adj_close', 20)} AS s FROM bars)")
def _(t):
    return features.bollinger(t.bars)


@query("w07_highs", KEY + "high_252~ drawdown_63~", f"SELECT *, adj_close / {roll('max', 'adj_close', 252)} AS high_252, adj_close / {roll('max', 'adj_close', 63)} - 1 AS drawdown_63 FROM bars")
def _(t):
    return features.highs(t.bars)


@query("w08_volume", KEY + "vol_z~ vol_ratio~ vol_trend~ pv_divergence~", f"""SELECT date, ticker, (volume - {roll('avg', 'volume', 21)}) / nullif({roll('stddev_samp', 'volume', 21)}, 0) AS vol_z, volume / {roll('avg', 'volume', 5)} AS vol_ratio,
{roll('avg', 'volume', 10)} / {roll('avg', 'volume', 21)} AS vol_trend, ret_5d - (volume / nullif(lag(volume, 5) OVER ({T}), 0) - 1) AS pv_divergence FROM rets""", digits=8)
def _(t):
    return features.volume_features(features.returns(t.bars))


@query("w09_pct_rank", KEY + "ret_21d_rank~ vol_21d_rank~", f"SELECT *, {pct_rank('ret_21d')} AS ret_21d_rank, {pct_rank('vol_21d')} AS vol_21d_rank FROM returns", digits=5)
def _(t):
    return features.cross_ranks(t.returns, ("ret_21d", "vol_21d"))


@query("w10_forward_return", KEY + "fwd_ret~", "SELECT * FROM fwd")
def _(t):
    return labels.forward_returns(t.grid, HORIZON)


@query("w11_terminal_return", KEY + "fwd_ret~", """SELECT f.date, f.ticker, coalesce(fwd_ret, CASE WHEN l.last < m.fin AND f.date < l.last THEN quote / adj_close - 1 END) AS fwd_ret FROM fwd f
JOIN (SELECT ticker, max(date) AS last, arg_max(adj_close, date) AS quote FROM bars GROUP BY ticker) l ON l.ticker = f.ticker CROSS JOIN (SELECT max(date) AS fin FROM bars) m""")
def _(t):
    return labels.terminal_returns(labels.forward_returns(t.grid, HORIZON))


def _vol_scored(t):
    return t.scored.join(t.returns.select("date", "ticker", "vol_21d"), ["date", "ticker"], "left")


_VS = "(SELECT s.*, v.vol_21d FROM scored s LEFT JOIN returns v ON v.date = s.date AND v.ticker = s.ticker)"


@query("w12_label_target", KEY + "label_target~", f"SELECT date, ticker, CASE WHEN vol_21d > 1e-4 THEN (fwd_ret - median(fwd_ret) OVER (PARTITION BY date)) / vol_21d END AS label_target FROM {_VS}")
def _(t):
    return labels.label_target(_vol_scored(t), "excess_vol_adj")


@query("w13_rank_grades", KEY + "grade:int", f"SELECT date, ticker, coalesce(greatest(0, least(4, ceil({pct_rank('fwd_ret')} * 5) - 1)), 0) AS grade FROM scored")
def _(t):
    return labels.rank_grades(labels.label_target(t.scored), 5)


@query("w14_macro_features", "date yield_spread~ vix_change_5d~ vix_percentile~", """SELECT a.date, any_value(a.tnx_yield - a.irx_yield) AS yield_spread, any_value(a.chg) AS vix_change_5d,
CASE WHEN any_value(a.vix) IS NOT NULL AND count(b.vix) + 1 >= 60 THEN count(*) FILTER (b.vix <= a.vix) / nullif(count(b.i), 0) END AS vix_percentile
FROM (SELECT *, row_number() OVER (ORDER BY date) AS i, vix / nullif(lag(vix, 5) OVER (ORDER BY date), 0) - 1 AS chg FROM macro) a
LEFT JOIN (SELECT vix, row_number() OVER (ORDER BY date) AS i FROM macro) b ON b.i < a.i AND b.i >= a.i - 251 GROUP BY a.date""")
def _(t):
    return features.macro_features(t.macro)


@query("w15_growth", KEY + "growth~", f"SELECT date, ticker, CASE WHEN abs(o) > 1e-9 THEN (adj_close - o) / abs(o) END AS growth FROM (SELECT *, lag(adj_close, 252) OVER ({T}) AS o FROM bars)")
def _(t):
    return fundamentals.growth(t.bars, "adj_close", "growth")


_DEDUPED = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, concept, period_end, filed ORDER BY period_start DESC NULLS LAST, value DESC) AS r FROM facts) WHERE r = 1)"
_EARLIEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, concept, period_end ORDER BY filed, value DESC) AS v FROM {_DEDUPED}) WHERE concept <> 'revenue' OR v = 1)"
# names divisible by 4 file no fourth quarter but a year
_FILED = f"""(SELECT ticker, concept, period_start, period_end, filed, value, fy, fp FROM {_EARLIEST} WHERE concept = 'revenue' AND NOT (ticker % 4 = 0 AND fp = 'Q4')
UNION ALL SELECT ticker, concept, min(period_start), max(period_end), max(filed), sum(value), fy, 'FY' FROM {_EARLIEST} WHERE concept = 'revenue' AND ticker % 4 = 0 GROUP BY ticker, concept, fy HAVING count(*) = 4)"""
_TTM = f"""(WITH f AS (SELECT *, period_end - period_start AS days FROM {_FILED}),
q4 AS (SELECT y.ticker, y.concept, y.period_end, y.filed, y.value - q.s AS value FROM f y JOIN (SELECT ticker, concept, fy, sum(value) AS s FROM f WHERE days BETWEEN 80 AND 100 AND fp IN ('Q1', 'Q2', 'Q3') GROUP BY 1, 2, 3 HAVING count(DISTINCT fp) = 3) q ON q.ticker = y.ticker AND q.concept = y.concept AND q.fy = y.fy WHERE y.days BETWEEN 350 AND 380),
u AS (SELECT *, row_number() OVER (PARTITION BY ticker, concept, period_end ORDER BY filed, value DESC) AS r FROM (SELECT ticker, concept, period_end, filed, value FROM f WHERE days BETWEEN 80 AND 100 UNION ALL SELECT * FROM q4))
SELECT ticker, concept, period_end, filed, ttm FROM (SELECT ticker, concept, period_end, sum(value) OVER w AS ttm, max(filed) OVER w AS filed, count(*) OVER w AS n FROM u WHERE r = 1 WINDOW w AS (PARTITION BY ticker, concept ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE n = 4
UNION ALL SELECT ticker, concept, period_end, filed, value FROM f WHERE days BETWEEN 350 AND 380)"""


def revenue_ttm(t):
    """Names divisible by 4 file no fourth quarter but a year."""
    f = fundamentals.vintages(fundamentals.dedupe_filings(t.facts), ["revenue"]).where("concept = 'revenue'")
    annual = f.where("ticker % 4 = 0").groupBy("ticker", "concept", "fy").agg(
        F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"), F.max("filed").alias("filed"), F.sum("value").alias("value"), F.count("*").alias("n")).where("n = 4").withColumn("fp", F.lit("FY"))
    names = ["ticker", "concept", "period_start", "period_end", "filed", "value", "fy", "fp"]
    return fundamentals.trailing_year(f.where("not (ticker % 4 = 0 and fp = 'Q4')").select(*names).unionByName(annual.select(*names)))


@query("w16_trailing_year", "ticker concept period_end filed ttm~", f"SELECT * FROM {_TTM}", digits=2)
def _(t):
    return revenue_ttm(t)


_RV = f"(SELECT *, {roll('stddev_samp', 'ret_1d', 63, 15)} * sqrt(252) AS rv FROM rets)"


@query("w17_realised_volatility", KEY + "rv~", f"SELECT * FROM {_RV}")
def _(t):
    return borrow.realised_volatility(features.returns(t.bars, lags=(1,)))


_RATE = f"(SELECT *, CASE WHEN p IS NULL OR p <= 0.8 THEN 0.005 WHEN p <= 0.9 THEN 0.015 WHEN p <= 0.95 THEN 0.03 WHEN p <= 0.99 THEN 0.08 ELSE 0.2 END AS rate FROM (SELECT *, {pct_rank('rv')} AS p FROM {_RV}))"


@query("w18_borrow_rate", KEY + "rate~", f"SELECT * FROM {_RATE}")
def _(t):
    return borrow.estimated_rates(borrow.realised_volatility(features.returns(t.bars, lags=(1,))))


@query("w19_forward_fill", KEY + "adj_close^", "SELECT * FROM prices")
def _(t):
    return t.prices


@query("w20_fill_score_date", "date vix^ tnx_yield^ irx_yield^", "SELECT date, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY date) AS {c}" for c in ("vix", "tnx_yield", "irx_yield")) + " FROM macro QUALIFY date = (SELECT max(date) FROM macro)")
def _(t):
    return features.fill_score_date(t.macro, t.macro.agg(F.max("date").alias("date")))


@query("w21_drawdown", "date drawdown~", "SELECT date, nav / max(nav) OVER (ORDER BY date) - 1 AS drawdown FROM bnav")
def _(t):
    return stats.drawdowns(t.benchmark.withColumnRenamed("close", "nav"), [])


@query("w22_trailing_sum", KEY + "bought~", f"SELECT b.date, b.ticker, sum(coalesce(v, 0)) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS bought FROM bars b LEFT JOIN (SELECT ticker, filed AS date, sum(value) AS v FROM insider GROUP BY 1, 2) i ON i.date = b.date AND i.ticker = b.ticker", digits=2)
def _(t):
    daily = signals.insider_daily(t.sql("insider").withColumnRenamed("filed", "date")).select("date", "ticker", "value")
    return signals.trailing_sum(t.bars.join(daily, ["date", "ticker"], "left"), "value", 21, "bought")


@query("w23_rebalance_dates", "date", "SELECT min(date) FILTER (isodow(date) = 3) AS date FROM sessions GROUP BY isoyear(date), weekofyear(date) HAVING min(date) FILTER (isodow(date) = 3) IS NOT NULL")
def _(t):
    return pit.rebalance_dates(t.sessions, 3)


@query("w23_last_of_week", "date", "SELECT max(date) AS date FROM sessions GROUP BY isoyear(date), weekofyear(date)")
def _(t):
    return pit.rebalance_dates(t.sessions)


@query("w24_every_kth", "date session_no:int fill_date", "SELECT * FROM (SELECT date, session_no, lead(date) OVER (ORDER BY session_no) AS fill_date FROM sessions) WHERE (session_no - 1) % 21 = 0")
def _(t):
    return pit.every_kth(t.sessions, 21)


@query("w25_rank_within_date", KEY + "rk:int", "SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY prob DESC, ticker) AS rk FROM scored")
def _(t):
    return signals.rank_within_date(t.scored)


# --- projections and filters

@query("p01_dense_grid", KEY + "has_bar:bool", "SELECT date, ticker, adj_close IS NOT NULL AS has_bar FROM grid")
def _(t):
    return t.grid.withColumn("has_bar", F.col("adj_close").isNotNull())


@query("p02_wide", "date tickers prices", "SELECT date, string_agg(CAST(ticker AS VARCHAR), ',' ORDER BY ticker) AS tickers, string_agg(CAST(CAST(floor(adj_close * 10000 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY ticker) AS prices FROM bars GROUP BY date")
def _(t):
    """A row a date with the prices of all its tickers, in ten-thousandths."""
    wide, text = labels.to_arrays(t.bars, ["adj_close"]), lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return wide.select("date", text("tickers").alias("tickers"), text(F.transform("adj_close", lambda x: F.floor(x * 10000 + 0.5))).alias("prices"))


@query("p03_row_roles", KEY + "is_tradable has_label target~", "SELECT date, ticker, coalesce(adj_close > 0, false) AS is_tradable, fwd_ret IS NOT NULL AS has_label, CASE WHEN fwd_ret IS NOT NULL THEN CAST(fwd_ret >= 0.05 AS DOUBLE) END AS target FROM fwd")
def _(t):
    return labels.row_roles(labels.forward_returns(t.grid, HORIZON), 0.05)


_TR = "(SELECT l.*, r.ret_1d, r.ret_252d FROM labelled l JOIN rets r ON r.date = l.date AND r.ticker = l.ticker)"


@query("p04_training_rows", KEY + "target~", f"SELECT * FROM {_TR} WHERE target IS NOT NULL AND ret_1d IS NOT NULL AND ret_252d IS NOT NULL")
def _(t):
    r = features.returns(t.bars, lags=(1, 252)).select("date", "ticker", "ret_1d", "ret_252d")
    return labels.training_rows(t.labelled.join(r, ["date", "ticker"]), ["ret_1d", "ret_252d"], strict=True)


@query("p05_date_slice", KEY + "prob~", "SELECT * FROM scored WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'", digits=5)
def _(t):
    return labels.date_slice(t.scored, dt.date(1996, 1, 1), dt.date(1997, 6, 30))


@query("p06_normalise_scored", KEY + "prob~", "SELECT * FROM scored", digits=5)
def _(t):
    return labels.normalise_scored(t.scored.withColumnRenamed("prob", "probability").withColumn("date", F.col("date").cast("timestamp")))


@query("p08_train_test", KEY + "role", "SELECT date, ticker, CASE WHEN date <= DATE '1998-12-31' THEN 'train' ELSE 'test' END AS role FROM scored WHERE date <= DATE '1998-12-31' OR date >= DATE '1999-02-01'")
def _(t):
    return labels.train_test(t.scored, dt.date(1998, 12, 31), dt.date(1999, 2, 1))


@query("p09_latest_slice", KEY + "ret_21d~ vol_21d~", "SELECT * FROM returns WHERE date = (SELECT max(date) FROM bars) AND (ret_21d IS NOT NULL OR vol_21d IS NOT NULL)")
def _(t):
    return labels.latest_slice(t.returns, ["ret_21d", "vol_21d"])


@query("p11_regime_filter", "date vix^", "SELECT date, vix FROM macro WHERE vix IS NULL OR vix <= 15")
def _(t):
    return labels.regime_filter(t.macro, 15, "vix")


@query("p12_unrankable", KEY, "SELECT date, ticker FROM scored WHERE ticker NOT IN (SELECT ticker FROM stints WHERE end_date IS NULL)")
def _(t):
    return labels.without(t.scored, pit.current_members(t.stints))


# --- scalar functions

@query("f01_calendar_parts", "date month_sin~ month_cos~ quarter_end_month:int days_to_quarter_end:int", "SELECT date, sin(2 * pi() * (month(date) - 1) / 12) AS month_sin, cos(2 * pi() * (month(date) - 1) / 12) AS month_cos, CAST(month(date) % 3 = 0 AS INT) AS quarter_end_month, last_day(make_date(year(date), 3 * CAST(ceil(month(date) / 3.0) AS BIGINT), 1)) - date AS days_to_quarter_end FROM sessions")
def _(t):
    return t.sessions.withColumns(scalars.calendar_parts(F.col("date")))


_NEXT = "SELECT date, least(60, coalesce((SELECT min(e) FROM (SELECT DISTINCT date AS e FROM macro WHERE day(date) = 15) v WHERE e >= s.date) - date, 60)) AS days_to_event FROM sessions s"


@query("f01_event_countdown", "date days_to_event:int within_5d:int", f"SELECT *, CAST(days_to_event <= 5 AS INT) AS within_5d FROM ({_NEXT})")
def _(t):
    return features.event_countdown(t.sessions, t.macro.where("day(date) = 15").select(F.col("date").alias("e")), "e")


@query("f02_safe_ratio", KEY + "x^", "SELECT date, ticker, CASE WHEN volume - 30 > 1e-9 THEN adj_close / (volume - 30) END AS x FROM bars")
def _(t):
    return t.bars.withColumn("x", scalars.safe_ratio(F.col("adj_close"), F.col("volume") - 30, True))


_RATIO_INPUTS = {"revenue": "volume * 10", "cost_of_revenue": "CASE WHEN ticker % 3 = 0 THEN volume * 6 END", "gross_profit": "CASE WHEN ticker % 2 = 0 THEN volume * 5 END", "operating_income": "volume * 2", "net_income": "volume - 20", "assets": "volume * 100", "liabilities": "CASE WHEN ticker % 5 = 0 THEN volume * 40 END", "equity": "volume * 55 - 500", "cash_ops": "volume * 3", "capex": "CASE WHEN ticker % 7 = 0 THEN volume END", "shares_diluted": "volume + 5", "eps_diluted": "adj_close / 10 - 100"}


def _sr(n, d):
    return f"CASE WHEN ({d}) > 1e-9 THEN ({n}) / ({d}) END"


def _share(n):
    return _sr(_sr(n, "shares_diluted"), "adj_close")


_RATIOS = {
    "earnings_yield": _share("net_income"), "book_to_price": _share("CASE WHEN equity > 0 THEN equity END"), "sales_to_price": _share("revenue"), "fcf_yield": _share("cash_ops - coalesce(capex, 0)"),
    "roe": _sr("net_income", "equity"), "gross_margin": _sr("coalesce(gross_profit, revenue - cost_of_revenue)", "revenue"), "operating_margin": _sr("operating_income", "revenue"),
    "debt_to_equity": _sr("coalesce(liabilities, CASE WHEN assets - equity >= 0 THEN assets - equity END)", "equity"), "accruals": _sr("net_income - cash_ops", "assets")}
_RATIOS |= {out: f"CASE WHEN abs(lag({c}, 252) OVER ({T})) > 1e-9 THEN ({c} - lag({c}, 252) OVER ({T})) / abs(lag({c}, 252) OVER ({T})) END" for out, c in (("revenue_growth_yoy", "revenue"), ("eps_growth_yoy", "eps_diluted"))}
_RATIO_SQL = "SELECT date, ticker, " + ", ".join(f"{x} AS fund_{name}" for name, x in _RATIOS.items()) + " FROM (SELECT *, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _RATIO_INPUTS.items()) + " FROM bars)"


@query("f03_fundamental_ratios", KEY + " ".join(f"fund_{r}~" for r in _RATIOS), _RATIO_SQL)
def _(t):
    return fundamentals.ratios(t.bars.selectExpr("*", *(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _RATIO_INPUTS.items())))


@query("f04_fill_costs", KEY + "fill^ fee^", "SELECT date, ticker, adj_close * (1 + CASE WHEN ticker % 2 = 0 THEN 1 ELSE -1 END * 0.0005) AS fill, volume * 0.005 + 1 AS fee FROM bars")
def _(t):
    side = F.when(F.col("ticker") % 2 == 0, 1).otherwise(-1)
    return t.bars.withColumns({"fill": scalars.fill_price(F.col("adj_close"), side, 0.0005), "fee": scalars.commission(F.col("volume"), 0.005, 1.0)})


@query("f05_daily_rate", "date rate~", "SELECT date, pow(1 + irx_yield / 100, 1.0 / 252) - 1 AS rate FROM macro", digits=9)
def _(t):
    return t.macro.withColumn("rate", scalars.daily_rate(F.col("irx_yield") / 100))


@query("f06_exposure_scale", "date scale~", "SELECT date, CASE WHEN tnx_yield IS NULL THEN 1 ELSE least(1, greatest(0, 2 * (1 - tnx_yield / 5))) END AS scale FROM macro")
def _(t):
    return t.macro.withColumn("scale", scalars.exposure_scale(F.col("tnx_yield") / 5))


@query("f07_decision_id", "date id", "SELECT date, left(sha256(CAST(date AS VARCHAR) || '|s1|' || string_agg(CAST(ticker AS VARCHAR), '|' ORDER BY CAST(ticker AS VARCHAR))), 8) AS id FROM ranked WHERE rk <= 5 GROUP BY date")
def _(t):
    top = selection.targets(t.scored, selection.SelectionRules(top_n=5))
    return top.groupBy("date").agg(F.collect_list(F.col("ticker").cast("string")).alias("names")).withColumn("id", scalars.decision_id(F.col("date"), F.col("names"), "s1"))


@query("f08_normalise_ticker", "raw ticker", "SELECT s_name || '.b' AS raw, translate(upper(trim(s_name || '.b')), '.', '-') AS ticker FROM supplier")
def _(t):
    return t.read("supplier").select(F.concat("s_name", F.lit(".b")).alias("raw")).withColumn("ticker", scalars.normalise_ticker(F.col("raw")))


def quotes(t):
    q = t.bars.groupBy("ticker").agg(F.max_by("adj_close", "date").alias("q"), F.min_by("adj_close", "date").alias("s"))
    return q.select("ticker", F.when(F.col("ticker") % 7 != 0, F.col("q")).alias("quote"), F.when(F.col("ticker") % 14 != 0, F.col("s")).alias("seen"))


@query("f09_mark_price", "account_id:big ticker mark^", "SELECT account_id, p.ticker, coalesce(CASE WHEN quote > 0 THEN quote END, CASE WHEN seen > 0 THEN seen END, entry_price) AS mark FROM positions p LEFT JOIN quotes q ON q.ticker = p.ticker")
def _(t):
    return t.sql("positions").join(quotes(t), "ticker", "left").withColumn("mark", scalars.mark_price(F.col("quote"), F.col("seen"), F.col("entry_price")))
