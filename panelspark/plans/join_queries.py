"""Queries of the point-in-time, calendar and dimension joins, the model dataflow's date plans, and sources."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import borrow, features, fundamentals, labels, pit, portfolio, quality
from ..sources import snapshots, tables
from ..sources.stored import shared_folder, stored
from .base import HORIZON, T, pct_rank, roll
from .registry import query
from .window_queries import _DEDUPED, _EARLIEST, _RATE, _RATIOS, _TTM, revenue_ttm

KEY = "date ticker "
D = dt.date


@query("j01_members_at", KEY, "SELECT date, ticker FROM bars b WHERE EXISTS (SELECT 1 FROM stints s WHERE s.ticker = b.ticker AND b.date >= s.start_date AND (s.end_date IS NULL OR b.date < s.end_date))")
def _(t):
    return pit.members_at(t.bars, t.stints)


@query("j02_overlapping", "ticker", "SELECT DISTINCT ticker FROM stints WHERE start_date <= DATE '1999-06-30' AND (end_date IS NULL OR end_date > DATE '1999-03-01')")
def _(t):
    return pit.tickers_overlapping(t.stints, D(1999, 3, 1), D(1999, 6, 30))


@query("j03_current_members", "ticker", "SELECT DISTINCT ticker FROM stints WHERE end_date IS NULL")
def _(t):
    return pit.current_members(t.stints)


_WIDE = f"(SELECT ticker, filed, arg_max(value, period_end) FILTER (concept = 'assets') AS assets, arg_max(value, period_end) FILTER (concept = 'revenue') AS revenue FROM (SELECT ticker, 'assets' AS concept, filed, period_end, value FROM {_DEDUPED} WHERE concept = 'assets' UNION ALL SELECT ticker, 'revenue', filed, period_end, ttm FROM {_TTM}) GROUP BY ticker, filed)"


@query("j04_asof_fundamentals", KEY + "assets~ revenue~", f"SELECT date, ticker, assets, revenue FROM bars b ASOF LEFT JOIN (SELECT ticker AS ta, filed AS fa, assets FROM {_WIDE} WHERE assets IS NOT NULL) a ON ta = b.ticker AND b.date >= fa ASOF LEFT JOIN (SELECT ticker AS tr, filed AS fr, revenue FROM {_WIDE} WHERE revenue IS NOT NULL) r ON tr = b.ticker AND b.date >= fr", digits=2)
def _(t):
    held = fundamentals.dedupe_filings(t.facts).where("concept = 'assets'").select("ticker", "concept", "filed", "period_end", "value")
    flows = revenue_ttm(t).select("ticker", "concept", "filed", "period_end", F.col("ttm").alias("value"))
    return fundamentals.asof_fundamentals(t.bars, held.unionByName(flows), ["assets", "revenue"])


@query("j05_days_since_event", KEY + "days:int", "SELECT b.date, b.ticker, b.date - e.earnings_date AS days FROM bars b ASOF LEFT JOIN earnings e ON e.ticker = b.ticker AND b.date >= e.earnings_date")
def _(t):
    return pit.days_since(t.bars, tables.earnings_dates(t.sql("earnings")), "earnings_date", "days")


_EVENTS = "(SELECT DISTINCT date AS e FROM macro WHERE day(date) = 15)"


@query("j06_days_to_next_event", "date days_to_event:int", f"SELECT date, least(60, coalesce((SELECT min(e) FROM {_EVENTS} v WHERE e >= s.date) - date, 60)) AS days_to_event FROM sessions s")
def _(t):
    return pit.days_to_next(t.sessions, t.macro.where("day(date) = 15").select(F.col("date").alias("e")), "e", 60)


@query("j07_next_session", "ticker filed session n:big", "SELECT ticker, filed, session, count(*) AS n FROM (SELECT i.ticker, i.filed, (SELECT min(date) FROM sessions s WHERE s.date >= i.filed) AS session FROM insider i) WHERE session IS NOT NULL GROUP BY 1, 2, 3")
def _(t):
    return pit.next_session(t.sql("insider"), t.sessions, "filed").groupBy("ticker", "filed", "session").agg(F.count("*").alias("n"))


@query("j08_join_volume", KEY + "volume~", "SELECT g.date, g.ticker, b.volume FROM grid g LEFT JOIN bars b ON b.date = g.date AND b.ticker = g.ticker")
def _(t):
    return features.join_volume(t.grid.select("date", "ticker", "adj_close"), t.bars)


@query("j09_sector_override", KEY + "sector", "SELECT b.date, b.ticker, CASE WHEN b.ticker % 4 = 0 AND b.date < DATE '1998-09-28' THEN 'OLD' ELSE sector END AS sector FROM bars b LEFT JOIN sectors s ON s.ticker = b.ticker")
def _(t):
    old = t.sectors.where("ticker % 4 = 0").select("ticker", F.lit("OLD").alias("sector"), F.lit(D(1998, 9, 28)).alias("valid_to"))
    return features.join_sectors(t.bars, t.sectors, old)


@query("j10_join_macro", KEY + "vix^ tnx_yield^", "SELECT b.date, ticker, vix, tnx_yield FROM bars b LEFT JOIN macro m ON m.date = b.date")
def _(t):
    return features.join_macro(t.bars, t.macro)


_M1, _M2 = "(SELECT date, vix, tnx_yield, irx_yield FROM macro WHERE day(date) <= 20)", "(SELECT date, vix + 1 AS vix, tnx_yield + 1 AS tnx_yield, irx_yield + 1 AS irx_yield FROM macro WHERE day(date) > 10)"


@query("j11_merge_macro", "date vix^ tnx_yield^ irx_yield^", f"SELECT coalesce(a.date, b.date) AS date, coalesce(a.vix, b.vix) AS vix, coalesce(a.tnx_yield, b.tnx_yield) AS tnx_yield, coalesce(a.irx_yield, b.irx_yield) AS irx_yield FROM {_M1} a FULL JOIN {_M2} b ON a.date = b.date")
def _(t):
    second = t.macro.where("day(date) > 10").select("date", *((F.col(c) + 1).alias(c) for c in ("vix", "tnx_yield", "irx_yield")))
    return features.merge_macro(t.macro.where("day(date) <= 20"), second)


@query("j12_ticker_fallback", KEY + "source:int", "SELECT date, ticker, CASE WHEN ticker % 3 = 0 THEN 2 ELSE 1 END AS source FROM bars")
def _(t):
    first = t.bars.withColumn("adj_close", F.when(F.col("ticker") % 3 != 0, F.col("adj_close"))).withColumn("source", F.lit(1))
    return tables.ticker_fallback(first, t.bars.withColumn("source", F.lit(2)))


@query("j13_align_to_calendar", "date nav~", "SELECT date, v / first_value(v) OVER (ORDER BY date) * 100000 AS nav FROM (SELECT s.date, coalesce(last_value(close IGNORE NULLS) OVER (ORDER BY s.date), first_value(close IGNORE NULLS) OVER (ORDER BY s.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM sessions s LEFT JOIN (SELECT * FROM benchmark_px WHERE day(date) % 3 = 2) b ON b.date = s.date)", digits=4)
def _(t):
    return portfolio.align(t.benchmark.where("day(date) % 3 = 2"), t.sessions, "close", 100000.0)


_TWO = "(SELECT a.date, a.nav AS a, b.adj_close AS b FROM bnav a JOIN (SELECT * FROM bars WHERE ticker = 1) b ON a.date = b.date)"


def two_navs(t):
    return t.benchmark.select("date", F.col("close").alias("nav")), t.bars.where("ticker = 1").select("date", F.col("adj_close").alias("nav"))


@query("j14_overlap", "date nav_a~ nav_b~", f"SELECT date, a / first_value(a) OVER (ORDER BY date) AS nav_a, b / first_value(b) OVER (ORDER BY date) AS nav_b FROM {_TWO}")
def _(t):
    return portfolio.overlap(*two_navs(t))


@query("j15_shift_sessions", KEY + "exit_date", "SELECT b.date, ticker, x.date AS exit_date FROM bars b JOIN sessions s ON s.date = b.date LEFT JOIN sessions x ON x.session_no = s.session_no + 10")
def _(t):
    return pit.shift_sessions(t.bars, t.sessions, 10, "exit_date")


@query("j16_extend_sessions", "date session_no:int", "SELECT date, row_number() OVER (ORDER BY date) AS session_no FROM (SELECT date FROM sessions UNION SELECT date FROM (SELECT (SELECT max(date) FROM sessions) + CAST(i AS INT) AS date FROM range(1, 9) r(i)))")
def _(t):
    last = t.sessions.agg(F.max("date").alias("m"))
    ahead = last.select(F.explode(F.sequence(F.date_add("m", 1), F.date_add("m", 30))).alias("date"))
    as_of = last.first()[0] + dt.timedelta(days=3)
    return pit.extend_sessions(t.sessions, ahead, 5, as_of)


_IDS = "(SELECT t.ticker, CASE WHEN t.ticker % 3 = 0 THEN lpad(CAST(t.ticker * 7 AS VARCHAR), 10, '0') WHEN t.ticker % 5 = 0 THEN 'c' || CAST(t.ticker AS VARCHAR) END AS cik, CASE WHEN t.ticker % 3 = 0 THEN 'primary' WHEN t.ticker % 5 = 0 THEN 'cache' ELSE 'missing' END AS layer FROM sectors t)"


@query("j17_resolve_ids", "ticker cik layer", f"SELECT * FROM {_IDS}")
def _(t):
    first = t.sectors.where("ticker % 3 = 0").select("ticker", F.lpad((F.col("ticker") * 7).cast("string"), 10, "0").alias("cik"))
    cache = t.sectors.where("ticker % 5 = 0").select("ticker", F.concat(F.lit("c"), F.col("ticker").cast("string")).alias("cik"))
    return tables.resolve_ids(t.sectors.select("ticker"), first, cache)


@query("j18_borrow_concentration", "short_rate~ all_rate~ ratio~", f"SELECT *, short_rate / all_rate AS ratio FROM (SELECT avg(rate) FILTER (b.ticker IS NOT NULL) AS short_rate, avg(rate) AS all_rate FROM {_RATE} r LEFT JOIN (SELECT DISTINCT date, ticker FROM book WHERE weight < 0) b ON b.date = r.date AND b.ticker = r.ticker)")
def _(t):
    from ..operators.selection import decile_book

    rates = borrow.estimated_rates(borrow.realised_volatility(features.returns(t.bars, lags=(1,)))).select("date", "ticker", "rate")
    return borrow.concentration(decile_book(t.scored, 0.1).where("weight < 0"), rates)


@query("j19_resolve_rates", KEY + "rate~", f"SELECT date, ticker, coalesce(rate, 0.01) AS rate FROM {_RATE}")
def _(t):
    return borrow.resolve_rates(borrow.realised_volatility(features.returns(t.bars, lags=(1,))), 0.01, proxy=True)


# --- model dataflow: dates

@query("m01_purge", KEY, "SELECT date, ticker FROM scored WHERE date < DATE '1998-01-01' AND date NOT IN (SELECT DISTINCT date FROM scored WHERE date < DATE '1998-01-01' ORDER BY date DESC LIMIT 10)")
def _(t):
    return labels.purge_before(t.scored, D(1998, 1, 1), HORIZON)


_DD = "(SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM scored))"


@query("m02_purged_folds", "date fold:int role", f"SELECT * FROM (SELECT date, k AS fold, CASE WHEN i < s - 10 THEN 'train' WHEN i >= s AND i < s + size THEN 'test' END AS role FROM (SELECT *, n // 5 AS size, n - (4 - k + 1) * (n // 5) AS s FROM {_DD} CROSS JOIN range(1, 5) r(k))) WHERE role IS NOT NULL")
def _(t):
    return labels.purged_folds(t.scored, 4, HORIZON)


@query("m03_inner_split", "date role", f"SELECT * FROM (SELECT date, CASE WHEN i >= n - floor(n * 0.15) THEN 'validation' WHEN i < n - floor(n * 0.15) - 10 THEN 'train' END AS role FROM {_DD}) WHERE role IS NOT NULL")
def _(t):
    return labels.inner_split(t.scored, 0.15, HORIZON)


@query("m07_walk_forward_plan", "month train_end n_train:big n_test:big", f"SELECT month, e.date AS train_end, greatest(0, first - 10) AS n_train, n_test FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, min(i) AS first, count(*) AS n_test FROM {_DD} WHERE date >= DATE '1998-01-01' GROUP BY 1) m LEFT JOIN {_DD} e ON e.i = first - 11")
def _(t):
    return labels.walk_forward_plan(t.scored, D(1998, 1, 1), HORIZON)


@query("m08_baseline_scores", KEY + "prob~ fwd_ret~", "SELECT * FROM scored", digits=5)
def _(t):
    return t.scored


_FLOWS = ", ".join(f"'{c}'" for c in fundamentals.FLOWS)
#: What filings let a panel know: ticker, concept, period_end, filed, value.
_KNOWN = f"""known AS MATERIALIZED (WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, concept, period_end, filed ORDER BY period_start DESC NULLS LAST, value DESC) AS r FROM filings) WHERE r = 1),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, concept, period_end ORDER BY filed, value DESC) AS v FROM d WHERE concept IN ({_FLOWS}) AND period_end - period_start BETWEEN 80 AND 100) WHERE v = 1)
SELECT ticker, concept, period_end, filed, value FROM d WHERE concept NOT IN ({_FLOWS}) UNION ALL SELECT ticker, concept, period_end, last_filed, ttm FROM (SELECT ticker, concept, period_end, sum(value) OVER w AS ttm, max(filed) OVER w AS last_filed, count(*) OVER w AS n FROM q WINDOW w AS (PARTITION BY ticker, concept ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE n = 4)"""
_ASOF = " ".join(f"ASOF LEFT JOIN (SELECT ticker AS t{i}, filed AS f{i}, arg_max(value, period_end) AS {c} FROM known WHERE concept = '{c}' GROUP BY 1, 2) k{i} ON t{i} = b.ticker AND b.date >= f{i}" for i, c in enumerate(fundamentals.RATIO_INPUTS))
_UP = f"CASE WHEN adj_close IS NOT NULL AND lag(adj_close) OVER ({T}) IS NOT NULL THEN greatest(adj_close - lag(adj_close) OVER ({T}), 0) END"
_DOWN = f"CASE WHEN adj_close IS NOT NULL AND lag(adj_close) OVER ({T}) IS NOT NULL THEN greatest(lag(adj_close) OVER ({T}) - adj_close, 0) END"
_PRICE = f"""px AS MATERIALIZED (SELECT *, CASE WHEN dn = 0 AND up = 0 THEN 50 WHEN dn = 0 THEN 100 WHEN up IS NOT NULL THEN 100 - 100 / (1 + up / dn) END AS rsi_14, (adj_close - (m20 - 2 * s20)) / (4 * s20 + 1e-9) AS bb_pos,
adj_close / m20 - 1 AS px_sma_20, ret_5d - (volume / nullif(v5, 0) - 1) AS pv_divergence FROM (SELECT *, {roll('avg', 'gain', 14)} AS up, {roll('avg', 'loss', 14)} AS dn, {roll('avg', 'adj_close', 20)} AS m20, {roll('stddev_samp', 'adj_close', 20)} AS s20,
adj_close / {roll('avg', 'adj_close', 50)} - 1 AS px_sma_50, adj_close / {roll('max', 'adj_close', 252)} AS high_252, adj_close / {roll('max', 'adj_close', 63)} - 1 AS drawdown_63, lag(volume, 5) OVER ({T}) AS v5,
(volume - {roll('avg', 'volume', 21)}) / nullif({roll('stddev_samp', 'volume', 21)}, 0) AS vol_z, volume / {roll('avg', 'volume', 5)} AS vol_ratio, {roll('avg', 'volume', 10)} / {roll('avg', 'volume', 21)} AS vol_trend
FROM (SELECT *, {_UP} AS gain, {_DOWN} AS loss FROM returns)))"""
_MEMBERS = f"""mem AS MATERIALIZED (SELECT b.*, {", ".join(fundamentals.RATIO_INPUTS)}, b.date - e.earnings_date AS days_since_earnings FROM px b {_ASOF} ASOF LEFT JOIN earnings e ON e.ticker = b.ticker AND b.date >= e.earnings_date
WHERE EXISTS (SELECT 1 FROM stints s WHERE s.ticker = b.ticker AND b.date >= s.start_date AND (s.end_date IS NULL OR b.date < s.end_date)))"""
_VIX = """vx AS (SELECT a.date, any_value(a.vix) AS vix, any_value(a.tnx_yield) AS tnx_yield, any_value(a.irx_yield) AS irx_yield, any_value(a.tnx_yield - a.irx_yield) AS yield_spread, any_value(a.chg) AS vix_change_5d,
CASE WHEN any_value(a.vix) IS NOT NULL AND count(b.vix) + 1 >= 60 THEN count(*) FILTER (b.vix <= a.vix) / nullif(count(b.i), 0) END AS vix_percentile
FROM (SELECT *, row_number() OVER (ORDER BY date) AS i, vix / nullif(lag(vix, 5) OVER (ORDER BY date), 0) - 1 AS chg FROM macro) a LEFT JOIN (SELECT vix, row_number() OVER (ORDER BY date) AS i FROM macro) b ON b.i < a.i AND b.i >= a.i - 251 GROUP BY a.date)"""
_DAYS = f"""cal AS (SELECT date, least(60, coalesce((SELECT min(e) FROM {_EVENTS} v WHERE e >= s.date) - date, 60)) AS days_to_event, sin(2 * pi() * (month(date) - 1) / 12) AS month_sin, cos(2 * pi() * (month(date) - 1) / 12) AS month_cos,
CAST(month(date) % 3 = 0 AS INT) AS quarter_end_month, last_day(make_date(year(date), 3 * CAST(ceil(month(date) / 3.0) AS BIGINT), 1)) - date AS days_to_quarter_end FROM sessions s)"""
_TIMES = [*(f"ret_{n}d" for n in features.LAGS), "mom_21_5", "vol_10d", "vol_21d", "rsi_14", "px_sma_20", "px_sma_50", "bb_pos", "high_252", "drawdown_63", "vol_z", "vol_ratio", "vol_trend", "pv_divergence"]
_RANKED, _SPREAD, _DATED = ("ret_21d", "vol_10d", "vol_z"), ("ret_5d", "ret_21d", "vol_10d"), ["vix", "vix_change_5d", "tnx_yield", "irx_yield", "yield_spread", "vix_percentile", "month_sin", "month_cos"]
_WHOLE = f"""WITH {_KNOWN}, {_PRICE}, {_MEMBERS}, {_VIX}, {_DAYS} SELECT m.date, m.ticker, {", ".join(_TIMES)}, {", ".join(f"{pct_rank(c, 'm.date')} AS {c}_rank" for c in _RANKED)}, {", ".join(f"median({c}) OVER (PARTITION BY m.date) AS mkt_{c}" for c in _SPREAD[:2])},
sector, {", ".join(f"{c} - median({c}) OVER (PARTITION BY m.date, sector) AS {c}_vs_sector" for c in _SPREAD)}, days_since_earnings, {", ".join(f"fund_{n}" for n in _RATIOS)}, {", ".join(_DATED)}, days_to_event, CAST(days_to_event <= 5 AS INT) AS within_5d, quarter_end_month, days_to_quarter_end
FROM (SELECT *, {", ".join(f"{x} AS fund_{n}" for n, x in _RATIOS.items())} FROM mem) m JOIN sectors s ON s.ticker = m.ticker LEFT JOIN vx ON vx.date = m.date LEFT JOIN cal ON cal.date = m.date"""
_WHOLE_COLUMNS = KEY + "sector days_since_earnings:int days_to_event:int within_5d:int quarter_end_month:int days_to_quarter_end:int " + " ".join(f"{c}~" for c in [*(c for c in _TIMES if c not in ("vol_ratio", "vol_trend")), *(f"{c}_rank" for c in _RANKED), "mkt_ret_5d", "mkt_ret_21d", *(f"{c}_vs_sector" for c in _SPREAD), *(f"fund_{n}" for n in _RATIOS), *_DATED[5:], "vix_change_5d"]) + " vol_ratio! vol_trend! vix! tnx_yield! irx_yield! yield_spread!"


def whole_panel(bars, stints, sectors, macro, filings, earnings):
    events = macro.where("day(date) = 15").select("date")
    return features.feature_panel(bars, stints, sectors, macro, fundamentals.known_values(filings), tables.earnings_dates(earnings), events)


@query("m09_feature_panel", _WHOLE_COLUMNS, f"SELECT * FROM ({_WHOLE})", digits=4)
def _(t):
    return whole_panel(t.bars, t.stints, t.sectors, t.macro, t.sql("filings"), t.sql("earnings"))


# --- sources and set operations

@query("s02_clean_stints", "ticker start_date end_date", "SELECT translate(upper(trim('a.' || CAST(ticker AS VARCHAR))), '.', '-') AS ticker, start_date, end_date FROM stints")
def _(t):
    raw = t.stints.select(F.concat(F.lit(" a."), F.col("ticker").cast("string")).alias("ticker"), F.col("start_date").cast("string").alias("start_date"), F.coalesce(F.col("end_date").cast("string"), F.lit("n/a")).alias("end_date"))
    return tables.clean_stints(raw)


@query("s03_bars_between", KEY + "volume~", "SELECT date, ticker, volume FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND ticker IN (SELECT ticker FROM stints)")
def _(t):
    return tables.bars_between(t.bars, t.stints, D(1996, 1, 1), D(1996, 12, 31))


@query("s04_macro_from_series", "date vix^ tnx_yield^", "SELECT date, last_value(vix IGNORE NULLS) OVER (ORDER BY date) AS vix, last_value(tnx_yield IGNORE NULLS) OVER (ORDER BY date) AS tnx_yield FROM macro")
def _(t):
    series = t.macro.unpivot(["date"], ["vix", "tnx_yield"], "series", "value").where("value is not null")
    return tables.macro_from_series(series.unionByName(t.macro.select("date", F.lit("other").alias("series"), F.lit(0.0).alias("value"))), ["vix", "tnx_yield"])


@query("s05_benchmark_series", "date close^", "SELECT date, adj_close AS close FROM bars WHERE ticker = 1")
def _(t):
    return tables.benchmark_series(t.bars, 1)


@query("s06_extract_concepts", "ticker concept period_end filed value~", "SELECT f.ticker, 'size' AS concept, period_end, filed, value FROM facts f WHERE concept = 'assets' OR NOT EXISTS (SELECT 1 FROM facts g WHERE g.ticker = f.ticker AND g.concept = 'assets')", digits=2)
def _(t):
    obs = F.struct(F.col("period_start").alias("start"), F.col("period_end").alias("end"), F.col("value").alias("val"), "filed", "form", "fy", "fp")
    tags = t.facts.groupBy("ticker", "concept").agg(F.collect_list(obs).alias("o"))
    maps = tags.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct(F.create_map(F.lit("USD"), "o").alias("units"))))).alias("m"))
    raw = maps.select("ticker", F.to_json(F.struct(F.struct(F.col("m").alias("us-gaap")).alias("facts"))).alias("json"))
    prio = t.spark.createDataFrame([("size", "assets", 1), ("size", "revenue", 2)], "concept string, tag string, priority int")
    return fundamentals.extract_concepts(raw, prio)


@query("s07_id_map", "ticker cik", "SELECT translate(upper(trim(s_name || '.b')), '.', '-') AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier")
def _(t):
    return tables.id_map(t.read("supplier").select(F.concat("s_name", F.lit(".b")).alias("ticker"), F.col("s_suppkey").alias("cik")))


@query("s08_sectors", "ticker sector", "SELECT * FROM sectors")
def _(t):
    return t.sectors


@query("s09_insider_purchases", "ticker filed value~ owner:big planned", "SELECT CAST(ticker AS VARCHAR) AS ticker, filed, value, owner, planned FROM insider WHERE owner % 2 = 0 AND value > 0", digits=2)
def _(t):
    i = t.read("orders").select(F.col("o_orderkey").alias("accession"), (F.col("o_custkey") % t.read("supplier").count() + 1).cast("string").alias("symbol"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").startswith("1").alias("plan"))
    trades = i.select("accession", F.when(F.col("owner") % 2 == 0, "P").otherwise("S").alias("code"), F.lit(1.0).alias("shares"), "price")
    filings = i.select("accession", "symbol", F.date_format("d", "dd-MMM-yyyy").alias("filed"), F.when(F.col("plan"), "1").otherwise("0").alias("aff10b5one"))
    return tables.insider_purchases(trades, filings, i.select("accession", "owner"))


@query("s10_earnings_dates", "ticker earnings_date", "SELECT * FROM earnings")
def _(t):
    e = t.sql("earnings")
    return tables.earnings_dates(e.unionByName(e).withColumn("earnings_date", F.col("earnings_date").cast("string")))


@query("s11_event_dates", "date kind", "SELECT DISTINCT date, CASE WHEN day(date) = 15 THEN 'scheduled' ELSE 'unscheduled' END AS kind FROM macro WHERE day(date) IN (15, 28)")
def _(t):
    return tables.event_dates(t.macro.where("day(date) = 15"), t.macro.where("day(date) = 28"))


@query("s12_sessions", "date session_no:int", "SELECT * FROM sessions")
def _(t):
    return t.sessions


def _text_digest(columns: str) -> str:
    return "CAST(sum(CAST('0x' || left(md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in columns.split()) + ")), 8) AS BIGINT)) AS BIGINT)"


@query("s13_snapshots", "name n_rows:big n_columns:int columns digest:big has_bytes", f"""SELECT 'sectors' AS name, count(*) AS n_rows, 2 AS n_columns, 'ticker,sector' AS columns, {_text_digest('ticker sector')} AS digest, true AS has_bytes FROM sectors
UNION ALL SELECT 'stints', count(*), 3, 'ticker,start_date,end_date', {_text_digest('ticker start_date end_date')}, true FROM stints""")
def _(t):
    """Two tables written as audited snapshots; the log of what was committed."""
    folder = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"
    for name, df in (("sectors", t.sectors), ("stints", t.stints)):
        snapshots.write_snapshot(df, folder, name)
    return snapshots.snapshot_log(t.spark, folder).withColumn("has_bytes", F.col("bytes") > 0)


@query("s16_landing", "ticker landed_on n:big", """SELECT s.ticker, CASE WHEN s.ticker % 3 = 0 THEN DATE '2001-07-10' ELSE DATE '2001-06-01' END AS landed_on, CASE WHEN s.ticker % 3 = 0 AND s.ticker % 2 = 0 THEN 2 WHEN s.ticker % 3 <> 0 AND s.ticker % 5 <> 0 THEN 1 ELSE 0 END AS n FROM sectors s""")
def _(t):
    """All tickers land once, those of a stale third again later: answers, empty answers, and what is left as it was."""
    folder, old = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}", t.sectors.select("ticker")
    snapshots.land(old.where("ticker % 5 <> 0").withColumn("value", F.lit(1.0)), old, folder, D(2001, 6, 1))
    stale = old.where("ticker % 3 = 0")
    snapshots.land(stale.where("ticker % 2 = 0").select("ticker", F.explode(F.array(F.lit(2.0), F.lit(3.0))).alias("value")), stale, folder, D(2001, 7, 10))
    return snapshots.landings(t.spark, folder)


@query("s13_content_hash", "n_rows hash")
def _(t):
    return quality.content_hash(t.sectors)


@query("s14_wide_to_long", "date ticker:big adj_close^ volume~", "SELECT * FROM bars")
def _(t):
    return tables.arrays_to_long(labels.to_arrays(t.bars, ["adj_close"]), labels.to_arrays(t.bars, ["volume"]))


@query("s01_read_scored", "source date ticker prob~", "SELECT source, date, ticker, prob FROM scored CROSS JOIN (VALUES ('parquet'), ('csv')) v(source)", digits=5)
def _(t):
    """A scored panel written as partitioned Parquet and as CSV, each in parts, and read by suffix."""
    folder = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}"
    panel = stored(t.unlabelled.select("date", "ticker", "prob", "adj_close"))
    tables.write_panel(panel, f"{folder}/panel.parquet")
    tables.write_csv(panel.withColumn("ticker", F.col("ticker").cast("string")), f"{folder}/report.csv")
    made = [tables.read_scored(t.spark, f"{folder}/{n}").select(F.lit(n.rsplit(".", 1)[1]).alias("source"), "date", F.col("ticker").cast("long").alias("ticker"), "prob") for n in ("panel.parquet", "report.csv")]
    return made[0].unionByName(made[1])


@query("s16_work_list", "ticker", "SELECT ticker FROM sectors WHERE ticker % 2 = 1 OR ticker % 4 = 0")
def _(t):
    landed = t.sectors.where("ticker % 2 = 0").select("ticker", F.when(F.col("ticker") % 4 == 0, F.lit(D(2020, 1, 1))).otherwise(F.lit(D(2020, 3, 1))).alias("landed_on"))
    return tables.work_list(t.sectors, landed, D(2020, 3, 10), 30)


@query("s17_absent_series", "date vix^ tnx_yield^", "SELECT date, vix, CAST(NULL AS DOUBLE) AS tnx_yield FROM macro WHERE vix IS NOT NULL")
def _(t):
    return tables.macro_from_series(t.macro.unpivot(["date"], ["vix"], "series", "value").where("value is not null"), ["vix", "tnx_yield"])


@query("u01_later_wins", KEY + "batch:int", "SELECT date, ticker, CASE WHEN ticker % 2 = 0 THEN 2 ELSE 1 END AS batch FROM bars")
def _(t):
    return tables.union_later_wins([t.bars.withColumn("batch", F.lit(1)), t.bars.where("ticker % 2 = 0").withColumn("batch", F.lit(2))])


@query("u02_union", KEY, "SELECT date, ticker FROM bars UNION ALL SELECT date, ticker FROM scored")
def _(t):
    return t.bars.select("date", "ticker").unionByName(t.scored.select("date", "ticker"))


@query("u03_live_universe", "ticker", "SELECT ticker FROM bars INTERSECT SELECT ticker FROM stints WHERE end_date IS NULL")
def _(t):
    return tables.live_universe(t.bars, pit.current_members(t.stints))


@query("u04_departed", "ticker", "SELECT ticker FROM bars EXCEPT SELECT ticker FROM stints WHERE end_date IS NULL")
def _(t):
    return tables.departed(t.bars, pit.current_members(t.stints))


@query("u05_distinct", "ticker", "SELECT DISTINCT ticker FROM bars")
def _(t):
    return t.bars.select("ticker").distinct()


@query("a07_dedupe_filings", "ticker concept period_start period_end filed value~", f"SELECT * FROM {_DEDUPED}", digits=2)
def _(t):
    return fundamentals.dedupe_filings(t.facts)


_Q = "(SELECT ticker, concept, fy, fp, period_end, value FROM facts WHERE fp <> 'Q4' AND filed = period_end + 15)"
_Y = "(SELECT ticker, concept, fy, max(period_end) AS period_end, max(filed) AS filed, sum(value) AS value FROM facts WHERE filed = period_end + 15 GROUP BY 1, 2, 3)"


@query("a08_derive_q4", "ticker concept fy period_end filed value~", f"SELECT y.ticker, y.concept, y.fy, y.period_end, y.filed, y.value - s AS value FROM {_Y} y JOIN (SELECT ticker, concept, fy, sum(value) AS s FROM {_Q} GROUP BY 1, 2, 3 HAVING count(DISTINCT fp) = 3) q ON q.ticker = y.ticker AND q.concept = y.concept AND q.fy = y.fy", digits=2)
def _(t):
    f = t.facts.where("filed = date_add(period_end, 15)")
    years = f.groupBy("ticker", "concept", "fy").agg(F.max("period_end").alias("period_end"), F.max("filed").alias("filed"), F.sum("value").alias("value"))
    return fundamentals.derive_q4(f, years)


@query("a09_vintages", "ticker concept period_end filed value~", f"SELECT * FROM {_EARLIEST}", digits=2)
def _(t):
    return fundamentals.vintages(fundamentals.dedupe_filings(t.facts), ["revenue"])
