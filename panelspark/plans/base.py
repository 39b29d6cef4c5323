"""Tables that queries start from, derived by Spark from the given ones, and the same as SQL text."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.windows import pct_rank_avg
from ..operators import features, fundamentals, labels, pit
from ..sources.stored import stored

HORIZON = 10


class Tables:
    """The panel tables of a data folder; everything is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, name: str) -> DataFrame:
        """A table of ``SQL`` run by Spark on the files it needs."""
        text = closure(name) + f" SELECT * FROM {name}"
        files = [f for f in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") if re.search(rf"\b{f}\b", text)]
        return self.spark.sql(re.sub(r"\b(" + "|".join(files) + r")\b(?!\.)", r"{\1}", text) if files else text, **{f: self.read(f) for f in files})

    @cached_property
    def bars(self) -> DataFrame:
        return self.sql("bars")

    @cached_property
    def stints(self) -> DataFrame:
        return self.sql("stints")

    @cached_property
    def sectors(self) -> DataFrame:
        return self.sql("sectors")

    @cached_property
    def macro(self) -> DataFrame:
        return self.sql("macro")

    @cached_property
    def facts(self) -> DataFrame:
        return self.sql("facts")

    @cached_property
    def sessions(self) -> DataFrame:
        return pit.sessions_of(self.bars)

    @cached_property
    def grid(self) -> DataFrame:
        return labels.dense_grid(self.bars)

    @cached_property
    def prices(self) -> DataFrame:
        return labels.ffill_prices(self.grid).select("date", "ticker", "adj_close")

    @cached_property
    def stored_bars(self) -> DataFrame:
        """Prices of the days on which a name trades, written once; for what reads them several times. The grid is not built."""
        return stored(self.bars.select("date", "ticker", "adj_close"))

    @cached_property
    def book_sessions(self) -> DataFrame:
        """``sessions``, written once, of the stored bars."""
        return stored(pit.sessions_of(self.stored_bars))

    @cached_property
    def signals(self) -> DataFrame:
        """``scored`` of the stored bars, without the forward return, which books do not read."""
        return self._ranked(self.stored_bars)

    @cached_property
    def unlabelled(self) -> DataFrame:
        """``scored`` without the forward return, for what reads it once."""
        return self._ranked(self.bars)

    def signals_at(self, dates: DataFrame, bars: DataFrame | None = None) -> DataFrame:
        """``signals`` of some dates (a calendar): names are ranked within a date, so that the rows of the others need no shuffle and no ranking.
        Columns that ``bars`` has besides those of the stored bars are kept."""
        return self._ranked(self.stored_bars if bars is None else bars, dates)

    @staticmethod
    def _ranked(bars: DataFrame, dates: DataFrame | None = None) -> DataFrame:
        more = [] if dates is None else [c for c in bars.columns if c not in ("date", "ticker", "adj_close")]
        r = features.returns(bars, lags=(21,)).where("ret_21d is not null")
        if dates is not None:
            r = r.join(F.broadcast(dates.select("date")), "date", "left_semi")
        return r.select("date", "ticker", "adj_close", pct_rank_avg(F.col("ret_21d"), "date").alias("prob"), *more)

    @cached_property
    def returns(self) -> DataFrame:
        return features.volatility(features.momentum(features.returns(self.bars)))

    @cached_property
    def scored(self) -> DataFrame:
        """Baseline scores: same-date percent rank of 21-row momentum, with the forward return on the grid."""
        fwd = labels.forward_by_session(self.bars, self.sessions, HORIZON).select("date", "ticker", "fwd_ret")
        return self.unlabelled.join(fwd, ["date", "ticker"], "left")

    @cached_property
    def labelled(self) -> DataFrame:
        return self.scored.withColumn("target", self._target())

    @cached_property
    def labelled_bars(self) -> DataFrame:
        """Bars with the forward return and the target of ``labelled``, without its score: for what needs a name's other windows too. No join of bars with bars."""
        fwd = labels.forward_in_order(self.bars, self.sessions, HORIZON)
        return fwd.withColumn("target", self._target())

    @staticmethod
    def _target():
        return F.when(F.col("fwd_ret").isNotNull(), (F.col("fwd_ret") >= 0.05).cast("double"))

    @cached_property
    def benchmark(self) -> DataFrame:
        return self.bars.groupBy("date").agg(F.avg("adj_close").alias("close"))

    configs = [(1, 5, 10, 0), (2, 10, 10, 0), (3, 5, 20, 2)]


T = "PARTITION BY ticker ORDER BY date"


def roll(fn: str, x: str, n: int, least: int | None = None) -> str:
    w = f"OVER ({T} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {least or n} THEN {fn}({x}) {w} END"


def pct_rank(x: str, keys: str = "date") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY {keys}, {x} IS NULL) END"


#: A concept for each order, so that filings hold all inputs of the ratios.
_CONCEPTS = "CASE o_custkey % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(fundamentals.RATIO_INPUTS)) + " END"

#: Named tables as SQL; the first ones run in Spark and DuckDB alike, the others are for DuckDB only.
SQL = {
    "bars": "SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS ticker, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS adj_close, sum(l_quantity) AS volume FROM lineitem GROUP BY CAST(l_shipdate AS DATE), l_suppkey",
    "sectors": "SELECT s_suppkey AS ticker, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "stints": "SELECT s_suppkey AS ticker, DATE '1995-01-01' + CAST((s_suppkey % 40) * 30 AS INT) AS start_date, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1999-01-01' + CAST((s_suppkey % 20) * 15 AS INT) END AS end_date FROM supplier UNION ALL SELECT s_suppkey, DATE '2000-06-01', CAST(NULL AS DATE) FROM supplier WHERE s_suppkey % 6 = 0",
    "macro": "SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice)/10000 AS vix, avg(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END)/50000 AS tnx_yield, avg(CASE WHEN o_orderpriority LIKE '5%' THEN o_totalprice END)/60000 AS irx_yield FROM orders GROUP BY CAST(o_orderdate AS DATE)",
    "earnings": "SELECT DISTINCT o_custkey % (SELECT count(*) FROM supplier) + 1 AS ticker, CAST(o_orderdate AS DATE) AS earnings_date FROM orders WHERE o_orderkey % 20 = 0",
    "insider": "SELECT o_custkey % (SELECT count(*) FROM supplier) + 1 AS ticker, CAST(o_orderdate AS DATE) AS filed, o_totalprice AS value, o_custkey AS owner, o_orderpriority LIKE '1%' AS planned FROM orders",
    "facts": "SELECT o_custkey % (SELECT count(*) FROM supplier) + 1 AS ticker, CASE WHEN o_orderkey % 3 = 0 THEN 'assets' ELSE 'revenue' END AS concept, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_start, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + 70) AS period_end, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + 70) + CAST(15 + o_orderkey % 3 * 20 AS INT) AS filed, sum(o_totalprice) AS value, '10-Q' AS form, CAST(extract(year FROM o_orderdate) AS INT) AS fy, concat('Q', CAST(extract(quarter FROM o_orderdate) AS STRING)) AS fp FROM orders GROUP BY 1, 2, 3, 4, 5, 7, 8, 9",
    "filings": "SELECT o_custkey % (SELECT count(*) FROM supplier) + 1 AS ticker, " + _CONCEPTS + " AS concept, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_start, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + 70) AS period_end, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + 70) + CAST(15 + o_orderkey % 3 * 20 AS INT) AS filed, sum(o_totalprice) AS value, '10-Q' AS form, CAST(extract(year FROM o_orderdate) AS INT) AS fy, concat('Q', CAST(extract(quarter FROM o_orderdate) AS STRING)) AS fp FROM orders GROUP BY 1, 2, 3, 4, 5, 7, 8, 9",
    "accounts": "SELECT c_custkey AS account_id, 100000 + c_acctbal AS cash, CAST(120000.0 AS DOUBLE) AS high_watermark FROM customer",
    "positions": "SELECT o_custkey AS account_id, l_suppkey AS ticker, sum(l_quantity) AS shares, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS entry_price, CAST(min(o_orderdate) AS DATE) AS entry_date, CAST(min(o_orderdate) AS DATE) + 60 AS expiry_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey",
    # DuckDB only
    "sessions": "SELECT date, row_number() OVER (ORDER BY date) AS session_no FROM (SELECT DISTINCT date FROM bars)",
    "grid": "SELECT s.date, t.ticker, b.adj_close, b.volume FROM sessions s CROSS JOIN (SELECT DISTINCT ticker FROM bars) t LEFT JOIN bars b ON b.date = s.date AND b.ticker = t.ticker",
    "prices": f"SELECT date, ticker, last_value(adj_close IGNORE NULLS) OVER ({T} ROWS UNBOUNDED PRECEDING) AS adj_close FROM grid",
    "rets": "SELECT *, " + ", ".join(f"adj_close / lag(adj_close, {n}) OVER ({T}) - 1 AS ret_{n}d" for n in features.LAGS) + " FROM bars",
    "returns": f"SELECT *, ret_21d - ret_5d AS mom_21_5, {roll('stddev_samp', 'ret_1d', 10)} AS vol_10d, {roll('stddev_samp', 'ret_1d', 21)} AS vol_21d FROM rets",
    "fwd": f"SELECT date, ticker, adj_close, lead(adj_close, {HORIZON}) OVER ({T}) / adj_close - 1 AS fwd_ret FROM grid",
    "scored": f"SELECT r.date, r.ticker, r.adj_close, {pct_rank('ret_21d', 'r.date')} AS prob, fwd_ret FROM rets r LEFT JOIN fwd f ON f.date = r.date AND f.ticker = r.ticker WHERE ret_21d IS NOT NULL",
    "labelled": "SELECT *, CASE WHEN fwd_ret IS NOT NULL THEN CAST(fwd_ret >= 0.05 AS DOUBLE) END AS target FROM scored",
    "benchmark_px": "SELECT date, avg(adj_close) AS close FROM bars GROUP BY date",
    "configs": "SELECT * FROM (VALUES (1, 5, 10, 0), (2, 10, 10, 0), (3, 5, 20, 2)) AS c(config_id, top_n, holding_days, rank_offset)",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY date ORDER BY prob DESC, ticker) AS rk FROM scored WHERE adj_close > 0",
    "numbered": "SELECT p.date, ticker, adj_close, session_no, ticker * 1000000 + session_no AS spot FROM prices p JOIN sessions s ON s.date = p.date WHERE adj_close IS NOT NULL",
    "picks": "SELECT config_id, holding_days, r.date, ticker, session_no, 1.0 / count(*) OVER (PARTITION BY config_id, r.date) AS w0 FROM ranked r JOIN sessions s ON s.date = r.date JOIN configs c ON r.rk > rank_offset AND r.rk <= rank_offset + top_n",
    "legs": "SELECT config_id, p.date, p.ticker, w0, e.date AS entry_date, x.date AS exit_date, e.adj_close AS entry_px, x.adj_close AS exit_px FROM picks p JOIN numbered e ON e.spot = p.ticker * 1000000 + p.session_no + 1 AND e.adj_close > 0 JOIN numbered x ON x.spot = p.ticker * 1000000 + p.session_no + 1 + holding_days",
    "cohorts": "SELECT config_id, date, min(entry_date) AS entry_date, min(exit_date) AS exit_date, sum(w * (exit_px / entry_px - 1)) AS gross, sum(w * (exit_px * 0.9995 / (entry_px * 1.0005) - 1)) AS net, count(*) AS names FROM (SELECT *, w0 / sum(w0) OVER (PARTITION BY config_id, date) AS w FROM legs) GROUP BY config_id, date",
    "fills": "SELECT *, lead(fill_date) OVER (ORDER BY k) AS next_fill FROM (SELECT date, CAST(floor((session_no - 1) / 21) AS BIGINT) AS k, session_no + 1 AS fill_no, lead(date) OVER (ORDER BY session_no) AS fill_date, session_no FROM sessions) WHERE (session_no - 1) % 21 = 0",
    "book": "SELECT date, ticker, adj_close, CASE WHEN hi <= k THEN 1.0 / k ELSE 0 END - CASE WHEN lo <= k THEN 1.0 / k ELSE 0 END AS weight FROM (SELECT *, CAST(floor(count(*) OVER (PARTITION BY date) * 0.1) AS BIGINT) AS k, row_number() OVER (PARTITION BY date ORDER BY prob DESC, ticker) AS hi, row_number() OVER (PARTITION BY date ORDER BY prob, ticker DESC) AS lo FROM scored WHERE adj_close > 0) WHERE k >= 1 AND (hi <= k OR lo <= k)",
    "periods": "SELECT k, b.ticker, weight, fill_date, next_fill, p.adj_close AS p0, q.adj_close / p.adj_close AS growth FROM book b JOIN fills f ON f.date = b.date AND next_fill IS NOT NULL JOIN numbered p ON p.spot = b.ticker * 1000000 + fill_no AND p.adj_close > 0 JOIN numbered q ON q.spot = b.ticker * 1000000 + fill_no + 21",
    "bnav": "SELECT date, close AS nav FROM benchmark_px",
    "bret": "SELECT date, nav, nav / lag(nav) OVER (ORDER BY date) - 1 AS ret FROM bnav",
    "quotes": "SELECT ticker, CASE WHEN ticker % 7 = 0 THEN NULL ELSE arg_max(adj_close, date) END AS quote, CASE WHEN ticker % 14 = 0 THEN NULL ELSE arg_min(adj_close, date) END AS seen FROM bars GROUP BY ticker",
}


#: Tables that DuckDB should compute once; Spark's own tables stay as they are.
_TWICE = ("sessions", "grid", "prices", "rets", "scored", "ranked", "numbered", "picks", "legs", "book", "periods")


def closure(*names: str) -> str:
    """WITH clause of the named tables and all that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in SQL:
            if other != name and other not in order and re.search(rf"\b(?:FROM|JOIN) \(?{other}\b", SQL[name]):
                need(other)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    return "WITH " + ", ".join(f"{n} AS {'MATERIALIZED ' if n in _TWICE else ''}({SQL[n]})" for n in order)


def oracle(body: str) -> str:
    """``body`` with the tables that it names."""
    used = [n for n in SQL if re.search(rf"\b(?:FROM|JOIN) \(?{n}\b", body)]
    return f"{closure(*used)} {body}" if used else body
