"""Filings: extraction from nested facts, restatement-safe dedupe, derived quarters, trailing sums, ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import safe_ratio
from ..functions.windows import over_time
from .pit import asof_backward

#: Concepts that are sums over a period; the others are balances.
FLOWS = ("revenue", "net_income", "gross_profit", "cost_of_revenue", "operating_income", "cash_ops", "capex", "eps_diluted")
#: What a panel needs for ``ratios``, beside its price.
RATIO_INPUTS = ("revenue", "net_income", "equity", "assets", "gross_profit", "cost_of_revenue", "operating_income", "liabilities", "cash_ops", "capex", "shares_diluted", "eps_diluted")

FACTS_JSON = "facts struct<`us-gaap`: map<string, struct<units: map<string, array<struct<start:date, `end`:date, val:double, filed:date, form:string, fy:int, fp:string>>>>>>"


def extract_concepts(raw: DataFrame, tags: DataFrame, forms=("10-K", "10-Q")) -> DataFrame:
    """Long facts from (ticker, json): annual and quarterly forms; for a concept the first tag that yields data wins.

    ``tags`` has concept, tag, priority (1 first) and is a small dimension.
    """
    parsed = raw.select("ticker", F.from_json("json", FACTS_JSON)["facts"]["us-gaap"].alias("m"))
    obs = parsed.select("ticker", F.explode("m").alias("tag", "u")).select("ticker", "tag", F.explode("u.units").alias("unit", "obs")).select("ticker", "tag", F.inline("obs"))
    rows = obs.where(F.col("form").isin(*forms) & F.col("val").isNotNull()).join(tags, "tag")
    best = F.dense_rank().over(Window.partitionBy("ticker", "concept").orderBy("priority"))
    return rows.withColumn("_r", best).where("_r = 1").select("ticker", "concept", F.col("start").alias("period_start"), F.col("end").alias("period_end"), "filed", F.col("val").alias("value"), "form", "fy", "fp")


def dedupe_filings(facts: DataFrame) -> DataFrame:
    """One row for each (ticker, concept, period_end, filed): the latest period_start, then the larger value."""
    w = Window.partitionBy("ticker", "concept", "period_end", "filed").orderBy(F.desc_nulls_last("period_start"), F.desc("value"))
    return facts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def derive_q4(quarters: DataFrame, annuals: DataFrame) -> DataFrame:
    """Fourth quarter as the year less its three quarters, known when the annual filing is."""
    three = quarters.where(F.col("fp").isin("Q1", "Q2", "Q3")).groupBy("ticker", "concept", "fy").agg(F.count_distinct("fp").alias("n"), F.sum("value").alias("s"), F.max("period_end").alias("q3_end")).where("n = 3")
    return annuals.join(three, ["ticker", "concept", "fy"]).select("ticker", "concept", "fy", F.lit("Q4").alias("fp"), F.date_add("q3_end", 1).alias("period_start"), "period_end", "filed", (F.col("value") - F.col("s")).alias("value"))


def vintages(facts: DataFrame, flows: list[str]) -> DataFrame:
    """Flows: the earliest filing of each period. Balances: every vintage."""
    r = F.row_number().over(Window.partitionBy("ticker", "concept", "period_end").orderBy("filed", F.desc("value")))
    return facts.withColumn("_r", r).where(~F.col("concept").isin(*flows) | (F.col("_r") == 1)).drop("_r")


def trailing_year(facts: DataFrame, flows: tuple[str, ...] | None = None) -> DataFrame:
    """Twelve-month sums of flows: four successive known quarters (spans of 80 to 100 days), known when the last of the four is
    filed; and annual rows (350 to 380 days), which are twelve months themselves. A fourth quarter that is not filed is the
    year less its first three quarters, known when the year is. Concepts beside ``flows`` (if given) are balances and stay as they are.

    One pass: the quarters of a year are summed beside its annual row, which gives out both itself and the missing quarter.
    All windows lie within a ticker, so facts that are dealt by ticker are not dealt again.
    """
    days, names = F.datediff("period_end", "period_start"), ["ticker", "concept", "kind", "period_end", "filed", "value"]
    balance = F.lit(False) if flows is None else ~F.col("concept").isin(*flows)
    rows = facts.withColumn("kind", F.when(balance, "balance").when(days.between(80, 100), "quarter").when(days.between(350, 380), "year")).where("kind is not null")
    year = Window.partitionBy("ticker", "concept", "fy")
    first_three = F.when((F.col("kind") == "quarter") & F.col("fp").isin("Q1", "Q2", "Q3"), F.struct("fp", "value"))
    rows = rows.withColumns({"_three": F.size(F.collect_set(first_three["fp"]).over(year)), "_sum": F.sum(first_three["value"]).over(year)})
    itself = F.struct("kind", "period_end", "filed", "value")
    fourth = F.struct(F.lit("quarter").alias("kind"), "period_end", "filed", (F.col("value") - F.col("_sum")).alias("value"))
    both = F.array_compact(F.array(itself, F.when((F.col("kind") == "year") & (F.col("_three") == 3), fourth)))
    rows = rows.select("ticker", "concept", F.inline(both)).select(*names)
    first = F.row_number().over(Window.partitionBy("ticker", "concept", "kind", "period_end").orderBy("filed", F.desc("value")))
    w = Window.partitionBy("ticker", "concept", "kind").orderBy("period_end").rowsBetween(-3, 0)
    annual = F.col("kind") != "quarter"
    rows = rows.withColumn("_r", first).where(annual | (F.col("_r") == 1)).withColumns({"_ttm": F.sum("value").over(w), "_filed": F.max("filed").over(w), "_n": F.count("*").over(w)})
    return rows.where(annual | (F.col("_n") == 4)).select("ticker", "concept", "period_end", F.when(annual, F.col("value")).otherwise(F.col("_ttm")).alias("ttm"), F.when(annual, F.col("filed")).otherwise(F.col("_filed")).alias("filed"))


def known_values(facts: DataFrame, flows: tuple[str, ...] = FLOWS) -> DataFrame:
    """ticker, concept, period_end, filed, value as a panel may know them: twelve-month sums of flows, every vintage of balances.
    Facts are dealt by ticker once."""
    kept = vintages(dedupe_filings(facts.repartition("ticker")), list(flows))
    return trailing_year(kept, flows).select("ticker", "concept", "period_end", "filed", F.col("ttm").alias("value"))


def asof_fundamentals(panel: DataFrame, facts: DataFrame, concepts: list[str]) -> DataFrame:
    """Panel with the last value of each concept known at its date; within a filing date the newest period wins."""
    wide = facts.groupBy("ticker", "filed").agg(*(F.max_by(F.when(F.col("concept") == c, F.col("value")), F.when(F.col("concept") == c, F.col("period_end"))).alias(c) for c in concepts))
    return asof_backward(panel, wide, concepts, right_on="filed")


def growth(panel: DataFrame, column: str, out: str, rows: int = 252) -> DataFrame:
    """Change over 252 panel rows against the size of the old value."""
    old = F.lag(column, rows).over(over_time())
    return panel.withColumn(out, safe_ratio(F.col(column) - old, F.abs(old)))


def ratios(panel: DataFrame, price: str = "adj_close", out: str = "fund_") -> DataFrame:
    """The eleven ratios of a panel with trailing sums and balances (``RATIO_INPUTS``; a missing column is unknown).

    Where a filing has no gross profit or no liabilities, revenue less its cost and assets less equity stand in. A company
    that owes more than it has gets no book value, one that reports no capital expenditure counts as having none, and growth
    compares with the value that was in force 252 rows before.
    """
    panel = panel.withColumns({c: F.lit(None).cast("double") for c in RATIO_INPUTS if c not in panel.columns})
    c = {name: F.col(name).cast("double") for name in RATIO_INPUTS}
    implied = c["assets"] - c["equity"]
    known = {
        "gross": F.coalesce(c["gross_profit"], c["revenue"] - c["cost_of_revenue"]), "owed": F.coalesce(c["liabilities"], F.when(implied >= 0, implied)),
        "free_cash": c["cash_ops"] - F.coalesce(c["capex"], F.lit(0.0))}
    a_share = lambda x: safe_ratio(safe_ratio(x, c["shares_diluted"], True), F.col(price), True)
    made = {
        "earnings_yield": a_share(c["net_income"]), "book_to_price": a_share(F.when(c["equity"] > 0, c["equity"])), "sales_to_price": a_share(c["revenue"]), "fcf_yield": a_share(known["free_cash"]),
        "roe": safe_ratio(c["net_income"], c["equity"], True), "gross_margin": safe_ratio(known["gross"], c["revenue"], True), "operating_margin": safe_ratio(c["operating_income"], c["revenue"], True),
        "debt_to_equity": safe_ratio(known["owed"], c["equity"], True), "accruals": safe_ratio(c["net_income"] - c["cash_ops"], c["assets"], True)}
    panel = panel.withColumns({out + name: x for name, x in made.items()})
    return growth(growth(panel, "revenue", out + "revenue_growth_yoy"), "eps_diluted", out + "eps_growth_yoy")
