"""Selection of names on each date: eligibility, targets and weights, books, exits, samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F


@dataclass(frozen=True)
class SelectionRules:
    top_n: int = 5
    rank_offset: int = 0
    min_cross_section: int = 1
    min_score: float | None = None
    probability_weighted: bool = False

    def __post_init__(self):
        if self.top_n < 1 or self.rank_offset < 0:
            raise ValueError("top_n must be positive and rank_offset must not be negative")


def eligible(scored: DataFrame, rules: SelectionRules, *keys: str) -> DataFrame:
    """Candidates with their rank ``rk`` (from 1, after the offset). The floor on a date counts its raw rows."""
    day = Window.partitionBy("date", *keys)
    df = scored.withColumn("_n", F.count(F.lit(1)).over(day)).where(F.col("_n") >= rules.min_cross_section).drop("_n")
    if rules.min_score is not None:
        df = df.where(F.col("prob") >= rules.min_score)
    df = df.where((F.col("adj_close") > 0) & F.col("prob").isNotNull())
    return df.withColumn("rk", F.row_number().over(day.orderBy(F.desc("prob"), "ticker")) - rules.rank_offset).where("rk > 0")


def targets(scored: DataFrame, rules: SelectionRules, *keys: str) -> DataFrame:
    """The top n with weights that sum to 1: equal, or by score (equal where scores sum to nothing)."""
    df = eligible(scored, rules, *keys).where(F.col("rk") <= rules.top_n)
    return weigh(df, rules.probability_weighted, "date", *keys)


def weigh(df: DataFrame, by_score: bool, *keys: str) -> DataFrame:
    day = Window.partitionBy(*keys)
    equal = 1 / F.count(F.lit(1)).over(day)
    total = F.sum("prob").over(day)
    return df.withColumn("weight", F.when(total > 0, F.col("prob") / total).otherwise(equal) if by_score else equal)


def full_ranking(scored: DataFrame) -> DataFrame:
    """Ranking of the newest date."""
    last = scored.agg(F.max("date").alias("date"))
    return scored.join(F.broadcast(last), "date", "left_semi").withColumn("rk", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("prob"), "ticker")))


def decile_book(scored: DataFrame, share: float, min_side: int = 1) -> DataFrame:
    """date, ticker, weight: the best floor(n * share) names long, the worst short, each side summing to 1 in size.

    A name is once in a date, so its place from below follows from that from above: one ordering serves both sides."""
    day = Window.partitionBy("date")
    df = scored.where((F.col("adj_close") > 0) & F.col("prob").isNotNull()).withColumn("hi", F.row_number().over(day.orderBy(F.desc("prob"), "ticker"))).withColumn("_n", F.count(F.lit(1)).over(day))
    df = df.withColumns({"k": F.floor(F.col("_n") * share), "lo": F.col("_n") + 1 - F.col("hi")})
    side = F.when(F.col("hi") <= F.col("k"), 1 / F.col("k")).otherwise(0) - F.when(F.col("lo") <= F.col("k"), 1 / F.col("k")).otherwise(0)
    return df.where(F.col("k") >= min_side).where((F.col("hi") <= F.col("k")) | (F.col("lo") <= F.col("k"))).select("date", "ticker", "adj_close", side.alias("weight"))


def top_picks(scored: DataFrame, date, n: int, columns: list[str]) -> DataFrame:
    """ticker, prob and ``columns`` of the n best names of a date, given as a value or as a one-row frame."""
    of_date = scored.join(F.broadcast(date), "date", "left_semi") if isinstance(date, DataFrame) else scored.where(F.col("date") == date)
    return of_date.orderBy(F.desc("prob"), "ticker").limit(n).select("ticker", "prob", *columns)


def rank_exits(held: DataFrame, ranking: DataFrame, exit_rank: int) -> DataFrame:
    """Held names that rank beyond ``exit_rank`` or are not ranked at all."""
    return held.join(ranking.select("ticker", "rk"), "ticker", "left").where(F.col("rk").isNull() | (F.col("rk") > exit_rank))


def best_configs(results: DataFrame, least_cohorts: int, n: int = 10) -> DataFrame:
    order = (F.desc_nulls_last("sharpe"), F.desc_nulls_last("sortino"), F.asc("config_id"))
    best = results.where(F.col("n_cohorts") >= least_cohorts).orderBy(*order).limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a row for each configuration


def seeded_sample(tickers: DataFrame, n: int, seed: int) -> DataFrame:
    """n tickers without replacement, by the order of a seeded hash."""
    return tickers.select("ticker").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("ticker").cast("string")))).limit(n)
