"""Signal quality: buckets by depth, rank IC, precision, average precision and AUC, class balance, audits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.windows import pct_rank_avg
from ..sources.stored import stored
from .stats import hac_mean


def rank_within_date(df: DataFrame, score: str = "prob", ascending: bool = False) -> DataFrame:
    key = F.asc(score) if ascending else F.desc(score)
    return df.withColumn("rk", F.row_number().over(Window.partitionBy("date").orderBy(key, "ticker")))


def bucket_returns(df: DataFrame, buckets: list[int], bottom: bool = False, score: str = "prob", fwd: str = "fwd_ret") -> DataFrame:
    """date, bucket, ret, excess: mean forward return of the top (bottom) k and its difference to all names' mean."""
    known = df.where(F.col(fwd).isNotNull() & F.col(score).isNotNull())
    ranked = rank_within_date(known, score, bottom).withColumn("universe", F.avg(fwd).over(Window.partitionBy("date")))
    sizes = F.filter(F.array(*map(F.lit, sorted(buckets))), lambda k: k >= F.col("rk"))
    return ranked.withColumn("bucket", F.explode(sizes)).groupBy("date", "bucket").agg(F.avg(fwd).alias("ret"), (F.avg(fwd) - F.first("universe")).alias("excess"))


def depth_table(df: DataFrame, buckets: list[int], horizon: int, score: str = "prob", fwd: str = "fwd_ret") -> DataFrame:
    """label, n_names, mean_ret, mean_excess, t_stat (HAC, overlap = horizon), days: the top buckets, the bottom one of the
    largest size, and the universe. Names are ranked once from both ends."""
    known, date, most = df.where(F.col(fwd).isNotNull() & F.col(score).isNotNull()), Window.partitionBy("date"), max(buckets)
    low = F.row_number().over(date.orderBy(F.asc(score), "ticker"))
    ranked = rank_within_date(known, score).withColumns({"_low": low, "_u": F.avg(fwd).over(date)})
    tops = F.filter(F.array(*map(F.lit, sorted(buckets))), lambda k: k >= F.col("rk"))
    sizes = F.concat(tops, F.when(F.col("_low") <= most, F.array(F.lit(-most))).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)))  # 0 stands for all names
    daily = ranked.select("date", fwd, "_u", F.explode(sizes).alias("bucket")).groupBy("date", "bucket").agg(F.avg(fwd).alias("ret"), (F.avg(fwd) - F.first("_u")).alias("excess"), F.count("*").alias("_n"))
    means = daily.groupBy("bucket").agg(F.avg("ret").alias("mean_ret"), F.floor(F.avg("_n")).alias("_size"))
    rows, k = hac_mean(daily, "excess", ["bucket"], overlap=horizon).join(means, "bucket"), F.col("bucket")
    label = F.when(k == 0, "universe").when(k < 0, F.concat(F.lit("bottom "), (-k).cast("string"))).otherwise(F.concat(F.lit("top "), k.cast("string")))
    return rows.select(label.alias("label"), F.when(k == 0, F.col("_size")).otherwise(F.abs(k)).alias("n_names"), "mean_ret", F.when(k == 0, 0.0).otherwise(F.col("mean")).alias("mean_excess"), F.when(k != 0, F.col("t_stat")).alias("t_stat"), F.col("n").alias("days"))


def daily_rank_ic(df: DataFrame, score: str = "prob", fwd: str = "fwd_ret") -> DataFrame:
    """date, ic: Spearman correlation over rows that have both values."""
    both = df.where(F.col(score).isNotNull() & F.col(fwd).isNotNull())
    ranks = both.select("date", pct_rank_avg(F.col(score), "date").alias("a"), pct_rank_avg(F.col(fwd), "date").alias("b"))
    moments = ranks.groupBy("date").agg(F.covar_pop("a", "b").alias("c"), F.stddev_pop("a").alias("x"), F.stddev_pop("b").alias("y"))
    return moments.select("date", F.when((F.col("x") > 1e-12) & (F.col("y") > 1e-12), F.col("c") / F.col("x") / F.col("y")).alias("ic")).where("ic is not null")


def rank_ic(df: DataFrame, horizon: int) -> DataFrame:
    ic = daily_rank_ic(df)
    return hac_mean(ic, "ic", [], overlap=horizon)


def top_n_excess(df: DataFrame, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the per-date excess of the top n, and that over its deviation, of each key; a date of n names or fewer counts as 0."""
    size = Window.partitionBy(*keys, "date")
    daily = df.where("fwd_ret is not null and prob is not null").withColumns({"rk": F.row_number().over(size.orderBy(F.desc("prob"), "ticker")), "n": F.count("*").over(size), "u": F.avg("fwd_ret").over(size)})
    daily = daily.groupBy(*keys, "date").agg(F.when(F.first("n") > n, F.avg(F.when(F.col("rk") <= n, F.col("fwd_ret"))) - F.first("u")).otherwise(0.0).alias("x"))
    return daily.groupBy(*keys).agg(F.avg("x").alias("mean_excess"), F.coalesce(F.try_divide(F.avg("x"), F.stddev_samp("x")), F.lit(0.0)).alias("information_ratio"))


def ndcg(df: DataFrame, n: int, keys: tuple[str, ...] = (), grade: str = "grade") -> DataFrame:
    """Mean over dates of the discounted gain of the top n scores over that of the n best grades; a date without any gain counts as 1."""
    day, gain = [*keys, "date"], F.pow(F.lit(2.0), F.col(grade)) - 1
    known = df.where(F.col(grade).isNotNull() & F.col("prob").isNotNull())
    top = known.withColumn("_place", F.row_number().over(Window.partitionBy(*day).orderBy(F.desc("prob"), "ticker"))).where(F.col("_place") <= n)
    got = top.groupBy(*day).agg(F.sum(gain / F.log2(F.col("_place") + 1)).alias("_got"))
    # of the grades only their numbers count: each takes the places after those of the better ones
    upto = F.least(F.sum("_n").over(Window.partitionBy(*day).orderBy(F.desc(grade))), F.lit(n))
    grades = known.groupBy(*day, grade).agg(F.count("*").alias("_n")).withColumn("_upto", upto)
    discounts = F.array(F.lit(0.0), *(F.lit(sum(1 / math.log2(k + 2) for k in range(m))) for m in range(1, n + 1)))
    share = F.get(discounts, F.col("_upto").cast("int")) - F.get(discounts, F.col("_before").cast("int"))
    before = F.lag("_upto", 1, 0).over(Window.partitionBy(*day).orderBy(F.desc(grade)))
    best = grades.withColumn("_before", before).groupBy(*day).agg(F.sum(gain * share).alias("_best"))
    sums = best.join(got, day)
    return sums.groupBy(*keys).agg(F.avg(F.when(F.col("_best") > 0, F.col("_got") / F.col("_best")).otherwise(1.0)).alias("ndcg"))


def average_precision(df: DataFrame, keys: tuple[str, ...] = (), target: str = "target") -> DataFrame:
    """Average precision of each key, a step for each distinct score. Sums run within bands of scores, then over the bands,
    so that no task holds all scores of a key; scores are probabilities."""
    known = df.where(F.col(target).isNotNull() & F.col("prob").isNotNull())
    steps = known.groupBy(*keys, F.floor(F.col("prob") * 1000).alias("_band"), "prob").agg(F.sum(target).alias("pos"), F.count("*").alias("n"))
    down = Window.partitionBy(*keys).orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = steps.groupBy(*keys, "_band").agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    bands = bands.select(*keys, "_band", *(F.coalesce(F.sum(c).over(down), F.lit(0)).alias(c + "_above") for c in ("_p", "_n")))
    inside = Window.partitionBy(*keys, "_band").orderBy(F.desc("prob"))
    steps = steps.withColumns({"tp": F.sum("pos").over(inside), "seen": F.sum("n").over(inside)}).join(bands, [*keys, "_band"])
    precision = (F.col("tp") + F.col("_p_above")) / (F.col("seen") + F.col("_n_above"))
    return steps.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("pr_auc"))


def weekly_precision(df: DataFrame, k: int, target: str = "target") -> DataFrame:
    """week (Monday), precision of its k highest scores; weeks with fewer rows have none."""
    known = df.where(F.col(target).isNotNull() & F.col("prob").isNotNull()).withColumn("week", F.date_trunc("week", "date").cast("date"))
    ranked = known.withColumn("rk", F.row_number().over(Window.partitionBy("week").orderBy(F.desc("prob"), "ticker", "date")))
    return ranked.where(F.col("rk") <= k).groupBy("week").agg(F.avg(target).alias("precision"), F.count("*").alias("n")).where(F.col("n") >= k).select("week", "precision")


def monthly_ap_auc(df: DataFrame, target: str = "target") -> DataFrame:
    """month, average precision (steps over distinct scores) and ROC-AUC (average ranks)."""
    known = df.where(F.col(target).isNotNull() & F.col("prob").isNotNull()).withColumn("month", F.trunc("date", "month"))
    steps = known.groupBy("month", "prob").agg(F.sum(target).alias("pos"), F.count("*").alias("n"))
    down, whole = Window.partitionBy("month").orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("month")
    steps = steps.withColumns({"tp": F.sum("pos").over(down), "seen": F.sum("n").over(down), "p": F.sum("pos").over(whole), "all": F.sum("n").over(whole)})
    below = F.col("all") - F.col("seen")  # rows with a lower score
    neg_below = below - (F.col("p") - F.col("tp"))
    wins = F.col("pos") * (neg_below + (F.col("n") - F.col("pos")) / 2)
    out = steps.groupBy("month").agg(F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("s"), F.first("p").alias("p"), F.first("all").alias("all"), F.sum(wins).alias("w"))
    return out.select("month", F.try_divide("s", "p").alias("average_precision"), F.try_divide("w", F.col("p") * (F.col("all") - F.col("p"))).alias("auc"))


def overall_precision(df: DataFrame, k: int, target: str = "target") -> DataFrame:
    """precision (mean over the weeks that have k rows), weeks."""
    return weekly_precision(df, k, target).agg(F.avg("precision").alias("precision"), F.count("*").alias("weeks"))


def overall_ap_auc(df: DataFrame, target: str = "target") -> DataFrame:
    """n, base_rate, average_precision (a step for each distinct score), auc of all rows.

    Scores of any scale are dealt to ranges; sums run within a range, and each range starts from the sums of the ranges above
    it (a row a range), so that no task sorts all scores.
    """
    known = df.where(F.col(target).isNotNull() & F.col("prob").isNotNull())
    steps = known.groupBy("prob").agg(F.sum(target).alias("pos"), F.count("*").alias("n"))
    steps = stored(steps.repartitionByRange(F.desc("prob")).withColumn("part", F.spark_partition_id()))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = steps.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("pos").over(above), F.lit(0.0)).alias("_p"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_n"))
    whole = steps.agg(F.sum("pos").alias("p"), F.sum("n").alias("all"))
    inside = Window.partitionBy("part").orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.join(F.broadcast(parts), "part").join(F.broadcast(whole)).withColumns({"tp": F.sum("pos").over(inside) + F.col("_p"), "seen": F.sum("n").over(inside) + F.col("_n")})
    lost = F.col("all") - F.col("seen") - (F.col("p") - F.col("tp"))  # negative rows with a lower score
    out = rows.agg(F.max("all").alias("n"), F.max("p").alias("p"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("s"), F.sum(F.col("pos") * (lost + (F.col("n") - F.col("pos")) / 2)).alias("w"))
    return out.select("n", F.try_divide("p", "n").alias("base_rate"), F.try_divide("s", "p").alias("average_precision"), F.try_divide("w", F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def class_balance(df: DataFrame, target: str = "target") -> DataFrame:
    return df.agg(F.count_if(F.col(target) == 0).alias("n_neg"), F.count_if(F.col(target) == 1).alias("n_pos")).withColumn("weight", F.try_divide("n_neg", "n_pos"))


def flagged_excess(df: DataFrame, flag: str, horizon: int, least_dates: int = 10) -> DataFrame:
    """Forward return of flagged rows over their own date's mean: mean, HAC t, dates, names a date."""
    daily = df.where("fwd_ret is not null").groupBy("date").agg(
        (F.avg(F.when(F.col(flag), F.col("fwd_ret"))) - F.avg("fwd_ret")).alias("excess"), F.count_if(F.col(flag)).alias("names")).where("names > 0")
    return hac_mean(daily, "excess", [], overlap=horizon).join(daily.agg(F.avg("names").alias("avg_names"))).where(F.col("n") >= least_dates)


def insider_daily(filings: DataFrame) -> DataFrame:
    """ticker, date: value bought, distinct buyers, purchases not planned."""
    return filings.groupBy("ticker", "date").agg(F.sum("value").alias("value"), F.count_distinct("owner").alias("buyers"), F.count_if(~F.col("planned")).alias("unplanned"))


def trailing_sum(panel: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """Sum over the last n rows of the ticker; missing values count as 0."""
    return panel.withColumn(out, F.sum(F.coalesce(F.col(column), F.lit(0.0))).over(Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - n, 0)))
