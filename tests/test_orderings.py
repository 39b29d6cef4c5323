"""Ranks by one ordering, maxima of long frames from short ones, and stages that the JVM compiles."""

import datetime as dt
import random

from pyspark.sql import Window, functions as F

from panelspark.functions.windows import pct_rank_avg, rolling, rolling_max
from panelspark.plans.base import Tables
from panelspark.plans.join_queries import whole_panel
from panelspark.sources.stored import stored


def table(spark):
    rng = random.Random(1)

    def value(t):
        return None if t == 2 and rng.random() < 0.01 else float("nan") if t == 3 and rng.random() < 0.01 else round(rng.gauss(0, 1), 1)

    rows = [(dt.date(2000, 1, 1) + dt.timedelta(days=i), t, value(t)) for t in range(1, 5) for i in range(300)]
    return spark.createDataFrame(rows, "date date, ticker long, x double")


def test_maxima_of_long_frames_equal_those_of_sliding_ones(spark):
    df = table(spark)
    for lengths in ({"a": 252, "b": 63}, {"a": 12}, {"a": 23, "b": 7}):
        want = df.withColumns({name: rolling(F.max, F.col("x"), n) for name, n in lengths.items()})
        got = rolling_max(df, F.col("x"), lengths)
        assert got.columns == want.columns and got.count() == want.count()
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
        assert got.where("a is not null").count() > 100


def test_a_percent_rank_takes_one_ordering(spark):
    df, x = table(spark).withColumn("month", F.trunc("date", "month")), F.col("x")
    by = Window.partitionBy("month")
    up, down, known = F.rank().over(by.orderBy(x.asc_nulls_last())), F.rank().over(by.orderBy(x.desc_nulls_last())), F.count(x).over(by)
    want, got = df.withColumn("p", F.when(x.isNotNull(), (up + known + 1 - down) / 2 / known)), df.withColumn("p", pct_rank_avg(x, "month"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def test_wide_stages_stay_within_what_the_jvm_compiles(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    whole_panel(*(stored(df) for df in (t.bars, t.stints, t.sectors, t.macro, t.sql("filings"), t.sql("earnings"))))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
