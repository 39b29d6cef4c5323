"""A book of long and short legs is ranked once, for its dates and its legs."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark.operators import cash_path


def test_a_book_is_read_once_for_its_dates_and_legs(spark):
    seen = spark.sparkContext.accumulator(0)

    def weight(x):
        seen.add(1)
        return x

    days = [dt.date(2000, 1, 3) + dt.timedelta(days=i) for i in range(40)]
    prices = spark.createDataFrame([(d, t, 1.0 + t) for d in days for t in (1, 2)], "date date, ticker long, adj_close double")
    sessions = spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "date date, session_no int")
    book = prices.select("date", "ticker", F.udf(weight, "double")(F.when(F.col("ticker") == 1, 0.5).otherwise(-0.5)).alias("weight")).where("weight <> 0")
    made = cash_path.book_periods(book, prices, sessions, 21)
    assert made.count() == 4
    assert seen.value <= 2 * 2 * len(days)  # a row may be computed for the filter and for the column
