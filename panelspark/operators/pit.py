"""Point-in-time joins: interval membership and as-of joins by union and last known value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def members_at(panel: DataFrame, stints: DataFrame) -> DataFrame:
    """Rows whose date lies in a stint [start, end) of their ticker; an open stint has no end. Each row once."""
    s = stints.select(F.col("ticker").alias("_t"), "start_date", "end_date")
    inside = (F.col("ticker") == F.col("_t")) & (F.col("date") >= F.col("start_date")) & (F.col("end_date").isNull() | (F.col("date") < F.col("end_date")))
    return panel.join(s, inside, "left_semi")


def tickers_overlapping(stints: DataFrame, start, end) -> DataFrame:
    """Tickers with a stint that starts on or before ``end`` and ends after ``start``."""
    return stints.where((F.col("start_date") <= end) & (F.col("end_date").isNull() | (F.col("end_date") > start))).select("ticker").distinct()


def current_members(stints: DataFrame) -> DataFrame:
    return stints.where(F.col("end_date").isNull()).select("ticker").distinct()


def asof_backward(left: DataFrame, right: DataFrame, values: list[str], left_on: str = "date", right_on: str = "date", key: str = "ticker") -> DataFrame:
    """``left`` with the last known ``values`` of ``right`` at or before each row's date.

    ``right`` has one row for each key and date at most. One shuffle by key, whatever the number of values;
    no pairs are made.
    """
    types = dict(right.dtypes)
    names = left.columns
    a = left.select("*", F.col(left_on).alias("_at"), F.lit(1).alias("_left"), *(F.lit(None).cast(types[v]).alias(f"_{v}") for v in values))
    b = right.select(key, F.col(right_on).alias("_at"), F.lit(0).alias("_left"), *(F.col(v).alias(f"_{v}") for v in values))
    w = Window.partitionBy(key).orderBy("_at", "_left").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.select("*", *(F.last(f"_{v}", ignorenulls=True).over(w).alias(v) for v in values)).where("_left = 1").select(*names, *values)


def days_since(panel: DataFrame, events: DataFrame, event_date: str, out: str) -> DataFrame:
    """Days since the last event of the ticker; null before the first."""
    last = events.select("ticker", event_date).distinct().withColumn("_event", F.col(event_date))
    return asof_backward(panel, last, ["_event"], right_on=event_date).withColumn(out, F.datediff("date", "_event")).drop("_event")


def days_to_next(dates: DataFrame, events: DataFrame, event_date: str, cap: int) -> DataFrame:
    """For each date the days to the next event on or after it, ``cap`` at most and past the last event.

    Dates and events are calendars, so a union and one ordering of both suffice.
    """
    both = dates.select("date", F.lit(None).cast("date").alias("_e"), F.lit(True).alias("_keep")).unionByName(events.select(F.col(event_date).alias("date"), F.col(event_date).alias("_e"), F.lit(False).alias("_keep")))
    ahead = F.first("_e", ignorenulls=True).over(Window.orderBy("date", F.col("_e").isNull().cast("int").desc()).rowsBetween(0, Window.unboundedFollowing))
    return both.select("date", "_keep", ahead.alias("_next")).where("_keep").select("date", F.least(F.lit(cap), F.coalesce(F.datediff("_next", "date"), F.lit(cap))).alias("days_to_event"))


def next_session(rows: DataFrame, sessions: DataFrame, date: str, strict: bool = False) -> DataFrame:
    """``rows`` with the session on or after (strictly after) their date; rows past the last session drop.

    Each distinct date is mapped to its session over the calendar, then rows are joined by equality.
    """
    day = F.date_add(F.col(date), 1) if strict else F.col(date)
    days = rows.select(day.alias("_day")).distinct().select("_day", F.lit(None).cast("date").alias("session"))
    both = days.unionByName(sessions.select(F.col("date").alias("_day"), F.col("date").alias("session")))
    ahead = F.first("session", ignorenulls=True).over(Window.orderBy("_day").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    mapped = both.select("_day", ahead.alias("session")).where("session is not null").distinct()
    return rows.withColumn("_day", day).join(mapped, "_day").drop("_day")


def shift_sessions(rows: DataFrame, sessions: DataFrame, n: int, out: str, date: str = "date") -> DataFrame:
    """The session ``n`` sessions after each row's session; null past the end."""
    a = sessions.select(F.col("date").alias("_d"), "session_no")
    b = sessions.select((F.col("session_no") - n).alias("_no"), F.col("date").alias(out))
    return rows.join(a, F.col(date) == F.col("_d")).join(b, F.col("session_no") == F.col("_no"), "left").drop("_d", "_no", "session_no")


def sessions_of(bars: DataFrame) -> DataFrame:
    """date, session_no (from 1) of all dates with a bar."""
    return bars.select("date").distinct().withColumn("session_no", F.row_number().over(Window.orderBy("date")))


def extend_sessions(sessions: DataFrame, calendar: DataFrame, n: int, as_of) -> DataFrame:
    """Known sessions and the next ``n`` of a supplied calendar after both the last known one and ``as_of``'s gap."""
    last = sessions.agg(F.max("date").alias("_last"))
    ahead = calendar.join(F.broadcast(last), F.col("date") > F.col("_last")).select("date")
    gap = ahead.where(F.col("date") <= as_of)
    more = ahead.where(F.col("date") > as_of).orderBy("date").limit(n)
    both = sessions.select("date").unionByName(gap).unionByName(more).distinct()
    return both.withColumn("session_no", F.row_number().over(Window.orderBy("date")))


def rebalance_dates(sessions: DataFrame, weekday: int | None = None) -> DataFrame:
    """One session of each ISO week: the first on the weekday (1 = Monday), or the last of the week."""
    week = sessions.groupBy(F.extract(F.lit("YEAROFWEEK"), F.col("date")).alias("y"), F.weekofyear("date").alias("w"))
    pick: Column = F.max("date") if weekday is None else F.min(F.when(F.weekday("date") + 1 == weekday, F.col("date")))
    return week.agg(pick.alias("date")).where("date is not null").select("date")


def every_kth(sessions: DataFrame, k: int) -> DataFrame:
    """Signal sessions, every k-th from the first, with the next session as fill date."""
    w = Window.orderBy("session_no")
    return sessions.withColumn("fill_date", F.lead("date").over(w)).where((F.col("session_no") - 1) % k == 0).select("date", "session_no", "fill_date")
