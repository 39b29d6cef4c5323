"""Window helpers: rolling aggregates that need a full window, average-tie percent ranks, fills."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def over_time(key: str = "ticker", date: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(date)


def rolling(agg: Callable[[Column], Column], x: Column, n: int, key: str = "ticker", date: str = "date", least: int | None = None) -> Column:
    """``agg`` over the last ``n`` rows of a key; null unless ``least`` (all, by default) of them hold a value."""
    frame = over_time(key, date).rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), agg(x).over(frame))


def rolling_max(df: DataFrame, x: Column, out: dict[str, int], key: str = "ticker", date: str = "date") -> DataFrame:
    """``df`` with the maxima of the last rows of a key, as ``rolling`` gives them, of several lengths at once.

    A sliding frame goes through all its rows for each row. So maxima of ``n`` rows are those of short frames that lie end to end:
    the frames' length is the largest that divides all of ``n`` and is at most 21, and a row looks at n / length of them.
    """
    step = next(k for k in range(21, 0, -1) if all(n % k == 0 for n in out.values()))
    frame, time = over_time(key, date).rowsBetween(1 - step, 0), over_time(key, date)
    df = df.withColumns({"_max": F.max(x).over(frame), "_known": F.count(x).over(frame)})

    def parts(column: str, n: int) -> list[Column]:
        return [F.col(column), *(F.lag(column, i).over(time) for i in range(step, n, step))]

    def whole(n: int) -> Column:
        known, tops = functools.reduce(Column.__add__, (F.coalesce(c, F.lit(0)) for c in parts("_known", n))), parts("_max", n)
        return F.when(known >= n, F.greatest(*tops) if len(tops) > 1 else tops[0])

    return df.withColumns({name: whole(n) for name, n in out.items()}).drop("_max", "_known")


def lag(x: Column, n: int, key: str = "ticker", date: str = "date") -> Column:
    return F.lag(x, n).over(over_time(key, date))


def ratio_change(x: Column, n: int) -> Column:
    """x over its value n rows before, less one; null where that is null or zero."""
    return F.try_divide(x, lag(x, n)) - 1


def pct_rank_avg(x: Column, *keys: str) -> Column:
    """Percent rank within the keys; ties share their average rank, nulls have none and do not count."""
    group = Window.partitionBy(*keys)  # one shuffle for any number of columns
    order = group.orderBy(x.asc_nulls_last())  # and one ordering for each: ties are the rows of the same place in it
    known, up, ties = F.count(x).over(group), F.rank().over(order), F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (2 * up + ties - 1) / 2 / known)


def last_known(x: Column, *keys: str, order: str = "date") -> Column:
    return F.last(x, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def next_known(x: Column, *keys: str, order: str = "date") -> Column:
    return F.first(x, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing))
