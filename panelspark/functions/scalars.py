"""Scalar expressions: safe ratios, fills, ids, calendar parts, step schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def safe_ratio(num: Column, den: Column, positive: bool = False) -> Column:
    """num / den; null where the denominator is tiny, or not positive if asked for."""
    return F.when(den > 1e-9 if positive else F.abs(den) > 1e-9, num / den)


def normalise_ticker(x: Column) -> Column:
    return F.translate(F.upper(F.trim(x)), ".", "-")


def fill_price(price: Column, side: Column, slippage: float) -> Column:
    """Price paid or received: buys (side > 0) pay the slippage, sells lose it."""
    return price * (1 + F.signum(side) * slippage)


def commission(shares: Column, per_share: float, per_order: float) -> Column:
    return F.abs(shares) * per_share + per_order


def daily_rate(annual: Column) -> Column:
    """Daily rate that compounds to an annual one over 252 sessions."""
    return F.pow(1 + annual, F.lit(1 / 252)) - 1


def exposure_scale(pct: Column) -> Column:
    """Share of the capital to use: whole up to the middle of a risk percentile (0 to 1), none at its top; whole if it is unknown."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * (1 - pct)))
    return F.when(pct.isNotNull() & ~F.isnan(pct), share).otherwise(1.0)


def decision_id(date: Column, names: Column, salt: str = "") -> Column:
    """Eight hex digits that name a basket: its date, a salt and its sorted names."""
    return F.substring(F.sha2(F.concat_ws("|", date.cast("string"), F.lit(salt), F.array_join(F.array_sort(names), "|")), 256), 1, 8)


def mark_price(quote: Column, seen: Column, entry: Column) -> Column:
    return F.coalesce(F.when(quote > 0, quote), F.when(seen > 0, seen), entry)


def step_schedule(pct: Column, steps: list[tuple[float, float]]) -> Column:
    """Rate of the first step whose bound is not below the percentile; bounds ascend. An unknown one takes the first rate."""
    out = F.lit(steps[-1][1])
    for bound, rate in reversed(steps[:-1]):
        out = F.when(pct <= bound, F.lit(rate)).otherwise(out)
    return F.coalesce(F.when(pct.isNotNull(), out), F.lit(steps[0][1]))


def calendar_parts(date: Column) -> dict[str, Column]:
    """Month on a circle, quarter-end month, days to the calendar quarter's end."""
    month = F.month(date)
    quarter_end = F.last_day(F.make_date(F.year(date), (3 * F.ceil(month / 3)).cast("int"), F.lit(1)))
    return {
        "month_sin": F.sin(2 * math.pi * (month - 1) / 12), "month_cos": F.cos(2 * math.pi * (month - 1) / 12),
        "quarter_end_month": (month % 3 == 0).cast("int"), "days_to_quarter_end": F.datediff(quarter_end, date)}
