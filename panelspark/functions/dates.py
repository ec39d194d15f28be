"""Calendar keys and ranges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_STEP = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}


def week_monday(day: Column, mode: str = "monday") -> Column:
    """Monday starting the week; ``w_mon`` gives the Monday that ends a Tuesday-to-Monday week."""
    if mode == "w_mon":
        return F.to_date(F.date_trunc("week", F.date_add(F.to_date(day), 6)))
    return F.to_date(F.date_trunc("week", day))


def first_on_or_after(day: Column, weekday: str) -> Column:
    """``day`` itself if it falls on ``weekday`` ('Mon', 'Sun', ...), else the next such day."""
    return F.next_day(F.date_sub(day, 1), weekday)


def calendar(start: Column, end: Column, step: str) -> Column:
    """Array of dates from start to end."""
    return F.sequence(start, end, F.expr(_STEP[step]))


def month_index(day: Column, base_year: int = 2020) -> Column:
    return (F.year(day) - F.lit(base_year)) * 12 + F.month(day) - 1
