"""Days against periods."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_DAY, LAST_DAY = date(1925, 1, 1), date(2025, 12, 31)


def matches(op: str, start: date, end: date, day: Column) -> Column:
    """Whether a day fits the predicate over start..end; days outside the bounds never do."""
    a, z = F.lit(start), F.lit(end)
    test = {
        "EQUAL": day.between(a, z),
        "INTERSECT": day.between(a, z),
        "CONTAINS": day.between(a, z),
        "CONTAINED_BY": (day == a) & (day == z),
        "BEFORE": day < a,
        "AFTER": day > a,
        "BEFORE_EQUAL": day <= z,
        "AFTER_EQUAL": day >= a,
    }[op]
    return test & day.between(F.lit(FIRST_DAY), F.lit(LAST_DAY))


def common(a: tuple[date, date], b: tuple[date, date]) -> tuple[date, date] | None:
    """The days that two periods share."""
    start, end = max(a[0], b[0]), min(a[1], b[1])
    return (start, end) if start <= end else None


def shared_period(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return F.greatest(a[0], b[0]), F.least(a[1], b[1])


def period_text(start: date, end: date) -> str:
    """A year, a month, a day or a run of years where the period is one; [start, end] otherwise."""
    if (start.month, start.day, end.month, end.day) == (1, 1, 12, 31):
        return str(start.year) if start.year == end.year else f"[{start.year}, {end.year}]"
    if start == end:
        return start.isoformat()
    if start.day == 1 and (start.year, start.month) == (end.year, end.month) and (end + timedelta(1)).day == 1:
        return f"{start.year:04d}-{start.month:02d}"
    return f"[{start.isoformat()}, {end.isoformat()}]"


def day_of_number(number: Column) -> Column:
    """yyyymmdd to a day; null if there is no such day."""
    return F.try_to_date(number.cast("string"), "yyyyMMdd")


def period_end(day: Column, unit: str) -> Column:
    return F.make_date(F.year(day), F.lit(12), F.lit(31)) if unit == "year" else F.last_day(day) if unit == "month" else day
