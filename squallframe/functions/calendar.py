"""Dates: parsing, imputation, padding and year expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date layouts met in the inputs, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def parse_time(text: Column, fmt: str = TIME_FORMAT) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt))


def parse_date(text: Column, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """First layout that fits, then a generic cast; NULL when none does."""
    trimmed = F.trim(text)
    tries = [F.try_to_timestamp(trimmed, F.lit(f)).cast("date") for f in formats]
    return F.coalesce(*tries, trimmed.try_cast("date"))


def epoch_hours(ts: Column) -> Column:
    """Hours since 1970-01-01 of a wall-clock time."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                              ts.cast("timestamp_ntz"))
    return micros / F.lit(3.6e9)


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def date_of(year: Column, month: Column, day: Column) -> Column:
    """Calendar date of its parts; impossible dates are NULL instead of failing the job."""
    first = F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))
    return F.when(day.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, (day - 1).cast("int")))


def imputed_start(year: Column, month: Column, day: Column) -> Column:
    return date_of(year, month, F.coalesce(day, F.lit(1)))


def imputed_end(year: Column, month: Column, day: Column) -> Column:
    return F.when(day.isNull(), F.last_day(date_of(year, month, F.lit(1)))).otherwise(date_of(year, month, day))


def overlap_days(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Inclusive day count of two intervals' overlap, 0 when they do not meet."""
    return F.greatest(F.datediff(F.least(a1, b1), F.greatest(a0, b0)) + 1, F.lit(0))


def parse_years(expr: str) -> list[int]:
    """``2013``, ``2000-2024`` or ``2001,2003``; a reversed range is an error."""
    text = expr.strip()
    if not text:
        raise ValueError("empty years expression")
    years: set[int] = set()
    for part in text.split(","):
        if not part.strip():
            continue
        bounds = [int(b) for b in part.split("-")]
        if len(bounds) > 2 or bounds[0] > bounds[-1]:
            raise ValueError(f"bad years expression: {expr!r}")
        years.update(range(bounds[0], bounds[-1] + 1))
    if not years:
        raise ValueError(f"bad years expression: {expr!r}")
    return sorted(years)


def format_years(years: Iterable[int]) -> str:
    ordered = sorted(set(years))
    if len(ordered) > 1 and ordered[-1] - ordered[0] + 1 == len(ordered):
        return f"{ordered[0]}-{ordered[-1]}"
    return ",".join(str(y) for y in ordered)


def in_years(year: Column, expr: str) -> Column:
    """Filter on a year column; on a partition column this prunes partitions."""
    return year.isin(parse_years(expr))


def evaluation_window(year: Column) -> Column:
    """Which external sources cover a year."""
    return (F.when(year.between(2000, 2018), F.lit("core"))
            .when(year.between(2019, 2020), F.lit("rain_only"))
            .otherwise(F.lit("not_evaluable")))
