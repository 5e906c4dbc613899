"""Date parsing, period keys and calendar arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyroute.constants import Grain

# --- fixed values -----------------------------------------------------------
# What the two accepted date formats match: a four-digit year, then month and
# day with or without a leading zero (a space may stand for the day's zero).
# The atomic group settles month and day before the end of the text is asked
# for, so "2025113" is 3 November and never 13 January.
_MONTH = r"(1[0-2]|0[1-9]|[1-9])"
_DAY = r"(?:(3[01]|[12]\d|0[1-9]|[1-9])| ([1-9]))"
COMPACT_DATE = rf"^(?>((?!0000)\d{{4}})(){_MONTH}{_DAY})\z"
ANY_DATE = rf"^(?>((?!0000)\d{{4}})(-?){_MONTH}\2{_DAY})\z"


def _parse(text: Column, pattern: str) -> Column:
    iso = F.regexp_replace(text, pattern, "$1-$3-$4$5")
    return F.when(text.rlike(pattern), iso.try_cast("date"))


def parse_compact(text: Column) -> Column:
    """Date of a `yyyyMMdd` text, NULL when it is not one."""
    return _parse(text, COMPACT_DATE)


def parse_date(text: Column) -> Column:
    """Date of a `yyyyMMdd` or `yyyy-MM-dd` text, NULL when it is neither."""
    return _parse(text, ANY_DATE)


def parse_iso(text: Column) -> Column:
    """Date of a strict `yyyy-MM-dd` text."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def iso_year(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day).cast("int")


def _iso_week(day: Column, separator: str) -> Column:
    week = F.lpad(F.weekofyear(day).cast("string"), 2, "0")
    return F.concat(iso_year(day).cast("string"), F.lit(separator), week)


def week_label(day: Column) -> Column:
    """Calendar label of the ISO week, such as `2025-S01`."""
    return _iso_week(day, "-S")


def period_key(day: Column, grain: Grain) -> Column:
    """Text key under which `day` is stored in the table of `grain`."""
    if grain.name == "semaines":
        return _iso_week(day, "-")
    if grain.name == "mois":
        return F.date_format(day, grain.month_pattern)
    return day.cast("string")


def key_year(day: Column, grain: Grain) -> Column:
    """Year a key belongs to: ISO year for weeks, calendar year otherwise."""
    return iso_year(day) if grain.name == "semaines" else F.year(day)


def period_start(day: Column, grain: Grain) -> Column:
    unit = {"jours": None, "semaines": "week", "mois": "month"}[grain.name]
    return day if unit is None else F.trunc(day, unit)


def period_starts(first: Column, last: Column, grain: Grain) -> Column:
    """Array of the first days of all periods of `grain` touched by [first, last]."""
    step = {"jours": "1 day", "semaines": "7 day", "mois": "1 month"}[grain.name]
    return F.sequence(
        period_start(first, grain), period_start(last, grain), F.expr(f"interval {step}")
    )


def month_first(day: Column) -> Column:
    return F.trunc(day, "month")


def shift_years(day: Column, years: int) -> Column:
    """Same month and day `years` away; 29 February rolls over to 1 March."""
    first = F.make_date(F.year(day) + F.lit(years), F.month(day), F.lit(1))
    return F.date_add(first, F.dayofmonth(day) - 1)


def clamp(day: Column, low: Column, high: Column) -> Column:
    # greatest and least pass over NULL, but no date stays no date.
    return F.when(day.isNotNull(), F.greatest(low, F.least(high, day)))
