"""Helpers for functions whose meaning in warehouse dialects differs from Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of TO_CHAR and their Java forms, longest first. Fixed by both dialects.
_PATTERNS = (("YYYY", "yyyy"), ("HH24", "HH"), ("MONTH", "MMMM"), ("Month", "MMMM"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("Mon", "MMM"), ("MM", "MM"), ("DD", "dd"), ("Day", "EEEE"), ("Dy", "EEE"), ("YY", "yy"))


def to_char(ts: Column, pattern: str) -> Column:
    """TO_CHAR with the dialect's pattern; names are not blank-padded."""
    out, at = "", 0
    while at < len(pattern):
        for theirs, java in _PATTERNS:
            if pattern.startswith(theirs, at):
                out, at = out + java, at + len(theirs)
                break
        else:
            c = pattern[at]
            out, at = out + (f"'{c}'" if c.isalpha() else c), at + 1
    return F.date_format(ts, out)


def idiv(a: Column, b: Column) -> Column:
    """Integer division that cuts toward zero, NULL for a zero divisor."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def datediff(part: str, a: Column, b: Column) -> Column:
    """DATEDIFF: boundaries of the part crossed from a to b. Weeks begin on Sunday."""
    days = lambda c: F.unix_date(F.to_date(c))
    months = lambda c: F.year(c) * 12 + F.month(c)
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))
    forms = {
        "year": lambda c: F.year(c),
        "quarter": lambda c: F.year(c) * 4 + F.quarter(c),
        "month": months,
        "week": lambda c: F.floor((days(c) + 4) / 7),
        "day": days,
        "hour": lambda c: F.floor(seconds(c) / 3_600_000_000),
        "minute": lambda c: F.floor(seconds(c) / 60_000_000),
        "second": lambda c: F.floor(seconds(c) / 1_000_000),
    }
    return (forms[part](b) - forms[part](a)).cast("long")


def dateadd(part: str, n: int, d: Column) -> Column:
    """DATEADD on a date stays a date."""
    if part in ("day", "week"):
        return F.date_add(d, n * (7 if part == "week" else 1))
    return F.add_months(d, n * {"month": 1, "quarter": 3, "year": 12}[part])


def add_months_end(d: Column, n: int) -> Column:
    """ADD_MONTHS that keeps a month's end at the end of a month."""
    moved = F.add_months(d, n)
    return F.when(F.last_day(d) == d, F.last_day(moved)).otherwise(moved)


def business_days(a: Column, b: Column) -> Column:
    """Week days in the half-open range from a to b, for a and b on week days."""
    return datediff("day", a, b) - 2 * datediff("week", a, b)


def bucket_start(ts: Column, seconds: int) -> Column:
    """The start of the bucket of so many seconds that a timestamp lies in."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)) * seconds)


def difference(a: Column, b: Column) -> Column:
    """DIFFERENCE: equal places of two soundex codes, 0 to 4."""
    x, y = F.soundex(a), F.soundex(b)
    return sum((F.substring(x, k, 1) == F.substring(y, k, 1)).cast("int") for k in range(1, 5))


def regexp_substr_group(s: Column, pattern: str, group: int = 1) -> Column:
    """REGEXP_SUBSTR with a subexpression; NULL rather than empty where nothing matches."""
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


def quote_ident(name: str) -> str:
    """An identifier fit for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def quote_literal(value: str) -> str:
    """A string literal fit for SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def retail_week(d: Column, first_day: str = "2023-01-29") -> Column:
    """Year, period, week and day of a 4-5-4 calendar of 52-week years that begins on a Sunday: a struct."""
    n = F.datediff(d, F.lit(first_day).cast("date"))
    week_of_year = F.floor(F.pmod(n, F.lit(364)) / 7) + 1
    week_of_quarter = F.pmod(week_of_year - 1, F.lit(13)) + 1
    month = F.when(week_of_quarter <= 4, 1).when(week_of_quarter <= 9, 2).otherwise(3)
    quarter = F.floor((week_of_year - 1) / 13) + 1
    return F.struct(
        (F.floor(n / 364) + F.year(F.lit(first_day).cast("date"))).cast("int").alias("year"),
        quarter.cast("int").alias("quarter"),
        ((quarter - 1) * 3 + month).cast("int").alias("period"),
        week_of_year.cast("int").alias("week"),
        (F.pmod(n, F.lit(7)) + 1).cast("int").alias("day"),
    )
