"""Dates: lenient parsing, parts, arithmetic, ISO weeks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed order in which formats are tried.
FORMATS = (
    "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d H:m", "yyyy-M-d", "d/M/yyyy", "d MMMM yyyy", "d MMM yyyy",
    "MMMM d yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMM d, yyyy", "EEE, d MMM yyyy H:m:s Z",
)


def _shape(layout: str) -> str:
    """A regular expression that all texts of a layout meet."""
    part = lambda m: re.escape(m[1]) if m[1] is not None else ("[A-Za-z.]+" if m[0].startswith("MMM") else r"\S+" if m[0][0] in "ZXO" else r"\d+") if m[2] else re.escape(m[0])
    return "^" + re.sub(r"'([^']*)'|([A-Za-z])\2*|.", part, layout) + "$"


def parse(c: str | Column) -> Column:
    """Timestamp of a string in any of ``FORMATS``, of an ISO week (2024-W05-3) or of Unix seconds; null if none fits."""
    s = F.trim(F.col(c) if isinstance(c, str) else c)
    unix = F.timestamp_seconds(F.when(s.rlike(r"^\d{9,10}$"), s.try_cast("long")))
    week = F.when(s.rlike(r"^\d{4}-?W\d{2}-?[1-7]$"), iso_week(*(F.regexp_extract(s, r"^(\d{4})-?W(\d{2})-?([1-7])$", i).try_cast("int") for i in (1, 2, 3))).cast("timestamp"))
    # of layouts with a weekday's name only what follows it is read: formatters differ in how they take it
    plain = F.regexp_replace(s, r"^[A-Za-z]{3}, ", "")
    # a value is parsed only by formats whose shape it has: failed parses are dear
    tries = []
    for f in FORMATS:
        text, f = (plain, f.removeprefix("EEE, ")) if f.startswith("EEE") else (s, f)
        tries.append(F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f))))
    return F.coalesce(unix, week, *tries)


def iso_week(year: Column, week: Column, weekday: Column) -> Column:
    """Date of an ISO year, week and weekday (1 is Monday)."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(fourth, (week - 1) * 7 + weekday - 1 - F.weekday(fourth))


def parts(c: str | Column) -> dict[str, Column]:
    c = F.col(c) if isinstance(c, str) else c
    return {
        "year": F.year(c), "month": F.month(c), "day": F.day(c), "hour": F.hour(c), "minute": F.minute(c), "second": F.second(c), "week": F.weekofyear(c),
        "weekday": F.weekday(c) + 1, "timestamp": F.unix_timestamp(c),
    }


def add(c: str | Column, years: int = 0, months: int = 0, days: int = 0, hours: int = 0, minutes: int = 0, seconds: float = 0) -> Column:
    """Months overflow to the month's last day."""
    c = F.col(c) if isinstance(c, str) else c
    time = c.cast("timestamp") - F.date_trunc("day", c.cast("timestamp"))
    moved = F.add_months(c.cast("date"), 12 * years + months).cast("timestamp") + time
    return moved + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(float(seconds)))


def difference(a: str | Column, b: str | Column) -> Column:
    """(days, seconds) of a - b."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    s = F.unix_timestamp(a) - F.unix_timestamp(b)
    return F.struct(F.floor(s / 86400).alias("days"), F.pmod(s, F.lit(86400)).alias("seconds"))


def formatted(c: str | Column, layout: str) -> Column:
    return F.date_format(c, layout)
