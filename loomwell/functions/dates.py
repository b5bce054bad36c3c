"""Dates: rolling windows, local calendar labels, API forms. ``now`` is always a parameter."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwell.functions.text import col

# Days of a unit in rolling windows (not calendar months or years).
UNIT_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}
FIRST_YEAR, LAST_YEAR = 1995, 2100


def resolve_date(value: str | None, now: datetime) -> datetime | None:
    """An absolute date (midnight UTC where no time is given) or 7d, 2w, 3m, 1y back from now; else None."""
    text = (value or "").strip()
    if m := re.fullmatch(r"(\d+)\s*([dwmy])", text, re.I):
        return now - timedelta(days=int(m[1]) * UNIT_DAYS[m[2].lower()])
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def is_relative(value: Column | str) -> Column:
    return F.lower(F.trim(col(value))).rlike(r"^\d+[dwmy]$")


def within(ts: Column | str, since: Column | datetime | None, until: Column | datetime | None) -> Column:
    """Undated rows pass; both ends belong to the window."""
    t = col(ts)
    ok = F.lit(True)
    if since is not None:
        ok = ok & (t >= (since if isinstance(since, Column) else F.lit(since)))
    if until is not None:
        ok = ok & (t <= (until if isinstance(until, Column) else F.lit(until)))
    return t.isNull() | ok


def plausible(date: Column | str) -> Column:
    """The trimmed text unless it begins with a year outside 1995 to 2100."""
    t = F.trim(col(date))
    year = F.regexp_extract(t, r"^(\d{4})", 1).try_cast("int")
    return F.when((t != "") & (year.isNull() | year.between(FIRST_YEAR, LAST_YEAR)), t)


def local_year(date: Column | str) -> Column:
    """The year on the post's own clock, Undated without one."""
    return F.when(col(date).rlike(r"^\d{4}-\d{2}"), F.substring(col(date), 1, 4)).otherwise("Undated")


def local_month(date: Column | str) -> Column:
    return F.when(col(date).rlike(r"^\d{4}-\d{2}"), F.substring(col(date), 1, 7)).otherwise("Undated")


def wall_year(wall_us: Column | str) -> Column:
    """The year of a wall clock in microseconds, Undated without one."""
    return F.coalesce(F.date_format(F.timestamp_micros(col(wall_us)), "yyyy"), F.lit("Undated"))


def wall_month(wall_us: Column | str) -> Column:
    return F.coalesce(F.date_format(F.timestamp_micros(col(wall_us)), "yyyy-MM"), F.lit("Undated"))


def month_label(date: Column | str) -> Column:
    day = F.try_to_date(F.concat(F.substring(col(date), 1, 7), F.lit("-01")), "yyyy-MM-dd")
    return F.coalesce(F.date_format(day, "MMMM yyyy"), F.lit("Undated"))


def long_date(ts: Column | str) -> Column:
    return F.date_format(col(ts), "d MMMM yyyy")


def gmt(date: Column | str) -> Column:
    """Append +00:00 where neither Z nor +00:00 ends the text."""
    t = col(date)
    return F.when(t.endswith("Z") | t.endswith("+00:00"), t).otherwise(F.concat(t, F.lit("+00:00")))


def api_day(day: Column | str, end: bool) -> Column:
    return F.concat(F.substring(col(day), 1, 10), F.lit("T23:59:59" if end else "T00:00:00"))


def issue_of(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyyMMdd")
