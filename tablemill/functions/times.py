"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
WEEK = 7 * DAY


def month_start(text: Column) -> Column:
    """Month of a ``yyyy-mm...`` text."""
    return F.try_to_timestamp(F.concat(F.substring(text, 1, 7), F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")


def floor_time(ts: Column, seconds: int) -> Column:
    """Start of the fixed interval a timestamp lies in."""
    step = seconds * 1_000_000
    return F.timestamp_micros(F.floor(F.unix_micros(ts) / step) * step)


def round_time(ts: Column, seconds: int) -> Column:
    """Nearest multiple of an interval, halves to even."""
    return F.timestamp_seconds(F.bround(F.unix_micros(ts) / (seconds * 1e6)) * seconds)


def week_floor(day: Column, weekday: int = 0) -> Column:
    """Start of the week that begins on ``weekday`` (0 = Monday)."""
    back = F.pmod(F.weekday(day) - weekday, F.lit(7))
    return F.date_sub(F.to_date(day), back.cast("int"))


def quarter_floor(day: Column) -> Column:
    return F.trunc(day, "quarter")


def business_floor(day: Column) -> Column:
    """The day itself, or the Friday before a weekend."""
    extra = F.greatest(F.weekday(day) - 4, F.lit(0))
    return F.date_sub(F.to_date(day), extra)


def epoch_week(unix_seconds: Column) -> Column:
    """Whole weeks since the epoch."""
    return F.floor(unix_seconds / WEEK)


def epoch_week_start(week: Column) -> Column:
    """Unix second of the Monday that opens an epoch week."""
    return week * WEEK - 3 * DAY


def epoch_week_stop(week: Column) -> Column:
    return week * WEEK + 4 * DAY - 1


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight of ``HH:MM`` with an optional am/pm mark, which is ignored."""
    hours = F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})", 1).try_cast("int")
    minutes = F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})", 2).try_cast("int")
    return hours * 60 + minutes


def time_frame(day: Column, reference: Column) -> Column:
    return F.when(day < reference, "Past").when(day > reference, "Future").otherwise("Current")
