"""Time conversions (F1-F9, F11, F13, F14, A9 week key).

All conversions are integer-exact: nanosecond stamps are divided with integer
``div`` (a double cannot hold a 19-digit nanosecond value), and gaps are taken
on ``unix_micros``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_S = 1_000_000_000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ns_to_seconds(c) -> Column:
    """Nanoseconds since epoch -> whole seconds (floor for positives)."""
    n = _c(c).cast("long")
    return F.call_function("div", n, F.lit(NS_PER_S).cast("long"))


def ns_to_timestamp(c) -> Column:
    """Nanoseconds since epoch -> TIMESTAMP truncated to the second (F1)."""
    return F.timestamp_seconds(ns_to_seconds(c))


def time_parts(ts) -> dict[str, Column]:
    """date / hour / minute / second of a timestamp."""
    t = _c(ts)
    return {"date": F.to_date(t), "hour": F.hour(t), "minute": F.minute(t), "second": F.second(t)}


def second_string(ts) -> Column:
    """Zero-padded ``yyyy-MM-dd HH:mm:ss`` text of a timestamp."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def parse_iso_offset(c) -> Column:
    """ISO text with milliseconds and a numeric offset -> instant."""
    return F.try_to_timestamp(_c(c), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))


def parse_wall_clock(c) -> Column:
    """Cut the last 9 characters (``SSS+hh:mm``) and parse the rest, which
    ends in the seconds' dot (F6).

    The offset is dropped on purpose: the result is the local wall clock.
    """
    s = _c(c)
    return F.try_to_timestamp(F.substring(s, F.lit(1), F.length(s) - 9), F.lit("yyyy-MM-dd'T'HH:mm:ss."))


def parse_hour_string(c) -> Column:
    """``yyyy-MM-dd:HH`` -> timestamp at the hour."""
    return F.try_to_timestamp(_c(c), F.lit("yyyy-MM-dd:HH"))


def epoch_us(ts) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))




def week_ending_sunday(ts) -> Column:
    """Label of the pandas ``'W'`` bin (weeks end on Sunday) of a timestamp."""
    return F.next_day(F.date_sub(F.to_date(_c(ts)), 1), "Sun")


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def bucket_start(ts, unit: str) -> Column:
    """Start of the bucket holding ``ts``: a ``date_trunc`` unit or ``'<n> seconds'``."""
    if unit in ("second", "minute", "hour", "day", "week", "month", "year"):
        return F.date_trunc(unit, _c(ts))
    n, what = unit.split()
    width = int(n) * _UNITS[what.rstrip("s")]
    return F.timestamp_seconds(F.floor(F.unix_seconds(_c(ts).cast("timestamp")) / width) * width)
