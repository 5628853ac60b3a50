"""Time as BIGINT microseconds; every function is a built-in expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp column, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def local_micros(us, zone: str) -> Column:
    """Wall-clock microseconds in ``zone``; differences of these are wall-clock differences."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def day_number(us) -> Column:
    """Days since 1970 of wall-clock microseconds."""
    return F.floor(us / F.lit(DAY)).cast("int")


def date_text(day) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd")


def weekday(day) -> Column:
    """0 = Monday."""
    return F.pmod(day + 3, F.lit(7))


def parse_utc(text) -> Column:
    """Microseconds of an RFC 3339 text; NULL for anything that isn't one."""
    return F.unix_micros(F.try_to_timestamp(text))


def format_duration(seconds) -> Column:
    """``1h 5m``, ``2m 3s`` or ``7s``."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long")
    return F.when(s >= 3600, F.format_string("%dh %dm", h, m % 60)).when(s >= 60, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def clock_seconds(text) -> Column:
    """Seconds of ``12.5``, ``MM:SS`` or ``HH:MM:SS``; NULL for anything else."""
    part = lambda k: F.regexp_extract(text, r"^(?:(?:(\d+):)?(\d+):)?(\d+(?:\.\d+)?)$", k)
    number = lambda k: F.coalesce(F.nullif(part(k), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.when(F.regexp_like(text, F.lit(r"^(?:(?:\d+:)?\d+:)?\d+(?:\.\d+)?$")), number(1) * 3600 + number(2) * 60 + number(3))
