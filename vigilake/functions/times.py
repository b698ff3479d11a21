"""Times as bigint microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000
#: What an unfinished recording covers after its start: for a look-up, and in a coverage report.
OPEN_COVER_US, OPEN_COVERAGE_US = 2 * MINUTE, MINUTE


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp without time zone; independent of the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def floor_to(us: Column, unit: int) -> Column:
    """The start of the hour, minute, ... that holds a time."""
    return us - F.pmod(us, F.lit(unit))


def seconds_between(a: Column, b: Column) -> Column:
    return (b - a) / F.lit(float(SECOND))


def local_day(us: Column, zone: str) -> Column:
    """The calendar day of a time in a zone."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def covers_until(started: Column, ended: Column, slack_us: int = OPEN_COVER_US) -> Column:
    return F.coalesce(ended, started + slack_us)


def midpoint(a: Column, b: Column) -> Column:
    return a + F.floor((b - a) / 2).cast("long")


def clamp(us: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(us, high))


def seek_offset(entry: Column, segment_start: Column, lead_us: int) -> Column:
    """Seconds into a segment at which to begin, a little ahead of the entry."""
    return F.greatest(F.lit(0.0), (entry - segment_start - lead_us) / F.lit(float(SECOND)))


def rounded_window(now_us: int, days: int) -> tuple[int, int]:
    """since, until: whole hours up to the end of the present one."""
    until = now_us - now_us % HOUR + HOUR
    return until - days * DAY, until


def segment_start(path: Column) -> Column:
    """The start in a segment's file name, such as 20260901-090000.mp4; null for any other name."""
    stamp = F.regexp_extract(path, r"(\d{8}-\d{6})\.[A-Za-z0-9]+$", 1)
    return F.when(stamp != "", micros(F.try_to_timestamp(F.when(stamp != "", stamp), F.lit("yyyyMMdd-HHmmss")).cast("timestamp_ntz")))
