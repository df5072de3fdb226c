"""Durations: parsing option values and snapping to readable breakpoints."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from datetime import timedelta

from pyspark.sql import Column

from tidemark.functions.steps import step_value

_UNIT_SECONDS = {
    "second": 1,
    "minute": 60,
    "hour": 3_600,
    "day": 86_400,
    "month": 30 * 86_400,
    "year": 365 * 86_400,
}

# The granularities a resolution may snap to, in seconds (a month is 30 days, a year 365).
BREAKPOINT_SECONDS = (
    1, 2, 3, 4, 5, 10, 15, 20, 30,
    60, 120, 180, 240, 300, 600, 900, 1200, 1800,
    3600, 7200, 10800, 14400, 21600, 28800, 43200,
    86400, 172800, 259200, 345600, 432000, 604800, 1209600,
    2592000, 5184000, 7776000, 10368000, 15552000,
    31536000, 63072000, 94608000, 126144000, 157680000, 315360000,
)

_ISO = re.compile(
    r"(?P<sign>[+-])?P(?!$)"
    r"(?:(?P<year>\d+(?:\.\d+)?)Y)?(?:(?P<month>\d+(?:\.\d+)?)M)?"
    r"(?:(?P<week>\d+(?:\.\d+)?)W)?(?:(?P<day>\d+(?:\.\d+)?)D)?"
    r"(?:T(?=\d)(?:(?P<hour>\d+(?:\.\d+)?)H)?(?:(?P<minute>\d+(?:\.\d+)?)M)?"
    r"(?:(?P<second>\d+(?:\.\d+)?)S)?)?"
)


def parse_duration(value: str | int | float | timedelta) -> timedelta:
    """A duration from a timedelta, a number of seconds, or an ISO 8601 duration text."""
    if isinstance(value, timedelta):
        return value
    try:
        return timedelta(seconds=float(value))
    except (ValueError, OverflowError):
        found = _ISO.fullmatch(str(value).strip())
    if found is None:
        raise ValueError(f"not a duration: {value!r}")
    parts = found.groupdict()
    units = {**_UNIT_SECONDS, "week": 7 * 86_400}
    seconds = sum(float(parts[u]) * s for u, s in units.items() if parts[u])
    return timedelta(seconds=-seconds if parts["sign"] == "-" else seconds)


def to_micros(delta: timedelta) -> int:
    return delta // timedelta(microseconds=1)


def snap_duration(delta: timedelta, direction: str = "down") -> timedelta:
    """The nearest breakpoint at or below (``down``) or at or above (``up``), clamped at both ends."""
    seconds = delta.total_seconds()
    if direction == "up":
        at = min(bisect_left(BREAKPOINT_SECONDS, seconds), len(BREAKPOINT_SECONDS) - 1)
    else:
        at = max(bisect_right(BREAKPOINT_SECONDS, seconds) - 1, 0)
    return timedelta(seconds=BREAKPOINT_SECONDS[at])


def snap_seconds(seconds: Column) -> Column:
    """Column form of snapping down, in whole seconds (bigint)."""
    points = list(BREAKPOINT_SECONDS)
    return step_value(seconds, points[1:], points).cast("long")


def snap_rate(desired: int, step: int) -> int:
    """The largest multiple of ``step`` not above ``desired``, and at least ``step``."""
    return max(desired - desired % step, step)
