"""Instants, buckets and event time. Naive times are UTC throughout."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.durations import to_micros

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

# Fixed value: the event time given to rows that carry none.
DEFAULT_EVENT_TIME = datetime(2010, 1, 1, tzinfo=timezone.utc)


def parse_instant(value: str | date | datetime) -> datetime:
    """An aware UTC datetime from ISO text, an epoch number (s or ms) or a (naive) datetime."""
    if isinstance(value, str):
        text = value.strip()
        try:
            number = float(text)
        except ValueError:
            value = datetime.fromisoformat(text)
        else:
            # Epoch numbers above 2e10 can only be meant as milliseconds.
            value = _EPOCH + timedelta(seconds=number / 1000 if abs(number) > 2e10 else number)
    elif not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


def instant(value: str | date | datetime) -> Column:
    """Timestamp literal; compared with a stored column it is pushed down to the scan."""
    return F.lit(parse_instant(value))


def epoch_micros(value: datetime) -> int:
    return to_micros(parse_instant(value) - _EPOCH)


def from_epoch_micros(value: int) -> datetime:
    return _EPOCH + timedelta(microseconds=value)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def naive(ts: Column) -> Column:
    """The same UTC wall-clock time without a zone."""
    return ts.cast("timestamp_ntz")


def tumbling_window(ts: Column, width: timedelta, origin: datetime | None = None) -> Column:
    """The tumbling window ``ts`` falls in, aligned to ``origin`` (default: the epoch)."""
    step = to_micros(width)
    shift = epoch_micros(origin) % step if origin is not None else 0
    size = f"{step} microseconds"
    if shift:
        return F.window(ts, size, size, f"{shift} microseconds")
    return F.window(ts, size, size)


def bucket(ts: Column, width: timedelta, origin: datetime | None = None) -> Column:
    """Start of the tumbling window of ``ts``."""
    return tumbling_window(ts, width, origin).getField("start")


def bucket_micros(ts_us: Column, width_us: Column, origin_us: Column) -> Column:
    """Column-driven form of :func:`bucket` in epoch microseconds, for per-row width and origin."""
    return ts_us - F.pmod(ts_us - origin_us, width_us)


def floor_second(ts_us: Column) -> Column:
    return ts_us - F.pmod(ts_us, F.lit(1_000_000))


def ceil_second(ts_us: Column) -> Column:
    return ts_us + F.pmod(-ts_us, F.lit(1_000_000))


def offset_to_time(start: Column, offset: Column, first: Column | float = 0) -> Column:
    """``start`` plus ``offset - first`` seconds; a NULL offset gives NULL."""
    step = F.round((offset - first) * 1_000_000).cast("long")
    return F.timestamp_micros(micros(start) + step)


def event_time(*candidates: Column, default: datetime | None = DEFAULT_EVENT_TIME) -> Column:
    """The first candidate that parses as a time, else ``default``."""
    parsed = [c.try_cast("timestamp") for c in candidates]
    return F.coalesce(*parsed, *([] if default is None else [F.lit(default)]))


def iso_text(ts: Column) -> Column:
    """ISO 8601 text in UTC with milliseconds."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def on_grid(ts: Column, rate_seconds: int) -> Column:
    """Whether the whole second of ``ts`` is a multiple of the sampling rate."""
    return F.pmod(F.unix_seconds(ts.cast("timestamp")), F.lit(rate_seconds)) == 0
