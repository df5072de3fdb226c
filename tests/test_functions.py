from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark.functions.arrays import join_list, split_ints, split_list
from tidemark.functions.durations import BREAKPOINT_SECONDS, parse_duration, snap_duration, snap_rate, snap_seconds
from tidemark.functions.steps import step_value
from tidemark.functions.times import bucket, bucket_micros, event_time, offset_to_time, parse_instant

UTC = timezone.utc


@pytest.mark.parametrize(
    "seconds, direction, expected",
    [
        (2.5, "down", 2), (2.5, "up", 3), (70 * 86400, "up", 90 * 86400), (70 * 86400, "down", 60 * 86400),
        (1, "down", 1), (0, "down", 1), (4000 * 86400, "up", 3650 * 86400), (10**9, "down", 3650 * 86400),
    ],
)
def test_snap_duration(seconds, direction, expected):
    assert snap_duration(timedelta(seconds=seconds), direction).total_seconds() == expected


def test_breakpoints_ascend():
    assert list(BREAKPOINT_SECONDS) == sorted(set(BREAKPOINT_SECONDS)) and len(BREAKPOINT_SECONDS) == 43


@pytest.mark.parametrize(
    "value, seconds",
    [
        (10, 10), ("10", 10), ("1.5", 1.5), ("P1D", 86400), ("PT1H30M", 5400), ("P1W", 604800), ("P1Y", 31536000),
        ("P1M", 2592000), ("-PT5S", -5), ("PT0.25S", 0.25), (timedelta(minutes=2), 120),
    ],
)
def test_parse_duration(value, seconds):
    assert parse_duration(value).total_seconds() == seconds


@pytest.mark.parametrize("value", ["", "P", "PT", "1D", "soon", "P1H"])
def test_bad_durations(value):
    with pytest.raises(ValueError):
        parse_duration(value)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2022-03-05T06:07", datetime(2022, 3, 5, 6, 7, tzinfo=UTC)),
        ("2024-01-01T00:00Z", datetime(2024, 1, 1, tzinfo=UTC)),
        ("2024-01-01T02:00+02:00", datetime(2024, 1, 1, tzinfo=UTC)),
        ("1704067200", datetime(2024, 1, 1, tzinfo=UTC)),
        ("1704067200000", datetime(2024, 1, 1, tzinfo=UTC)),
    ],
)
def test_parse_instant(text, expected):
    assert parse_instant(text) == expected


def test_snap_rate():
    assert [snap_rate(5, s) for s in (1, 2, 3, 5, 7)] == [5, 4, 3, 5, 7]


def test_step_and_snap_columns(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.5,), (1.0,), (59.9,), (60.0,), (1e12,)], "x double")
    got = [tuple(r) for r in df.select(snap_seconds(F.col("x")), step_value(F.col("x"), [1, 60], ["a", "b", "c"])).collect()]
    expected = [None if x is None else snap_duration(timedelta(seconds=min(x, 1e9))).total_seconds() for x in (None, -1, 0.5, 1, 59.9, 60, 1e12)]
    assert [g[0] for g in got] == expected
    assert [g[1] for g in got] == [None, "a", "a", "b", "b", "c", "c"]


def test_bucket_forms_agree(spark):
    origin = datetime(2024, 1, 1, 0, 0, 3, tzinfo=UTC)
    df = spark.range(0, 5000).select(F.timestamp_micros(F.lit(1704067200000000 - 10**9) + F.col("id") * 777777).alias("ts"))
    width = timedelta(seconds=1.5)
    by_window = bucket(F.col("ts"), width, origin)
    by_column = F.timestamp_micros(bucket_micros(F.unix_micros("ts"), F.lit(1500000), F.lit(1704067203000000)))
    assert df.filter(by_window != by_column).count() == 0
    assert df.filter((F.col("ts") < by_window) | (F.col("ts") >= by_window + F.expr("interval 1500 milliseconds"))).count() == 0


def test_event_time_and_offsets(spark):
    df = spark.createDataFrame(
        [("2024-01-01T00:00:00Z", None, 1.5), ("x", "2024-01-02 03:04:05", None), (None, "y", 0.0)], "a string, b string, o double"
    )
    got = df.select(
        event_time(F.col("a"), F.col("b")).alias("t"), offset_to_time(F.lit(datetime(2024, 1, 1, tzinfo=UTC)), F.col("o"), 0.5).alias("s")
    ).select(F.date_format("t", "yyyy-MM-dd HH:mm:ss"), F.date_format("s", "yyyy-MM-dd HH:mm:ss")).collect()
    assert [tuple(r) for r in got] == [
        ("2024-01-01 00:00:00", "2024-01-01 00:00:01"),
        ("2024-01-02 03:04:05", None),
        ("2010-01-01 00:00:00", "2023-12-31 23:59:59"),
    ]


def test_lists(spark):
    df = spark.createDataFrame([("1,2, 3",), ("",), (None,)], "s string")
    assert rows(df.select(split_list(F.col("s")))) == [(["1", "2", " 3"],), ([],), ([],)]
    assert rows(df.select(split_ints(F.col("s")))) == [([1, 2, 3],), ([],), ([],)]
    assert df.select(join_list(split_ints(F.col("s")))).first()[0] == "1,2,3"
