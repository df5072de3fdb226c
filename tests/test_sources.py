import json
from datetime import datetime, timezone

import pytest

from tests.helpers import rows, same_rows
from tidemark import schemas
from tidemark.operators.spans import Segment, between
from tidemark.session import shared_dir
from tidemark.sources import sinks, tables


def test_missing_table_is_empty_but_other_errors_are_raised(spark, tmp_path):
    empty = tables.read_or_empty(spark, str(tmp_path / "none"), schemas.RUNS)
    assert empty.count() == 0 and empty.schema == schemas.RUNS
    with pytest.raises(Exception, match="no_such_format"):
        tables.read_or_empty(spark, str(tmp_path), schemas.RUNS, "no_such_format")


def test_event_time_default_or_drop(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("later",), (None,)], "t string")
    kept = tables.assign_event_time(df, ["t"])
    assert kept.filter("ts = timestamp '2010-01-01 00:00:00'").count() == 2
    assert tables.assign_event_time(df, ["t"], default=None).count() == 1


def test_segments_are_pruned(spark, events, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_segmented(events, path, sort_by=["user_id", "ts"])
    table = tables.read_parquet(spark, path)
    assert table.count() == events.count()
    part = between(table, "ts", datetime(2024, 1, 10, tzinfo=timezone.utc), datetime(2024, 1, 12, tzinfo=timezone.utc), segment=Segment("week"))
    assert len(part.inputFiles()) > 0
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(seg" in plan
    expected = events.filter("ts >= timestamp_ntz '2024-01-10' and ts < timestamp_ntz '2024-01-12'")
    assert rows(part, "event_id") == rows(expected, "event_id")
    # A range that begins inside a segment still sees all of its rows, whatever the unit.
    for unit in ("month", "year"):
        sinks.write_segmented(events, f"{path}-{unit}", unit=unit)
        stored = tables.read_parquet(spark, f"{path}-{unit}")
        late = between(stored, "ts", datetime(2024, 1, 10, tzinfo=timezone.utc), datetime(2024, 1, 12, tzinfo=timezone.utc), segment=Segment(unit))
        assert rows(late, "event_id") == rows(expected, "event_id")
        assert sinks.with_segment(events, unit=unit).select("seg").distinct().count() == 1


def test_daily_files_are_bounded(spark, events, tmp_path):
    path = tmp_path / "d"
    sinks.write_daily(events, str(path), "ts", rows_per_file=10)
    assert len(list(path.glob("date=2024-01-*"))) == 30
    for file in list(path.glob("date=2024-01-05/*.parquet")):
        assert spark.read.parquet(str(file)).count() <= 10
    assert tables.read_parquet(spark, str(path)).count() == events.count()


def test_json_rows(spark):
    runs = spark.createDataFrame(
        [("a", "running", None, datetime(2024, 1, 1), 0.5, '{"x": 1}')],
        "id string, state string, execution_end timestamp, execution_start timestamp, progress double, config string",
    )
    row = sinks.run_rows(runs, "runs").first()
    decoded = json.loads(row.value)
    assert row.topic == "runs" and "progress" not in decoded
    assert decoded["execution_end"] is None and json.loads(decoded["config"]) == {"x": 1}
    assert decoded["timestamp"] == decoded["execution_start"]
    assert json.loads(sinks.table_rows(runs, "t", ["id", "execution_end"]).first().value) == {"id": "a", "execution_end": None}


def test_jsonl_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (2, "y", 2.5)], "a int, topic string, b double")
    out = df.select("topic", sinks.json_row("a", "b").alias("value"))
    for _ in range(2):
        sinks.write_jsonl(out, str(tmp_path / "j"))
    back = tables.read_jsonl(spark, str(tmp_path / "j"), "a int, b double, topic string")
    same_rows(back, [(1, None, "x"), (2, 2.5, "y")] * 2)


def test_csv_with_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,began,n\n1,2019-05-01 10:00:00.25,\n2,,5\n")
    schema = spark.createDataFrame([], "id long, began timestamp, n long").schema
    same_rows(tables.read_csv(spark, str(tmp_path), schema), [(1, datetime(2019, 5, 1, 10, 0, 0, 250000), None), (2, None, 5)])


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark, "x") != shared_dir(spark, "x")

    class Session:
        """Stands in for a cluster session; the setting cannot be changed on a running one."""

        def __init__(self, settings):
            self.sparkContext = self
            self.master = "yarn"
            self.conf = self
            self.settings = settings

        def getConf(self):
            return self

        def get(self, key, default=None):
            return self.settings.get(key, default)

    assert shared_dir(Session({"spark.checkpoint.dir": "hdfs://shared/"}), "x").startswith("hdfs://shared/x-")
    with pytest.raises(ValueError):
        shared_dir(Session({}), "x")
