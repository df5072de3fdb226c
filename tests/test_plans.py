from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows, same_rows
from tidemark.operators.options import OptionError
from tidemark.operators.spans import Granularity
from tidemark.plans.cooling import cdu_series, cep_series
from tidemark.plans.jobs import jobs
from tidemark.plans.power import job_power_series
from tidemark.plans.replay import NoDataError, replay_jobs
from tidemark.plans.runs import get_run, list_runs, stale_runs
from tidemark.plans.system import system_series
from tidemark.schemas import CDUS, CEP, JOB_POWER, JOBS, RUNS, SYSTEM


def at(h, m=0, s=0):
    return datetime(2024, 1, 1, h, m, s)


def utc(h, m=0, s=0):
    return at(h, m, s).replace(tzinfo=timezone.utc)


def table(spark, schema, data):
    return spark.createDataFrame([tuple(row.get(f, None) for f in schema.fieldNames()) for row in data], schema)


@pytest.fixture
def runs(spark):
    base = dict(user="ann", system="big", state="running", start=at(0), end=at(4), config='{"x": 1}')
    return table(spark, RUNS, [
        dict(base, ts=at(10), id="r1", execution_start=at(10)),
        dict(base, ts=at(11), id="r2", execution_start=at(11), user="bob"),
        dict(base, ts=at(12), id="r2", execution_start=at(11), user="bob", state="success", execution_end=at(12), progress_date=at(4)),
        dict(base, ts=at(9), id="r3", execution_start=at(9)),
    ])


@pytest.fixture
def ticks(spark):
    return spark.createDataFrame([("r1", at(1)), ("r1", at(2)), ("r2", at(4))], "sim_id string, ts timestamp")


def test_list_runs(runs, ticks):
    listed = list_runs(runs, ticks, {"state": ["eq:running"]}, ["desc:user"], "user,progress")
    assert [tuple(r) for r in listed.rows.collect()] == [("r3", "ann", 0.0), ("r1", "ann", 0.5)]
    assert listed.rows.columns == ["id", "user", "progress"] and listed.total() == 2
    assert list_runs(runs, ticks, limit=1, offset=2).total() == 3
    assert [r.id for r in list_runs(runs, ticks, fields=["user"], limit=2, offset=1).rows.collect()] == ["r1", "r2"]
    # Filters other than on the state pick among a run's events.
    old = list_runs(runs, ticks, {"execution_start": ["lt:2024-01-01T11:30"], "id": ["eq:r2"]}, fields="state")
    assert [tuple(r) for r in old.rows.collect()] == [("r2", "success")]
    with pytest.raises(OptionError):
        list_runs(runs, ticks, {"progress": ["gt:0"]})


def test_progress_is_only_computed_when_selected(runs, ticks):
    assert "sim_id" not in list_runs(runs, ticks, fields="user").rows._jdf.queryExecution().optimizedPlan().toString()


def test_get_run(runs, ticks):
    row = get_run(runs, ticks, "r2").first()
    assert (row.state, row.progress, row.progress_date, row.config) == ("success", 1.0, at(4), '{"x": 1}')
    assert get_run(runs, ticks, "nope").count() == 0


def test_stale_runs(spark, runs):
    live = spark.createDataFrame([("r1",)], "id string")
    same_rows(stale_runs(runs, live, utc(13)), [("r3", "fail")], "id", "state")


@pytest.fixture
def job_log(spark):
    base = dict(sim_id="s", name="n", node_count=4, time_limit=3600)
    return table(spark, JOBS, [
        dict(base, ts=at(1), job_id="a", time_submission=at(1), state_current="PENDING"),
        dict(base, ts=at(2), job_id="a", time_submission=at(1), time_start=at(2), state_current="RUNNING", nodes=["x", "y"]),
        dict(base, ts=at(4), job_id="a", time_submission=at(1), time_start=at(2), time_end=at(4), state_current="COMPLETED", nodes=["x", "y"]),
        dict(base, ts=at(3), job_id="b", time_submission=at(3), time_start=at(3), state_current="RUNNING", node_count=9),
        dict(base, ts=at(5), job_id="c", time_submission=at(5), state_current="PENDING"),
        dict(base, ts=at(5), job_id="a", sim_id="other", time_submission=at(5), state_current="PENDING"),
    ])


def listed(page, *columns):
    return [tuple(r) for r in page.rows.select(*columns).collect()]


def test_jobs(job_log):
    assert listed(jobs(job_log, "s"), "job_id", "state_current") == [("c", "PENDING"), ("a", "COMPLETED"), ("b", "RUNNING")]
    assert listed(jobs(job_log, "s", time_travel=utc(3)), "job_id", "state_current") == [("a", "RUNNING"), ("b", "RUNNING")]
    assert listed(jobs(job_log, "s", filters={"state_current": "eq:RUNNING"}), "job_id") == [("b",)]
    assert listed(jobs(job_log, "s", filters={"time_limit": "eq:PT1H", "node_count": "gt:4"}), "job_id") == [("b",)]
    assert listed(jobs(job_log, "s", fields="job_id", sort=["desc:node_count", "asc:time_end"]), "job_id") == [("b",), ("c",), ("a",)]
    everything = jobs(job_log, limit=2)
    assert everything.rows.columns[:2] == ["sim_id", "job_id"] and everything.total() == 4
    first = jobs(job_log, "s").rows.filter("job_id = 'a'").first()
    assert (first.nodes, first.time_snapshot, first.time_limit) == (["x", "y"], at(4), 3600)


def test_jobs_in_an_interval(job_log):
    # Job b runs throughout but has no snapshot after the start.
    by_snapshot = jobs(job_log, "s", start=utc(3, 30), end=utc(4, 30), strict_overlap=False)
    assert listed(by_snapshot, "job_id") == [("a",)]
    strict = jobs(job_log, "s", start=utc(3, 30), end=utc(4, 30))
    assert listed(strict, "job_id") == [("a",), ("b",)]
    assert listed(jobs(job_log, "s", start=utc(2), end=utc(3, 30), strict_overlap=False), "job_id", "state_current") == [("a", "COMPLETED"), ("b", "RUNNING")]


def test_cdu_series(spark, runs):
    data = [dict(ts=at(h, m), sim_id=r, name=n, row=1, col=2, total_power=float(h * 60 + m)) for r in ("r1", "r2") for n in ("x1", "x2") for h in range(5) for m in (0, 30)]
    cdus = table(spark, CDUS, data)
    one = cdu_series(cdus, runs, "r1", granularity=Granularity(resolution=2), fields="name,total_power,pos", filters={"name": "eq:x1"})
    assert [tuple(r) for r in one.rows.collect()] == [(at(0), "x1", 90.0, 1, 2), (at(2), "x1", 210.0, 1, 2)]
    assert (one.span.start, one.span.end) == (utc(0), utc(4))
    every = cdu_series(cdus, runs, granularity=Granularity(resolution=2), fields="name,total_power", filters={"name": "eq:x1"})
    same_rows(every.rows.filter("sim_id = 'r1'"), [("r1", at(0), "x1", 90.0), ("r1", at(2), "x1", 210.0)])
    part = cdu_series(cdus, runs, "r1", start=utc(1, 10), granularity=Granularity(width=7200), fields="total_power")
    assert [tuple(r) for r in part.rows.collect()] == [(at(1, 10), 180.0)] * 2 + [(at(3, 10), 210.0)] * 2
    assert cdu_series(cdus, runs, "nope", start=utc(1), granularity=Granularity(width=1)).rows.count() == 0


def test_series_as_arrays(spark, runs):
    data = [dict(ts=at(h), sim_id="r1", **{c: float(h) for c in CEP.fieldNames()[2:]}) for h in range(6)]
    series = cep_series(table(spark, CEP, data), runs, "r1", fields="htw_flowrate,pue_output")
    assert [tuple(r) for r in series.rows.collect()] == [(at(0), 3.0, 3.0)]
    packed = series.as_arrays().first()[0]
    assert tuple(packed) == (at(0), 3.0, 3.0)


def test_system_series(spark, runs):
    data = [dict(ts=at(h), sim_id="r1", num_samples=h, p_flops=float(9 - h) if h != 3 else None, down_nodes=[f"n{h}"]) for h in range(6)]
    system = table(spark, SYSTEM, data)
    row = system_series(system, runs, "r1").rows.first()
    assert (row.timestamp, row.num_samples, row.p_flops, row.down_nodes) == (at(0), 3, None, ["n3"])
    assert system_series(system, runs, "r1", granularity=Granularity(width=3600)).rows.count() == 4


def test_job_power(spark):
    data = [dict(ts=at(1, 0, s), sim_id="s", job_id=j, power=float(s)) for j in ("a", "b") for s in range(0, 20, 5)]
    power = table(spark, JOB_POWER, data)
    one = job_power_series(power, "s", "a", granularity=Granularity(width=10), fields="all")
    assert [tuple(r) for r in one.rows.collect()] == [(at(1), "a", 5.0), (at(1, 0, 10), "a", 15.0)]
    assert one.span.end == utc(1, 0, 16)
    assert job_power_series(power, "s", "none", start=utc(1)).rows.count() == 0
    every = job_power_series(power, granularity=Granularity(width=10)).rows
    assert rows(every.filter("job_id = 'a'").drop("sim_id", "job_id")) == rows(one.rows.drop("job_id"))


def test_replay_needs_rows(spark):
    df = spark.createDataFrame([(at(1), at(1), at(2), "1,2")], "ts timestamp, a timestamp, b timestamp, nodes string")
    found = replay_jobs(df, utc(0), utc(3), "a", "b", int_lists=["nodes"], zoneless=["a"], must_exist=True)
    assert found.first().nodes == [1, 2] and found.schema["a"].dataType.typeName() == "timestamp_ntz"
    with pytest.raises(NoDataError):
        replay_jobs(df, utc(5), utc(6), "a", "b", must_exist=True)


def test_rows_and_total_agree_on_ties(spark):
    """Two newest snapshots at one time: whatever is selected, the same one counts."""
    at = datetime(2024, 1, 1, 12)
    columns = "ts timestamp, sim_id string, job_id string, name string, node_count long, time_submission timestamp, time_limit long, time_start timestamp, time_end timestamp, state_current string, nodes array<string>"
    same = (at, "s", "j", "n", 1, at, 60, at, None)
    log = spark.createDataFrame([(*same, "RUNNING", ["a"]), (*same, "COMPLETED", ["b"])], columns)
    for fields in (None, "state_current", "job_id", "job_id,nodes"):
        for state, found in (("RUNNING", 1), ("COMPLETED", 0)):
            page = jobs(log, "s", filters={"state_current": [f"eq:{state}"]}, fields=fields)
            assert (page.rows.count(), page.total()) == (found, found)


def test_unknown_fields_are_option_errors(spark):
    log = spark.createDataFrame([], "ts timestamp, sim_id string")
    with pytest.raises(OptionError, match="unknown field 'x'"):
        jobs(log, fields="job_id,x")
