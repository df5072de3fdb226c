"""Scheduler jobs: latest (or past) state, filtered, sorted and paged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import instant
from tidemark.operators.fields import expand_fields
from tidemark.operators.filters import Filters
from tidemark.operators.overlap import active_between
from tidemark.operators.pages import latest_page
from tidemark.operators.snapshots import as_of
from tidemark.operators.sorting import Page, Sort
from tidemark.operators.spans import Segment
from tidemark.schemas import JOB_FIELDS, JOB_GROUPS, JOB_OPTION_FIELDS, JOB_SORT

#: Filters on these see the resulting state; filters on all others see each snapshot.
CHANGING = ("time_end", "state_current")


def jobs(
    log: DataFrame,
    run: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    time_travel: datetime | None = None,
    filters: Mapping[str, list[str]] | None = None,
    sort: Sequence[str] | None = None,
    fields: str | list[str] | None = None,
    limit: int = 100,
    offset: int = 0,
    *,
    tie_breaks: Sequence[str] = ("time_end",),
    strict_overlap: bool = True,
    segment: Segment | None = None,
    deep: bool = False,
) -> Page:
    """A page of jobs of one run, or of all runs (then ``sim_id`` comes first in every row).

    Of several snapshots at a job's newest time, ``tie_breaks`` and then all other fields but ``nodes`` decide, the
    larger value first, whatever is selected. ``start``/``end`` keep jobs queued or running in the interval, judged by their latest state up to
    ``end``. With ``strict_overlap=False`` snapshots from before ``start`` are not looked at: less is
    read, and a job without any snapshot in the interval is missed. ``deep`` is for large offsets: the page is
    located by counts, which starts jobs.
    """
    chosen = expand_fields(fields, JOB_GROUPS, JOB_FIELDS)
    wanted = Filters.parse(JOB_OPTION_FIELDS, filters)
    order = Sort.parse(JOB_OPTION_FIELDS, sort, JOB_SORT)
    entity = ["job_id"] if run else ["sim_id", "job_id"]
    if run:
        log = log.filter(F.col("sim_id") == run)
    log = as_of(log, time_travel, segment=segment)
    if strict_overlap:
        log = as_of(log, end, segment=segment)
    else:
        log = active_between(log, start, end, segment=segment)

    steady = [f for f in JOB_OPTION_FIELDS if f not in CHANGING]
    log = wanted.apply(log, {f: F.col(f) for f in steady}).withColumn("time_snapshot", F.col("ts"))
    later = [c.field for c in wanted.conditions if c.field in CHANGING]
    if strict_overlap:
        later += ["time_submission", "time_end"]

    def keep(states: DataFrame) -> DataFrame:
        states = wanted.apply(states, {f: F.col(f) for f in CHANGING if f in later})
        if strict_overlap and start:
            states = states.filter(F.col("time_end").isNull() | (F.col("time_end") > instant(start)))
        if strict_overlap and end:
            states = states.filter(F.col("time_submission") < instant(end))
        return states

    # Only what is selected, sorted by or filtered on afterwards is carried through the shuffle.
    used = {*chosen, *later, *(k.field for k in order.keys)}
    if not run:
        order = Sort([*order.keys, *Sort.parse({"sim_id": "string"}, ["asc:sim_id"]).keys])
        chosen = ["sim_id", *chosen]
    found = latest_page(
        log, entity, ["ts", *tie_breaks], [f for f in JOB_FIELDS if f in used and f not in entity], order,
        ties=[f for f in JOB_FIELDS if f not in entity], heavy=["nodes"], keep=keep if later else None, keep_columns=[f for f in JOB_FIELDS if f in later],
        limit=limit, offset=offset, deep=deep,
    )
    return replace(found, rows=found.rows.select(*chosen))
