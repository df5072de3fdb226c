"""Simulation runs: list, single run, stale runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fields import expand_fields
from tidemark.operators.filters import Filters
from tidemark.operators.lifecycle import last_seen, stale_run_events, with_progress
from tidemark.operators.pages import latest_page
from tidemark.operators.snapshots import latest_state
from tidemark.operators.sorting import Page, Sort
from tidemark.schemas import RUN_FIELDS, RUN_GROUPS, RUN_OPTION_FIELDS, RUN_SORT, RUNS

PROGRESS = ("progress", "progress_date")
_NEWEST = ["ts", "execution_end"]
_PROGRESS_NEEDS = ("start", "end", "execution_start", "execution_end", "progress_date")


def run_states(runs: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Latest state per run; on equal times a row with an end of execution wins."""
    return latest_state(runs, ["id"], _NEWEST, columns)


def list_runs(
    runs: DataFrame,
    series: DataFrame,
    filters: Mapping[str, list[str]] | None = None,
    sort: Sequence[str] | None = None,
    fields: str | list[str] | None = None,
    limit: int = 100,
    offset: int = 0,
) -> Page:
    """A page of runs; ``series`` (with ``sim_id, ts``) is read only if progress is selected.

    A filter on ``state`` sees the resulting state. Filters on other fields choose among a run's
    events first, and the latest of those that pass gives the result. Of several events at a run's newest
    time the one with an end of execution wins, then all other fields but ``config`` decide.
    """
    chosen = list(dict.fromkeys(["id", *expand_fields(fields, RUN_GROUPS, RUN_FIELDS)]))
    wanted = Filters.parse(RUN_OPTION_FIELDS, filters)
    order = Sort.parse(RUN_OPTION_FIELDS, sort, RUN_SORT)
    with_dates = any(f in chosen for f in PROGRESS)

    used = {*chosen, *(k.field for k in order.keys)}
    used |= set(_PROGRESS_NEEDS) if with_dates else set()
    columns = [f for f in RUNS.fieldNames() if f in used and f not in ("id", "ts")]
    log = wanted.apply(runs, {f: F.col(f) for f in RUN_OPTION_FIELDS if f != "state"})
    by_state = bool(wanted.on_field("state"))
    listed = latest_page(
        log, ["id"], _NEWEST, list(dict.fromkeys([*columns, "state"])) if by_state else columns, order,
        ties=[f for f in RUNS.fieldNames() if f not in ("id", "ts")], heavy=["config"], keep=(lambda states: wanted.apply(states, {"state": F.col("state")})) if by_state else None,
        keep_columns=["state"], limit=limit, offset=offset,
    )
    if not with_dates:
        return replace(listed, rows=listed.rows.select(*chosen))

    open_ids = listed.rows.filter(F.col("execution_end").isNull()).select(F.col("id").alias("sim_id"))
    ticks = last_seen(series.join(open_ids, "sim_id", "left_semi"))
    rows = order.apply(with_progress(listed.rows, ticks)).select(*chosen)
    return replace(listed, rows=rows)


def get_run(runs: DataFrame, series: DataFrame, run: str) -> DataFrame:
    """The run of that id with all fields; no row if there is none."""
    return list_runs(runs, series, {"id": [f"eq:{run}"]}, fields="all", limit=1).rows


def stale_runs(
    runs: DataFrame, live: DataFrame, now: datetime, threshold: timedelta = timedelta(minutes=2)
) -> DataFrame:
    """Failure events to append for runs that stopped without saying so."""
    return stale_run_events(run_states(runs), live, now, threshold)
