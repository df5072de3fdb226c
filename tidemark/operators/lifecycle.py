"""Run life cycle: progress, completion events and the sweep for runs that died silently."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import instant, micros, parse_instant

# Fixed value: the message of a run that was found dead.
CRASH_MESSAGE = "Simulation crashed"


def last_seen(series: DataFrame, run: str = "sim_id", ts: str = "ts") -> DataFrame:
    """Newest tick per run as ``id, last_tick``; combined map-side."""
    return series.groupBy(F.col(run).alias("id")).agg(F.max(ts).alias("last_tick"))


def with_progress(runs: DataFrame, ticks: DataFrame) -> DataFrame:
    """``progress`` and ``progress_date`` of each run; ``ticks`` has one row per run (``last_seen``).

    An unfinished run counts up to its newest tick but never reaches 1; a finished one counts up to
    its stored progress date. A run of zero length has no progress value.
    """
    joined = runs.join(ticks, "id", "left")
    start, end = micros(F.col("start")), micros(F.col("end"))
    length = F.nullif(end - start, F.lit(0))
    finished = F.col("execution_end").isNotNull()
    seen = F.col("last_tick").isNotNull()

    def share(at: str) -> Column:
        return F.round((micros(F.col(at)) - start) / length, 3)

    # greatest/least would skip the NULL of a zero-length run.
    running = F.when(length.isNotNull(), F.greatest(F.lit(0.0), F.least(share("last_tick"), F.lit(0.99))))
    progress = (
        F.when(finished, share("progress_date")).when(seen, running).otherwise(F.lit(0.0))
    )
    before_end = F.col("end") - F.expr("interval 1 second")
    date = (
        F.when(finished, F.col("progress_date"))
        .when(seen, F.least(F.col("last_tick"), before_end))
        .otherwise(F.col("start"))
    )
    return joined.select(
        *[c for c in runs.columns if c not in ("progress", "progress_date")],
        progress.alias("progress"),
        date.alias("progress_date"),
    )


def completion_events(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows to append to the runs log when runs end.

    ``outcomes`` has ``id, ended_at, error, last_tick``; without an error the run is a success that
    got to its end, with one it failed and got as far as its last tick (or nowhere).
    """
    ok = F.col("error").isNull()
    changed = {
        "ts": F.col("ended_at"),
        "state": F.when(ok, F.lit("success")).otherwise(F.lit("fail")),
        "error_messages": F.when(ok, F.col("error_messages")).otherwise(F.col("error")),
        "execution_end": F.col("ended_at"),
        "progress_date": F.when(ok, F.col("end")).otherwise(F.coalesce("last_tick", "start")),
    }
    return runs.join(outcomes, "id").select(
        *[changed.get(c, F.col(c)).alias(c) for c in runs.columns]
    )


def stale_run_events(
    state: DataFrame, live: DataFrame, now: datetime, threshold: timedelta = timedelta(minutes=2)
) -> DataFrame:
    """Failure rows for runs still marked running, not in ``live`` and older than the threshold.

    ``state`` is the latest state per run, ``live`` the ids known to be alive.
    """
    stuck = state.filter(
        (F.col("state") == "running")
        & (F.col("execution_start") < instant(parse_instant(now) - threshold))
    ).join(live.select("id").distinct(), "id", "left_anti")
    at = instant(now)
    changed = {
        "ts": at.cast(state.schema["ts"].dataType),
        "state": F.lit("fail"),
        "error_messages": F.lit(CRASH_MESSAGE),
        "execution_end": at.cast(state.schema["execution_end"].dataType),
    }
    return stuck.select(*[changed.get(c, F.col(c)).alias(c) for c in state.columns])
