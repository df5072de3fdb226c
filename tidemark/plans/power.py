"""Power history of jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fields import expand_fields
from tidemark.operators.spans import Granularity, Segment, data_bounds, extent
from tidemark.plans.series import Series, series_of_all, series_of_run
from tidemark.schemas import JOB_POWER_FIELDS, JOB_POWER_GROUPS


def job_power_series(
    power: DataFrame,
    run: str | None = None,
    job: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    granularity: Granularity = Granularity(width=1),
    fields: str | list[str] | None = None,
    segment: Segment | None = None,
) -> Series:
    """Maximum power per bucket of one job, or of every job when ``run`` and ``job`` are None.

    Missing bounds come from the data of the job itself.
    """
    chosen = expand_fields(fields, JOB_POWER_GROUPS, JOB_POWER_FIELDS)
    if run is None and job is None:
        by = ["sim_id", "job_id"]
        return series_of_all(
            power, extent(power, "ts", by), by, {"power": F.max("power")}, granularity,
            start, end, fields=[f for f in chosen if f not in by], segment=segment,
        )
    own = power.filter((F.col("sim_id") == run) & (F.col("job_id") == job))
    known = None if start and end else data_bounds(own, "ts")
    aggregates = {"power": F.max("power"), "job_id": F.any_value("job_id")}
    return series_of_run(own, aggregates, granularity, known, start, end, fields=chosen, segment=segment)
