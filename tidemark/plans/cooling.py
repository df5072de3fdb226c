"""Cooling series: per distribution unit, and of the central plant."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.fields import expand_fields
from tidemark.operators.filters import Filters
from tidemark.operators.rollup import maxima
from tidemark.operators.spans import Granularity, Segment
from tidemark.plans.series import Series, run_series
from tidemark.schemas import CDU_FIELDS, CDU_GROUPS, CDU_MEASURES, CEP_GROUPS, CEP_MEASURES


def cdu_series(
    cdus: DataFrame,
    runs: DataFrame,
    run: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    granularity: Granularity = Granularity(width=1),
    fields: str | list[str] | None = None,
    filters: Mapping[str, list[str]] | None = None,
    segment: Segment | None = None,
) -> Series:
    """Maxima per bucket and unit, ordered by time and unit name."""
    aggregates = {**maxima(CDU_MEASURES), "row": F.any_value("row"), "col": F.any_value("col")}
    return run_series(
        cdus, runs, run, aggregates, granularity,
        start=start, end=end, dims=["name"],
        fields=expand_fields(fields, CDU_GROUPS),
        filters=Filters.parse(CDU_FIELDS, filters),
        segment=segment,
    )


def cep_series(
    cep: DataFrame,
    runs: DataFrame,
    run: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    granularity: Granularity = Granularity(resolution=1),
    fields: str | list[str] | None = None,
    segment: Segment | None = None,
) -> Series:
    """Maxima per bucket; by default one bucket over the whole run."""
    return run_series(
        cep, runs, run, maxima(CEP_MEASURES), granularity,
        start=start, end=end, fields=expand_fields(fields, CEP_GROUPS), segment=segment,
    )
