"""Recorded job histories: the published datasets that can be replayed, their types and their loading."""

from __future__ import annotations

import io
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.arrays import split_ints
from tidemark.functions.times import DEFAULT_EVENT_TIME
from tidemark.operators.lookup import enrich, orphans
from tidemark.operators.spans import Segment
from tidemark.plans.replay import replay_jobs
from tidemark.sources.sinks import SEGMENT, write_segmented
from tidemark.sources.tables import assign_event_time
from tidemark.sources.topics import open_place


@dataclass(frozen=True)
class History:
    """Typed columns of a history table and how it is laid out in time.

    Rows without an event time get the default one, or are dropped if ``timeless`` is False.
    """

    columns: dict[str, str]
    event_time: str
    unit: str
    end: str | None = None
    timeless: bool = True

    @property
    def int_lists(self) -> list[str]:
        return [c for c, kind in self.columns.items() if kind == "array<int>"]

    @property
    def times(self) -> list[str]:
        return [c for c, kind in self.columns.items() if kind == "timestamp"]


def _columns(**kinds: str) -> dict[str, str]:
    types = {"strings": "string", "longs": "long", "doubles": "double", "times": "timestamp", "int_lists": "array<int>"}
    return {name: types[kind] for kind, names in kinds.items() for name in names.split()}


# Columns, event time and segment length of each history.
FUGAKU = History(
    {
        **_columns(
            strings="jid usr jnam jobenv_req pclass",
            times="adt qdt schedsdt deldt sdt edt",
            longs="cnumr cnumat cnumut nnumr ec nnuma nnumu pri freq_req freq_alloc",
            doubles=(
                "elpl idle_time_ave duration perf1 perf2 perf3 perf4 perf5 perf6 mszl econ avgpcon minpcon"
                " maxpcon msza mmszu uctmut sctmut usctmut flops mbwidth opint"
            ),
        ),
        "exit state": "string",
    },
    event_time="sdt", unit="week", end="edt",
)
MARCONI100 = History(
    _columns(
        strings="shared job_state state_reason cores_alloc_layout cores_allocated derived_ec req_nodes",
        times="submit_time start_time end_time eligible_time",
        longs=(
            "num_cores_req time_limit num_tasks partition qos run_time num_nodes_req priority mem_alloc"
            " req_switch cores_per_task num_nodes_alloc group_id user_id job_id num_cores_alloc mem_req"
            " num_gpus_req num_gpus_alloc"
        ),
        int_lists="nodes node_power_consumption mem_power_consumption cpu_power_consumption",
    ),
    event_time="start_time", unit="year", end="end_time",
)
LASSEN_ALLOCATIONS = History(
    _columns(
        longs=(
            "column_1 allocation_id primary_job_id isolated_cores ssd_min ssd_max num_nodes num_processors"
            " num_gpus projected_memory exit_status time_limit"
        ),
        strings=(
            "launch_node_name user_flags system_flags type job_type hashed_user_id hashed_user_group_id queue"
            " requeue smt_mode core_blink"
        ),
        times="begin_time end_time job_submit_time",
    ),
    event_time="begin_time", unit="year", end="end_time",
)
LASSEN_NODES = History(
    _columns(
        longs=(
            "column_1 allocation_id energy gpfs_read gpfs_write ib_tx ib_rx power_cap power_shifting_ratio"
            " power_cap_hit gpu_usage gpu_energy cpu_usage memory_usage_max"
        ),
        strings="node_name shared",
    ),
    event_time="job_begin_time", unit="year", timeless=False,
)
LASSEN_STEPS = History(
    _columns(
        longs=(
            "allocation_id step_id num_nodes num_processors num_gpus num_tasks projected_memory user_flags"
            " exit_status omp_thread_limit"
        ),
        doubles="total_u_time total_s_time",
        times="begin_time end_time",
    ),
    event_time="begin_time", unit="month", end="end_time",
)


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``header`` of the files that have a line; of each file only its beginning is read."""

    def step(batches):
        # Made here, so that workers need not be able to import this package.
        for batch in batches:
            found, headers = [], []
            for file in batch.column(0).to_pylist():
                system, place = open_place(file)
                with system.open_input_stream(place, buffer_size=64 << 10) as stream:
                    line = io.BufferedReader(stream).readline()
                if line:
                    found.append(file)
                    headers.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(headers, pa.string())], ["path", "header"])

    # Without the column of contents, files are listed and not opened.
    listed = spark.read.format("binaryFile").load(path).select("path")
    return listed.mapInArrow(step, "path string, header string")


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with all columns as text, each file's named by its own header; a nameless one is ``column_1``.

    Files may order their columns differently or lack some, which are NULL there. Files with the same
    header are read together; to find them only the first line of each file is read.
    """
    groups = _first_lines(spark, path).groupBy("header").agg(F.collect_list("path").alias("paths")).orderBy("header").collect()
    if not groups:
        return spark.read.option("header", "true").csv(path)
    parts = [
        spark.read.option("header", "true").csv(sorted(group.paths)).withColumnRenamed("_c0", "column_1")
        for group in groups
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load(raw: DataFrame, history: History) -> DataFrame:
    """``ts`` and the typed columns of a history; unreadable values and absent columns are NULL."""
    present = dict(raw.dtypes)

    def typed(name: str, kind: str) -> Column:
        if name not in present:
            return F.lit(None).cast(kind).alias(name)
        col = F.col(f"`{name}`")
        if kind == "array<int>" and present[name] == "string":
            return split_ints(col).alias(name)
        return col.try_cast(kind).alias(name)

    default = DEFAULT_EVENT_TIME if history.timeless else None
    timed = assign_event_time(raw, [history.event_time], "ts", default)
    return timed.select("ts", *[typed(name, kind) for name, kind in history.columns.items()])


def write(table: DataFrame, history: History, path: str) -> None:
    """Append a loaded history to its table, segmented as the history asks for."""
    write_segmented(table, path, "ts", history.unit)


def with_begin_time(
    nodes: DataFrame, allocations: DataFrame, order: Sequence[str] | None = None, check: bool = True
) -> DataFrame:
    """Raw node rows with the ``job_begin_time`` of their allocation, by which they are indexed.

    An unknown allocation is an error. ``order`` says which of repeated allocation rows is the last.
    """
    if check and not orphans(nodes, allocations, "allocation_id").isEmpty():
        raise LookupError("node rows of unknown allocations")
    begins = allocations.withColumn("job_begin_time", F.col("begin_time"))
    return enrich(nodes, begins, "allocation_id", ["job_begin_time"], order)


def replay(table: DataFrame, history: History, start: datetime, end: datetime, **options) -> DataFrame:
    """Jobs of a stored history that meet the range; see ``replay_jobs`` for the options."""
    if history.end is None:
        raise ValueError("this history has no end times; read it with replay_nodes")
    segment = Segment(history.unit) if SEGMENT in table.columns else None
    return replay_jobs(table, start, end, history.event_time, history.end, segment=segment, **options)
