"""Table schemas and the API field catalogues that say what can be filtered, sorted and selected."""

from __future__ import annotations

from pyspark.sql import types as T

TS = T.StructField("ts", T.TimestampType())


def _fields(names: str, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names.split()]


# Table columns, in their stored order.
CDU_POWER = "rack_1_power rack_2_power rack_3_power total_power"
CDU_LOSS = "rack_1_loss rack_2_loss rack_3_loss total_loss"
CDU_COOLING = (
    "work_done_by_cdup rack_return_temp rack_supply_temp rack_supply_pressure"
    " rack_return_pressure rack_flowrate facility_return_temp facility_supply_temp"
    " facility_supply_pressure facility_return_pressure facility_flowrate"
)
CDU_MEASURES = f"{CDU_POWER} {CDU_LOSS} {CDU_COOLING}".split()
CEP_MEASURES = (
    "htw_flowrate ctw_flowrate htw_return_pressure htw_supply_pressure ctw_return_pressure"
    " ctw_supply_pressure htw_return_temp htw_supply_temp ctw_return_temp ctw_supply_temp"
    " power_consumption_htwps power_consumption_ctwps power_consumption_fan htwp_speed"
    " nctwps_staged nhtwps_staged pue_output nehxs_staged ncts_staged facility_return_temp"
    " cdu_loop_bypass_flowrate"
).split()
SYSTEM_COUNTS = "num_samples jobs_completed jobs_running jobs_pending".split()
SYSTEM_MEASURES = (
    "throughput average_power min_loss average_loss max_loss system_power_efficiency"
    " total_energy_consumed carbon_emissions total_cost p_flops g_flops_w system_util"
).split()

# Allowed states.
RUN_STATES = ("running", "success", "fail")
JOB_STATES = ("COMPLETED", "PENDING", "RUNNING", "CANCELLED", "FAILED", "TIMEOUT")

RUNS = T.StructType(
    [TS]
    + _fields("id user system state error_messages", T.StringType())
    + _fields("start end execution_start execution_end progress_date", T.TimestampType())
    + _fields("config", T.StringType())
)

JOBS = T.StructType(
    [TS]
    + _fields("sim_id job_id name", T.StringType())
    + _fields("node_count", T.LongType())
    + _fields("time_submission", T.TimestampType())
    + _fields("time_limit", T.LongType())
    + _fields("time_start time_end", T.TimestampType())
    + _fields("state_current", T.StringType())
    + _fields("nodes", T.ArrayType(T.StringType()))
)

CDUS = T.StructType(
    [TS]
    + _fields("sim_id name", T.StringType())
    + _fields("row col", T.LongType())
    + _fields(" ".join(CDU_MEASURES), T.DoubleType())
)

CEP = T.StructType([TS] + _fields("sim_id", T.StringType()) + _fields(" ".join(CEP_MEASURES), T.DoubleType()))

JOB_POWER = T.StructType(
    [TS] + _fields("sim_id job_id", T.StringType()) + _fields("power", T.DoubleType())
)

SYSTEM = T.StructType(
    [TS]
    + _fields("sim_id", T.StringType())
    + _fields("down_nodes", T.ArrayType(T.StringType()))
    + _fields(" ".join(SYSTEM_COUNTS), T.LongType())
    + _fields(" ".join(SYSTEM_MEASURES), T.DoubleType())
)

TABLES = {
    "runs": RUNS,
    "jobs": JOBS,
    "cdus": CDUS,
    "cep": CEP,
    "job_power": JOB_POWER,
    "system": SYSTEM,
}

#: JSON field that carries the event time of each streamed table.
EVENT_TIME_FIELD = {
    "runs": "timestamp",
    "jobs": "time_snapshot",
    "cdus": "timestamp",
    "cep": "timestamp",
    "job_power": "timestamp",
    "system": "timestamp",
}

# API field types and field groups.
RUN_FIELDS = {
    **dict.fromkeys("id user system state error_messages".split(), "string"),
    **dict.fromkeys("start end execution_start execution_end progress_date".split(), "date"),
    "progress": "number",
    "config": "string",
}
RUN_GROUPS = {
    "default": (
        "user system state error_messages start end execution_start execution_end"
        " progress progress_date"
    ).split(),
    "all": ["default", "config"],
}
_RUN_COMPUTED = ("progress", "progress_date", "config")
RUN_OPTION_FIELDS = {f: t for f, t in RUN_FIELDS.items() if f not in _RUN_COMPUTED}
RUN_SORT = ["asc:execution_start", "asc:execution_end", "asc:start", "asc:end", "asc:id"]

JOB_FIELDS = {
    "job_id": "string",
    "name": "string",
    "node_count": "number",
    "time_snapshot": "date",
    "time_submission": "date",
    "time_limit": "timedelta",
    "time_start": "date",
    "time_end": "date",
    "state_current": "string",
    "nodes": "array[string]",
}
JOB_GROUPS = {"default": list(JOB_FIELDS)}
JOB_OPTION_FIELDS = {f: t for f, t in JOB_FIELDS.items() if f not in ("time_snapshot", "nodes")}
JOB_SORT = ["asc:time_start", "asc:time_end", "asc:job_id"]

JOB_POWER_FIELDS = {"job_id": "string", "power": "number"}
JOB_POWER_GROUPS = {"default": ["power"], "all": ["job_id", "power"]}

CDU_FIELDS = {"name": "string", "row": "number", "col": "number", **dict.fromkeys(CDU_MEASURES, "number")}
CDU_GROUPS = {"default": list(CDU_FIELDS), "pos": ["row", "col"]}

CEP_FIELDS = dict.fromkeys(CEP_MEASURES, "number")
CEP_GROUPS = {"default": list(CEP_FIELDS)}
