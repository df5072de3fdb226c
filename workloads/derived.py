"""Telemetry-shaped tables derived from the test tables, in Spark and in SQL.

Every row of the source gives one or two rows here, so the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import CDU_MEASURES, CEP_MEASURES, SYSTEM_MEASURES
from workloads.registry import Tables


def text(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


# --- runs: an order is a run; F runs succeed, P runs fail, O runs are still going ---------------

RUNS_SQL = """
    SELECT o_orderdate AS ts, 'run-' || o_orderkey AS id, 'user-' || o_custkey AS user,
           o_orderpriority AS system, 'running' AS state, NULL::VARCHAR AS error_messages,
           o_orderdate AS start, o_orderdate + to_days((10 + o_custkey % 90)::INT) AS "end",
           o_orderdate AS execution_start, NULL::TIMESTAMP AS execution_end,
           NULL::TIMESTAMP AS progress_date, '{"customer": ' || o_custkey || '}' AS config
    FROM orders
    UNION ALL
    SELECT o_orderdate + INTERVAL 2 DAY, 'run-' || o_orderkey, 'user-' || o_custkey,
           o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'success' ELSE 'fail' END,
           CASE o_orderstatus WHEN 'P' THEN 'node failure' END,
           o_orderdate, o_orderdate + to_days((10 + o_custkey % 90)::INT),
           o_orderdate, o_orderdate + INTERVAL 2 DAY,
           CASE o_orderstatus WHEN 'F' THEN o_orderdate + to_days((10 + o_custkey % 90)::INT)
                ELSE o_orderdate + INTERVAL 5 DAY END, '{"customer": ' || o_custkey || '}'
    FROM orders WHERE o_orderstatus <> 'O'
"""

STARTED_RUNS_SQL = RUNS_SQL.partition("UNION ALL")[0]

#: Latest state per run.
RUN_STATES_SQL = f"""
    SELECT * FROM ({RUNS_SQL})
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, execution_end DESC NULLS LAST) = 1
"""


def started_runs(t: Tables) -> DataFrame:
    """The event each run starts with."""
    start = F.col("o_orderdate")
    nothing = F.lit(None)
    return t.orders.select(
        start.alias("ts"),
        text("run-", "o_orderkey").alias("id"),
        text("user-", "o_custkey").alias("user"),
        F.col("o_orderpriority").alias("system"),
        F.lit("running").alias("state"),
        nothing.cast("string").alias("error_messages"),
        start.alias("start"),
        (start + F.make_dt_interval(days=(F.lit(10) + F.col("o_custkey") % 90).cast("int"))).alias("end"),
        start.alias("execution_start"),
        nothing.cast("timestamp_ntz").alias("execution_end"),
        nothing.cast("timestamp_ntz").alias("progress_date"),
        F.concat(F.lit('{"customer": '), F.col("o_custkey").cast("string"), F.lit("}")).alias("config"),
        F.col("o_orderstatus").alias("outcome"),
    )


def runs(t: Tables) -> DataFrame:
    """Start and completion events of all runs."""
    first = started_runs(t)
    done = F.col("ts") + F.expr("interval 2 days")
    good = F.col("outcome") == "F"
    changed = {
        "ts": done,
        "state": F.when(good, F.lit("success")).otherwise(F.lit("fail")),
        "error_messages": F.when(~good, F.lit("node failure")),
        "execution_end": done,
        "progress_date": F.when(good, F.col("end")).otherwise(F.col("start") + F.expr("interval 5 days")),
    }
    columns = [c for c in first.columns if c != "outcome"]
    last = first.filter(F.col("outcome") != "O").select(
        *[changed.get(c, F.col(c)).alias(c) for c in columns]
    )
    return first.select(*columns).unionByName(last)


# --- ticks of those runs: a line item is a tick --------------------------------------------------

TICKS_SQL = "SELECT 'run-' || l_orderkey AS sim_id, l_shipdate AS ts FROM lineitem"


def ticks(t: Tables) -> DataFrame:
    return t.lineitem.select(text("run-", "l_orderkey").alias("sim_id"), F.col("l_shipdate").alias("ts"))


# --- three big simulations: all line items of one return flag ------------------------------------

SIM_TS_SQL = "l_shipdate + to_seconds(l_linenumber * 600)"


def sim_ts():
    return F.expr("l_shipdate + interval '10' minute * l_linenumber")


SIMS_SQL = f"""
    SELECT min({SIM_TS_SQL}) AS ts, 'sim-' || l_returnflag AS id,
           min({SIM_TS_SQL}) + INTERVAL 12345678 SECOND AS start, max({SIM_TS_SQL}) AS "end"
    FROM lineitem GROUP BY l_returnflag
"""


def sims(t: Tables) -> DataFrame:
    """Declared spans of those simulations (they leave out the first 143 days of data)."""
    return t.lineitem.groupBy(text("sim-", "l_returnflag").alias("id")).agg(
        F.min(sim_ts()).alias("ts"),
        (F.min(sim_ts()) + F.expr("interval 12345678 seconds")).alias("start"),
        F.max(sim_ts()).alias("end"),
    )


_SOURCES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _measures(names):
    """Each measure repeats one of four source columns plus its own number."""
    return [(name, _SOURCES[i % 4], i) for i, name in enumerate(names)]


def _measures_sql(names) -> str:
    return ", ".join(f"{source} + {i} AS {name}" for name, source, i in _measures(names))


def _measure_columns(names):
    return [(F.col(source) + i).alias(name) for name, source, i in _measures(names)]


CDUS_SQL = f"""
    SELECT {SIM_TS_SQL} AS ts, 'sim-' || l_returnflag AS sim_id, 'x' || l_suppkey % 25 AS name,
           l_suppkey % 25 // 5 AS row, l_suppkey % 25 % 5 AS col, {_measures_sql(CDU_MEASURES)}
    FROM lineitem
"""


def cdus(t: Tables) -> DataFrame:
    unit = F.col("l_suppkey") % 25
    return t.lineitem.select(
        sim_ts().alias("ts"),
        text("sim-", "l_returnflag").alias("sim_id"),
        F.concat(F.lit("x"), unit.cast("string")).alias("name"),
        F.floor(unit / 5).cast("long").alias("row"),
        (unit % 5).alias("col"),
        *_measure_columns(CDU_MEASURES),
    )


CEP_SQL = f"""
    SELECT {SIM_TS_SQL} AS ts, 'sim-' || l_returnflag AS sim_id, {_measures_sql(CEP_MEASURES)}
    FROM lineitem
"""


def cep(t: Tables) -> DataFrame:
    return t.lineitem.select(
        sim_ts().alias("ts"), text("sim-", "l_returnflag").alias("sim_id"), *_measure_columns(CEP_MEASURES)
    )


#: Tie-breaks under which equal rows are wholly equal.
SYSTEM_TIES = ("num_samples", "jobs_completed", "jobs_running", "throughput", "average_power", "min_loss", "average_loss")

SYSTEM_SQL = f"""
    SELECT {SIM_TS_SQL} AS ts, 'sim-' || l_returnflag AS sim_id,
           ['n' || l_linenumber, 'n' || l_suppkey] AS down_nodes, l_partkey AS num_samples,
           l_suppkey AS jobs_completed, l_orderkey AS jobs_running,
           CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber::BIGINT END AS jobs_pending,
           {_measures_sql(SYSTEM_MEASURES)}
    FROM lineitem
"""


def system(t: Tables) -> DataFrame:
    number = F.col("l_linenumber")
    return t.lineitem.select(
        sim_ts().alias("ts"),
        text("sim-", "l_returnflag").alias("sim_id"),
        F.array(text("n", "l_linenumber"), text("n", "l_suppkey")).alias("down_nodes"),
        F.col("l_partkey").alias("num_samples"),
        F.col("l_suppkey").alias("jobs_completed"),
        F.col("l_orderkey").alias("jobs_running"),
        F.when(number % 2 == 0, number.cast("long")).alias("jobs_pending"),
        *_measure_columns(SYSTEM_MEASURES),
    )


# --- job snapshots in those simulations: an order key is a job, a line item a snapshot -----------

#: Tie-breaks under which equal snapshots differ in their nodes at most.
JOB_TIES = ("time_limit", "node_count", "state_current")

JOBS_SQL = f"""
    SELECT {SIM_TS_SQL} AS ts, 'sim-' || l_returnflag AS sim_id, 'job-' || l_orderkey AS job_id,
           'name-' || l_orderkey % 100 AS name, l_quantity::BIGINT AS node_count,
           l_shipdate - INTERVAL 3 DAY AS time_submission, l_linenumber * 3600::BIGINT AS time_limit,
           CASE WHEN l_linenumber > 1 THEN l_shipdate - INTERVAL 1 DAY END AS time_start,
           CASE WHEN l_linestatus = 'F' AND l_linenumber > 1
                THEN l_shipdate + to_days(l_linenumber) END AS time_end,
           CASE WHEN l_linenumber = 1 THEN 'PENDING' WHEN l_linestatus = 'F' THEN 'COMPLETED'
                ELSE 'RUNNING' END AS state_current,
           CASE WHEN l_linenumber > 1 THEN ['n' || l_suppkey, 'n' || l_partkey % 10] END AS nodes
    FROM lineitem
"""


def jobs(t: Tables) -> DataFrame:
    number, ship = F.col("l_linenumber"), F.col("l_shipdate")
    started, ended = number > 1, F.col("l_linestatus") == "F"
    return t.lineitem.select(
        sim_ts().alias("ts"),
        text("sim-", "l_returnflag").alias("sim_id"),
        text("job-", "l_orderkey").alias("job_id"),
        F.concat(F.lit("name-"), (F.col("l_orderkey") % 100).cast("string")).alias("name"),
        F.col("l_quantity").cast("long").alias("node_count"),
        (ship - F.expr("interval 3 days")).alias("time_submission"),
        (number * 3600).cast("long").alias("time_limit"),
        F.when(started, ship - F.expr("interval 1 day")).alias("time_start"),
        F.when(started & ended, ship + F.make_dt_interval(days=number)).alias("time_end"),
        F.when(~started, "PENDING").when(ended, "COMPLETED").otherwise("RUNNING").alias("state_current"),
        F.when(
            started,
            F.array(text("n", "l_suppkey"), F.concat(F.lit("n"), (F.col("l_partkey") % 10).cast("string"))),
        ).alias("nodes"),
    )


# --- power samples: an event is a sample of its user's job in the simulation of its type ---------

POWER_SQL = """
    SELECT ts, 'sim-' || event_type AS sim_id, 'job-' || user_id AS job_id, value AS power FROM events
"""


def power(t: Tables) -> DataFrame:
    return t.events.select(
        "ts",
        text("sim-", "event_type").alias("sim_id"),
        text("job-", "user_id").alias("job_id"),
        F.col("value").alias("power"),
    )
