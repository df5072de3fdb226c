"""Event-log queries: state, history, changes, life cycle, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.times import parse_instant
from tidemark.operators.changes import change_only, job_fingerprint, mask_future_end, new_samples_only
from tidemark.operators.deep import deep_page
from tidemark.operators.lifecycle import completion_events, last_seen, with_progress
from tidemark.operators.overlap import active_between
from tidemark.operators.snapshots import as_of, earliest_state, latest_state
from tidemark.operators.sorting import Sort, page as take_page
from tidemark.plans.jobs import jobs as list_jobs
from tidemark.plans.runs import get_run as find_run
from tidemark.plans.runs import list_runs as find_runs
from tidemark.plans.runs import run_states, stale_runs as sweep
from workloads import derived
from workloads.registry import Tables, query

STATE = ["ts", "event_id", "event_type", "value"]
NEWEST = "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query(f"SELECT user_id, ts, event_id, event_type, value FROM events {NEWEST}", name="latest_state")
def latest_state_query(t: Tables):
    return latest_state(t.events, ["user_id"], ["ts", "event_id"], STATE)


@query("""
    SELECT user_id, event_type, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) = 1
""")
def latest_by_other_col(t: Tables):
    return latest_state(t.events, ["user_id"], ["value", "event_id"], ["event_type", "event_id"])


@query("""
    SELECT user_id, ts, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
""")
def earliest_value(t: Tables):
    return earliest_state(t.events, ["user_id"], ["ts", "event_id"], STATE)


@query(f"""
    SELECT * FROM (SELECT user_id, ts, event_id, event_type, value FROM events WHERE value > 5 {NEWEST})
    WHERE event_type = 'error'
""")
def latest_state_having(t: Tables):
    """A filter on rows before, one on the resulting state after."""
    return latest_state(t.events.filter("value > 5"), ["user_id"], ["ts", "event_id"], STATE).filter(
        "event_type = 'error'"
    )


@query(f"""
    SELECT user_id, ts, event_id, event_type, value FROM events
    WHERE ts <= TIMESTAMP '2024-01-12 08:30:00' {NEWEST}
""")
def time_travel(t: Tables):
    past = as_of(t.events, parse_instant("2024-01-12T08:30:00Z"))
    return latest_state(past, ["user_id"], ["ts", "event_id"], STATE)


JOB_COLUMNS = "job_id, name, node_count, ts AS time_snapshot, time_submission, time_limit, time_start, time_end, state_current, nodes"
JOB_NEWEST = """
    QUALIFY row_number() OVER (PARTITION BY sim_id, job_id ORDER BY ts DESC, time_limit DESC,
        node_count DESC, state_current DESC, nodes DESC NULLS LAST) = 1
"""
JOB_ORDER = "time_start NULLS FIRST, time_end NULLS FIRST, job_id, sim_id"


@query(f"""
    SELECT sim_id, {JOB_COLUMNS} FROM ({derived.JOBS_SQL})
    WHERE ts >= TIMESTAMP '1998-01-01' AND (time_end IS NULL OR time_end > TIMESTAMP '1998-01-01')
      AND time_submission < TIMESTAMP '1999-07-01'
    {JOB_NEWEST}
""")
def jobs_in_interval(t: Tables):
    """Latest state of all jobs active in 18 months."""
    active = active_between(derived.jobs(t), parse_instant("1998-01-01"), parse_instant("1999-07-01"))
    state = latest_state(active, ["sim_id", "job_id"], ["ts", *derived.JOB_TIES])
    return state.withColumnRenamed("ts", "time_snapshot")


@query(f"""
    SELECT * FROM (
        SELECT sim_id, {JOB_COLUMNS} FROM ({derived.JOBS_SQL}) WHERE ts <= TIMESTAMP '1998-09-01' {JOB_NEWEST})
    WHERE (time_end IS NULL OR time_end > TIMESTAMP '1998-06-01') AND time_submission < TIMESTAMP '1998-09-01'
    ORDER BY {JOB_ORDER} LIMIT 100
""")
def jobs_strict_interval(t: Tables):
    """First page of the jobs active in a quarter, by their latest state up to its end."""
    return list_jobs(
        derived.jobs(t), start=parse_instant("1998-06-01"), end=parse_instant("1998-09-01"), tie_breaks=derived.JOB_TIES
    ).rows


@query(f"""
    SELECT sim_id, {JOB_COLUMNS} FROM ({derived.JOBS_SQL})
    WHERE ts >= TIMESTAMP '1998-06-01' AND (time_end IS NULL OR time_end > TIMESTAMP '1998-06-01')
      AND time_submission < TIMESTAMP '1998-09-01'
    {JOB_NEWEST} ORDER BY {JOB_ORDER} LIMIT 100
""")
def jobs_seen_in_interval(t: Tables):
    """The same by snapshots from the quarter's begin on alone."""
    return list_jobs(
        derived.jobs(t), start=parse_instant("1998-06-01"), end=parse_instant("1998-09-01"),
        tie_breaks=derived.JOB_TIES, strict_overlap=False,
    ).rows


@query(f"""
    SELECT * FROM (
        SELECT sim_id, {JOB_COLUMNS} FROM ({derived.JOBS_SQL})
        WHERE ts <= TIMESTAMP '2000-06-01' AND node_count >= 3 AND time_limit > 5400 {JOB_NEWEST})
    WHERE state_current IN ('RUNNING', 'COMPLETED')
    ORDER BY node_count DESC, {JOB_ORDER} LIMIT 100 OFFSET 50
""")
def jobs_page(t: Tables):
    """Third half-page of a filtered, time-travelled job list."""
    return list_jobs(
        derived.jobs(t),
        time_travel=parse_instant("2000-06-01"),
        filters={"node_count": ["gte:3"], "time_limit": ["gt:PT1H30M"], "state_current": ["one_of:RUNNING,COMPLETED"]},
        sort=["desc:node_count"],
        offset=50,
        tie_breaks=derived.JOB_TIES,
    ).rows


def _running_jobs(t: Tables, strict: bool):
    return list_jobs(
        derived.jobs(t), start=parse_instant("1998-01-01"), filters={"state_current": ["eq:RUNNING"]},
        tie_breaks=derived.JOB_TIES, strict_overlap=strict,
    )


@query(f"""
    SELECT count(*) AS total FROM (SELECT * FROM ({derived.JOBS_SQL}) {JOB_NEWEST})
    WHERE state_current = 'RUNNING' AND (time_end IS NULL OR time_end > TIMESTAMP '1998-01-01')
""")
def page_total(t: Tables):
    """Exact number of matches of a job list, by the jobs' latest states."""
    return _running_jobs(t, strict=True).total_rows()


@query(f"""
    SELECT count(*) AS total FROM (SELECT * FROM ({derived.JOBS_SQL})
        WHERE ts >= TIMESTAMP '1998-01-01' AND (time_end IS NULL OR time_end > TIMESTAMP '1998-01-01') {JOB_NEWEST})
    WHERE state_current = 'RUNNING'
""")
def page_total_seen(t: Tables):
    """The same by snapshots from the interval alone."""
    return _running_jobs(t, strict=False).total_rows()


#: Each snapshot comes in three versions at the same time, which differ in fields a selection may leave out.
_TIED_SQL = f"""
    SELECT * REPLACE (CASE version WHEN 0 THEN state_current WHEN 1 THEN 'CANCELLED' ELSE 'TIMEOUT' END AS state_current,
                      node_count % 7 + version % 2 AS node_count)
    FROM ({derived.JOBS_SQL}), (SELECT unnest([0, 1, 2]) AS version)
"""
#: The default tie-break, then every field in the catalog's order.
_TIED_NEWEST = """
    QUALIFY row_number() OVER (PARTITION BY sim_id, job_id ORDER BY ts DESC, time_end DESC NULLS LAST, name DESC,
        node_count DESC, time_submission DESC, time_limit DESC, time_start DESC NULLS LAST, state_current DESC) = 1
"""


def tied_jobs(t: Tables):
    log = derived.jobs(t).withColumn("version", F.explode(F.array(*map(F.lit, range(3)))))
    state = F.when(F.col("version") == 0, F.col("state_current")).when(F.col("version") == 1, "CANCELLED").otherwise("TIMEOUT")
    return log.withColumns({"state_current": state, "node_count": F.col("node_count") % 7 + F.col("version") % 2}).drop("version")


@query(f"""
    SELECT sim_id, job_id, state_current FROM (SELECT * FROM ({_TIED_SQL}) {_TIED_NEWEST})
    WHERE state_current IN ('CANCELLED', 'TIMEOUT') ORDER BY {JOB_ORDER} LIMIT 1000
""")
def jobs_tied_page(t: Tables):
    """Which of several newest snapshots counts does not depend on the two fields that are selected."""
    return list_jobs(
        tied_jobs(t), filters={"state_current": ["one_of:CANCELLED,TIMEOUT"]}, fields="job_id,state_current", limit=1000
    ).rows


@query(f"""
    SELECT count(*) AS total FROM (SELECT * FROM ({_TIED_SQL}) {_TIED_NEWEST}) WHERE state_current = 'CANCELLED'
""")
def jobs_tied_total(t: Tables):
    """The total of a page that selects neither the tied fields nor the filtered one."""
    return list_jobs(tied_jobs(t), filters={"state_current": ["eq:CANCELLED"]}, fields="job_id").total_rows()


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
    ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 250
""")
def page(t: Tables):
    """Sorted by a column and cut to a page; the key is a top-k, not a full sort."""
    fields = {"o_orderkey": "number", "o_totalprice": "number", "o_orderpriority": "string"}
    sort = Sort.parse(fields, ["desc:o_orderpriority", "desc:o_totalprice"], ["asc:o_orderkey"])
    return take_page(
        t.orders, sort, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"], 100, 250
    ).rows


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
    ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey
    LIMIT 100 OFFSET (SELECT 2 * count(*) // 3 FROM orders)
""")
def page_far_down(t: Tables):
    """A page behind two thirds of all rows, located by counts: a value with a fifth of the rows is divided by the next key."""
    fields = {"o_orderkey": "number", "o_totalprice": "number", "o_orderpriority": "string"}
    sort = Sort.parse(fields, ["desc:o_orderpriority", "desc:o_totalprice"], ["asc:o_orderkey"])
    offset = 2 * t.orders.count() // 3
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    return deep_page(t.orders, sort, columns, 100, offset, small=1000).rows


PROGRESS_SQL = f"""
    SELECT s.* EXCLUDE (progress_date),
           CASE WHEN execution_end IS NOT NULL THEN round((epoch_us(progress_date) - epoch_us(start)) / (epoch_us("end") - epoch_us(start)), 3)
                WHEN last_tick IS NOT NULL THEN greatest(0.0, least(0.99, round((epoch_us(last_tick) - epoch_us(start)) / (epoch_us("end") - epoch_us(start)), 3)))
                ELSE 0.0 END AS progress,
           CASE WHEN execution_end IS NOT NULL THEN progress_date
                WHEN last_tick IS NOT NULL THEN least(last_tick, "end" - INTERVAL 1 SECOND)
                ELSE start END AS progress_date
    FROM ({derived.RUN_STATES_SQL}) s
    LEFT JOIN (SELECT sim_id, max(ts) AS last_tick FROM ({derived.TICKS_SQL}) GROUP BY 1) ON id = sim_id
"""


@query(PROGRESS_SQL)
def run_progress(t: Tables):
    """Progress of every run."""
    return with_progress(run_states(derived.runs(t)), last_seen(derived.ticks(t)))


@query(f"""
    SELECT id, "user", system, state, error_messages, start, "end", execution_start, execution_end, progress, progress_date, config
    FROM ({PROGRESS_SQL}) WHERE system <> '3-MEDIUM'
    ORDER BY system, execution_start, execution_end NULLS FIRST, start, "end", id LIMIT 100 OFFSET 30
""")
def list_runs(t: Tables):
    return find_runs(
        derived.runs(t), derived.ticks(t),
        filters={"system": ["neq:3-MEDIUM"]}, sort=["asc:system"], fields="all", offset=30,
    ).rows


@query(f"""
    SELECT id, "user", system, state, error_messages, start, "end", execution_start, execution_end, progress, progress_date, config
    FROM ({PROGRESS_SQL}) WHERE id = 'run-7'
""")
def get_run(t: Tables):
    """Point lookup by id, the query's purpose."""
    return find_run(derived.runs(t), derived.ticks(t), "run-7")


@query(f"""
    WITH started AS ({derived.STARTED_RUNS_SQL}),
    done AS (SELECT 'run-' || l_orderkey AS id, max(l_shipdate) AS last_tick,
                    CASE WHEN min(l_linestatus) = 'F' THEN 'lost contact' END AS error
             FROM lineitem GROUP BY 1)
    SELECT s.* EXCLUDE (ts) REPLACE (CASE WHEN d.id IS NULL THEN s.state WHEN error IS NULL THEN 'success' ELSE 'fail' END AS state,
                        error AS error_messages,
                        CASE WHEN d.id IS NULL THEN NULL ELSE s.ts + INTERVAL 90 DAY END AS execution_end,
                        CASE WHEN d.id IS NULL THEN NULL WHEN error IS NULL THEN "end" ELSE last_tick END AS progress_date)
    FROM started s LEFT JOIN done d USING (id)
""")
def lifecycle_latest(t: Tables):
    """Completion events appended to the start events, read back as latest state."""
    started = derived.started_runs(t).drop("outcome")
    ended = t.lineitem.groupBy(derived.text("run-", "l_orderkey").alias("id")).agg(
        F.max("l_shipdate").alias("last_tick"),
        F.when(F.min("l_linestatus") == "F", F.lit("lost contact")).alias("error"),
    )
    outcomes = ended.join(
        started.select("id", (F.col("ts") + F.expr("interval 90 days")).alias("ended_at")), "id"
    )
    log = started.unionByName(completion_events(started, outcomes))
    return run_states(log).drop("ts")


@query(f"""
    SELECT s.* REPLACE ('fail' AS state, 'Simulation crashed' AS error_messages,
                        TIMESTAMP '2001-07-15 00:01:00' AS ts, TIMESTAMP '2001-07-15 00:01:00' AS execution_end)
    FROM ({derived.RUN_STATES_SQL}) s
    WHERE state = 'running' AND execution_start < TIMESTAMP '2001-07-14 23:59:00'
      AND id NOT IN (SELECT 'run-' || l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01')
""")
def stale_runs(t: Tables):
    """Failure events for runs that are neither finished nor alive (a recent tick is a sign of life)."""
    alive = derived.ticks(t).filter("ts >= timestamp_ntz '2000-01-01 00:00:00'")
    return sweep(derived.runs(t), alive.select(F.col("sim_id").alias("id")), parse_instant("2001-07-15T00:01:00Z"))


@query("""
    SELECT event_id, user_id, ts, event_type, value FROM events
    QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type
         OR event_type = 'purchase' OR ts = max(ts) OVER (PARTITION BY user_id)
""", name="change_only")
def change_only_query(t: Tables):
    """Events that change their user's type, all purchases, and each user's last event."""
    events = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    return change_only(
        events, ["user_id"], ["ts", "event_id"], F.col("event_type"),
        always=F.col("event_type") == "purchase", run=["user_id"], target_rows=100_000,
    )


@query(f"""
    WITH j AS (SELECT *, CASE WHEN state_current <> 'PENDING' THEN
                   struct_pack(a := name, b := node_count, c := time_submission, d := time_limit, e := time_start,
                               f := time_end, g := state_current, h := len(nodes))::VARCHAR END AS mark
               FROM ({derived.JOBS_SQL}))
    SELECT sim_id, job_id, ts, state_current, node_count, time_limit FROM (
        SELECT *, lag(mark) OVER w AS before, row_number() OVER w AS rn FROM j
        WINDOW w AS (PARTITION BY sim_id, job_id ORDER BY ts, time_limit, node_count, state_current, nodes NULLS FIRST))
    WHERE rn = 1 OR mark IS DISTINCT FROM before OR state_current = 'COMPLETED'
""")
def job_changes(t: Tables):
    """Job snapshots that change the job's fingerprint; a queued job counts once per wait."""
    kept = change_only(
        derived.jobs(t), ["sim_id", "job_id"], ["ts", *derived.JOB_TIES, "nodes"], job_fingerprint(),
        always=F.col("state_current").isin("COMPLETED", "CANCELLED", "FAILED", "TIMEOUT"),
    )
    return kept.select("sim_id", "job_id", "ts", "state_current", "node_count", "time_limit")


@query("""
    SELECT event_id, user_id, ts, samples FROM (
        SELECT *, (value / 10)::INT AS samples,
               max((value / 10)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
        FROM events)
    WHERE samples > coalesce(top, 0)
""", name="new_samples_only")
def new_samples_query(t: Tables):
    """Rows that raise their user's sample count."""
    counted = t.events.select(
        "event_id", "user_id", "ts", F.rint(F.col("value") / 10).cast("int").alias("samples")
    )
    return new_samples_only(counted, ["user_id"], ["ts", "event_id"], "samples", target_rows=100_000)


@query(f"""
    SELECT sim_id, job_id, ts, time_limit, node_count, time_start,
           CASE WHEN time_start IS NOT NULL AND time_end <= ts THEN time_end END AS time_end
    FROM ({derived.JOBS_SQL})
""", name="mask_future_end")
def mask_future_end_query(t: Tables):
    masked = mask_future_end(derived.jobs(t), "time_start", "time_end", "ts")
    return masked.select("sim_id", "job_id", "ts", "time_limit", "node_count", "time_start", "time_end")


@query("""
    SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice FROM orders
    ORDER BY o_orderstatus DESC, o_orderdate, o_totalprice DESC, o_orderkey LIMIT 100
""")
def sort_multi(t: Tables):
    """Several keys and directions (first page of the default length)."""
    fields = {
        "o_orderkey": "number", "o_orderstatus": "string", "o_orderdate": "date", "o_totalprice": "number",
    }
    sort = Sort.parse(fields, ["desc:o_orderstatus", "asc:o_orderdate", "desc:o_totalprice", "asc:o_orderkey"])
    return take_page(t.orders, sort, list(fields)).rows


@query("""
    SELECT o_orderkey, o_custkey, nullif(o_orderpriority, '1-URGENT') AS o_orderpriority FROM orders
    ORDER BY nullif(o_orderpriority, '1-URGENT') NULLS FIRST, o_custkey DESC, o_orderkey LIMIT 100
""")
def sort_defaults(t: Tables):
    """Default keys follow the requested one; NULLs come first ascending."""
    fields = {"o_orderkey": "number", "o_custkey": "number", "o_orderpriority": "string"}
    sort = Sort.parse(fields, ["asc:o_orderpriority"], ["desc:o_custkey", "asc:o_orderpriority", "asc:o_orderkey"])
    rows = t.orders.withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return take_page(rows, sort, ["o_orderkey", "o_custkey", "o_orderpriority"]).rows


@query("""
    SELECT o_orderkey, words FROM (SELECT o_orderkey, string_split(o_orderpriority, ' ') AS words FROM orders)
    ORDER BY array_to_string(words, ',') DESC, o_orderkey LIMIT 100
""")
def sort_by_array(t: Tables):
    """Arrays sort by their comma-joined text."""
    rows = t.orders.select("o_orderkey", F.split("o_orderpriority", " ").alias("words"))
    sort = Sort.parse({"o_orderkey": "number", "words": "array[string]"}, ["desc:words", "asc:o_orderkey"])
    return take_page(rows, sort, ["o_orderkey", "words"]).rows
