"""Time-series queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.functions.durations import BREAKPOINT_SECONDS, snap_seconds
from tidemark.functions.times import bucket, naive, offset_to_time, parse_instant
from tidemark.operators.changes import downsample
from tidemark.operators.filters import Filters
from tidemark.operators.grids import Grid, grid_rollup as rollup_from_grids
from tidemark.operators.rollup import distinct_counts, maxima, rollup, rollup_groups, rollup_table
from tidemark.operators.snapshots import newest
from tidemark.operators.spans import Granularity, Span, data_bounds, extent, fill_bounds, group_spans
from tidemark.plans.cooling import cdu_series, cep_series
from tidemark.plans.power import job_power_series
from tidemark.plans.series import row_values
from tidemark.plans.system import system_series
from tidemark.schemas import CDU_MEASURES, CEP_MEASURES, SYSTEM_COUNTS, SYSTEM_MEASURES
from tidemark.session import shared_dir
from workloads import derived
from workloads.registry import Tables, query

#: The events table covers this month.
MONTH = ("2024-01-01", "2024-01-31")


def month(granularity: Granularity, start: str = MONTH[0]) -> Span:
    return Span.resolve(start, MONTH[1], granularity)


def _maxima_sql(columns) -> str:
    return ", ".join(f"max({c}) AS {c}" for c in columns)


@query("""
    SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS timestamp, event_type,
           max(value) AS value, count(*) AS readings
    FROM events
    WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' AND event_type IN ('view', 'click', 'error')
    GROUP BY 1, 2
""")
def rollup_max_by_dim(t: Tables):
    """Flagship: filtered rollup of a month at about 100 points per series."""
    filters = Filters.parse({"event_type": "string"}, {"event_type": ["one_of:view,click,error"]})
    aggregates = {**maxima(["value"]), "readings": F.count(F.lit(1))}
    return rollup(filters.apply(t.events), month(Granularity(resolution=100)), aggregates, ["event_type"])


@query("""
    SELECT time_bucket(INTERVAL 90 MINUTE, ts, TIMESTAMP '2024-01-01') AS timestamp, max(value) AS value
    FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1
""")
def rollup_max_global(t: Tables):
    return rollup(t.events, month(Granularity(width="PT1H30M")), maxima(["value"]))


@query("""
    SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01') AS timestamp, user_id,
           min('user ' || user_id) AS label
    FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2
""")
def rollup_any_value(t: Tables):
    labelled = t.events.withColumn("label", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    return rollup(
        labelled, month(Granularity(width="P1D")), {"label": F.any_value("label")}, ["user_id"]
    )


@query("""
    SELECT time_bucket(to_microseconds(5407500000), ts, TIMESTAMP '2024-01-01 00:00:03') AS timestamp,
           event_type, max(value) AS value
    FROM events WHERE ts >= TIMESTAMP '2024-01-01 00:00:03' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2
""")
def rollup_origin_aligned(t: Tables):
    """Odd width, odd start (rounded down to the second): the first bucket begins at the start."""
    span = month(Granularity(width=5407.5), "2024-01-01T00:00:03.7Z")
    return rollup(t.events, span, maxima(["value"]), ["event_type"])


@query("""
    SELECT time_bucket(INTERVAL 168 HOUR, ts, TIMESTAMP '1970-01-01') AS timestamp, event_type,
           max(value) AS value
    FROM events GROUP BY 1, 2
""")
def rollup_epoch_aligned(t: Tables):
    start = bucket(F.col("ts"), timedelta(days=7)).alias("timestamp")
    return t.events.groupBy(start, "event_type").agg(F.max("value").alias("value"))


@query("""
    WITH b AS (SELECT min(ts) AS lo, max(ts) + INTERVAL 1 SECOND AS hi FROM events),
    s AS (SELECT date_trunc('second', lo) AS origin, hi, epoch_us(hi) - epoch_us(lo) AS range_us FROM b),
    g AS (SELECT origin, hi, (SELECT max(d) FROM (SELECT unnest([%s]) AS d) WHERE d::BIGINT * 1000000 * 250 <= range_us) AS w FROM s)
    SELECT time_bucket(to_seconds(w), ts, origin) AS timestamp, user_id, max(value) AS value
    FROM events, g GROUP BY 1, 2
""" % ", ".join(map(str, BREAKPOINT_SECONDS)))
def rollup_by_resolution(t: Tables):
    """Bounds and bucket width both follow from the data."""
    events = t.events
    span = Span.resolve(*fill_bounds(None, None, data_bounds(events, "ts")), Granularity(resolution=250))
    return rollup(events, span, maxima(["value"]), ["user_id"])


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           coalesce(list_max(list_filter({list(BREAKPOINT_SECONDS)}, lambda d: d <= (l_extendedprice * l_extendedprice / 7 - 100))), 1)::BIGINT AS snapped
    FROM lineitem
""")
def snap_duration_col(t: Tables):
    seconds = F.col("l_extendedprice") * F.col("l_extendedprice") / 7 - 100
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", snap_seconds(seconds).alias("snapped")
    )


@query(f"""
    WITH p AS ({derived.POWER_SQL}),
    e AS (SELECT sim_id, job_id, date_trunc('second', min(ts)) AS origin FROM p GROUP BY ALL)
    SELECT sim_id, job_id,
           make_timestamp(epoch_us(origin) + (epoch_us(ts) - epoch_us(origin)) // 3600000000 * 3600000000) AS timestamp,
           max(power) AS power
    FROM p JOIN e USING (sim_id, job_id) GROUP BY ALL
""")
def power_history(t: Tables):
    """Hourly power of every job, aligned to the job's own first sample."""
    return job_power_series(derived.power(t), granularity=Granularity(width=3600)).rows


@query(f"""
    WITH u AS (SELECT user_id, min(ts) + INTERVAL 36 HOUR AS lo, max(ts) - INTERVAL 12 HOUR AS hi FROM events
               GROUP BY 1 HAVING min(ts) + INTERVAL 36 HOUR <= max(ts) - INTERVAL 12 HOUR),
    s AS (SELECT user_id, date_trunc('second', lo) AS origin,
                 date_trunc('second', hi + INTERVAL 999999 MICROSECOND) AS until,
                 greatest(epoch_us(hi) - epoch_us(lo), 1000000) / 40000000 AS per_point FROM u),
    g AS (SELECT *, coalesce(list_max(list_filter({list(BREAKPOINT_SECONDS)}, lambda d: d <= per_point)), 1)::BIGINT * 1000000 AS w FROM s)
    SELECT user_id, make_timestamp(epoch_us(origin) + (epoch_us(ts) - epoch_us(origin)) // w * w) AS timestamp,
           event_type, max(value) AS value
    FROM events JOIN g USING (user_id) WHERE ts >= origin AND ts < until GROUP BY ALL
""")
def run_span_rollup(t: Tables):
    """40 points per run over a declared span that leaves out part of the data."""
    bounds = t.events.groupBy("user_id").agg(
        (F.min("ts") + F.expr("interval 36 hours")).alias("extent_start"),
        (F.max("ts") - F.expr("interval 12 hours")).alias("extent_end"),
    ).filter("extent_start <= extent_end")
    spans = group_spans(bounds, ["user_id"], Granularity(resolution=40))
    return rollup_groups(t.events, spans, ["user_id"], maxima(["value"]), ["event_type"])


def _sim_series_sql(table: str, width_us: str, columns: str, dims: str = "") -> str:
    return f"""
        WITH r AS ({derived.SIMS_SQL}), d AS ({table}),
        s AS (SELECT id AS sim_id, start AS origin, "end" AS until, {width_us} AS w FROM r)
        SELECT sim_id, make_timestamp(epoch_us(origin) + (epoch_us(ts) - epoch_us(origin)) // w * w) AS timestamp,
               {dims} {columns}
        FROM d JOIN s USING (sim_id) WHERE ts >= origin AND ts < until
        GROUP BY sim_id, {dims} timestamp
    """


@query(_sim_series_sql(
    f"SELECT * FROM ({derived.CDUS_SQL}) WHERE rack_1_power > 5 AND NOT contains(name, '7')",
    "604800000000",
    _maxima_sql(CDU_MEASURES) + ', min("row")::BIGINT AS "row", min(col)::BIGINT AS col',
    "name,",
))
def cdu_series_all(t: Tables):
    """Weekly maxima per cooling unit of every simulation, over its declared span."""
    wanted = {"rack_1_power": ["gt:5"], "name": ["not_contains:7"]}
    return cdu_series(
        derived.cdus(t), derived.sims(t), granularity=Granularity(width="P7D"), filters=wanted
    ).rows


@query(_sim_series_sql(
    derived.CEP_SQL,
    f"coalesce(list_max(list_filter({list(BREAKPOINT_SECONDS)}, lambda d: d <= (epoch_us(\"end\") - epoch_us(start)) / 100000000)), 1)::BIGINT * 1000000",
    _maxima_sql(CEP_MEASURES),
))
def cep_series_all(t: Tables):
    """About 100 points of the central plant for every simulation."""
    return cep_series(derived.cep(t), derived.sims(t), granularity=Granularity(resolution=100)).rows


@query(f"""
    WITH r AS ({derived.SIMS_SQL}), d AS ({derived.SYSTEM_SQL})
    SELECT sim_id, start AS timestamp, down_nodes, {", ".join([*SYSTEM_COUNTS, *SYSTEM_MEASURES])}
    FROM d JOIN r ON sim_id = id WHERE d.ts >= start AND d.ts < "end"
    QUALIFY row_number() OVER (PARTITION BY sim_id ORDER BY d.ts DESC, {", ".join(f"{c} DESC" for c in derived.SYSTEM_TIES)}) = 1
""")
def system_latest(t: Tables):
    """Most recent statistics of every simulation: one bucket over its whole span."""
    return system_series(derived.system(t), derived.sims(t), tie_breaks=derived.SYSTEM_TIES).rows


_ONE_SIM = "sim-R"


def _one_run_sql(table: str, sim: str, bounds: str, width_us: str, columns: str, dims: str = "") -> str:
    """Buckets of one run from ``lo`` to ``hi``, which ``bounds`` selects."""
    return f"""
        WITH d AS (SELECT * FROM ({table}) WHERE sim_id = '{sim}'),
        b AS ({bounds}),
        s AS (SELECT date_trunc('second', lo) AS origin,
                     date_trunc('second', hi + INTERVAL 999999 MICROSECOND) AS until, {width_us} AS w FROM b)
        SELECT make_timestamp(epoch_us(origin) + (epoch_us(ts) - epoch_us(origin)) // w * w) AS timestamp, {dims} {columns}
        FROM d, s WHERE ts >= origin AND ts < until GROUP BY {dims} timestamp
    """


def _declared(sim: str) -> str:
    return f"SELECT start AS lo, \"end\" AS hi FROM ({derived.SIMS_SQL}) WHERE id = '{sim}'"


def _points(number: int) -> str:
    per_point = f"(epoch_us(hi) - epoch_us(lo)) / {number * 10**6}"
    return (
        f"coalesce(list_max(list_filter({list(BREAKPOINT_SECONDS)}, lambda d: d <= {per_point})), 1)::BIGINT * 1000000"
    )


@query(_one_run_sql(
    f"SELECT * FROM ({derived.CDUS_SQL}) WHERE NOT contains(name, '7')", _ONE_SIM, _declared(_ONE_SIM), _points(20),
    "max(rack_1_power) AS rack_1_power, max(total_power) AS total_power", "name,",
))
def cdu_series_one(t: Tables):
    """One run over its declared span: about 20 points, chosen fields, a filter."""
    return cdu_series(
        derived.cdus(t), derived.sims(t), _ONE_SIM, granularity=Granularity(resolution=20),
        fields="name,rack_1_power,total_power", filters={"name": ["not_contains:7"]},
    ).rows


@query(_one_run_sql(
    derived.CDUS_SQL, "sim-none", "SELECT TIMESTAMP '1998-01-01' AS lo, TIMESTAMP '1998-03-01' AS hi", "86400000000",
    "max(total_power) AS total_power", "name,",
))
def cdu_series_unknown_run(t: Tables):
    """A run that does not exist, between given bounds: no rows, but the same columns."""
    return cdu_series(
        derived.cdus(t), derived.sims(t), "sim-none", parse_instant("1998-01-01"), parse_instant("1998-03-01"),
        Granularity(width="P1D"), fields="name,total_power",
    ).rows


@query(_one_run_sql(
    derived.CEP_SQL, _ONE_SIM,
    f"SELECT TIMESTAMP '1997-06-01' AS lo, greatest(TIMESTAMP '1997-06-01', hi) AS hi FROM ({_declared(_ONE_SIM)})",
    "2592000000000", _maxima_sql(CEP_MEASURES),
))
def cep_series_one(t: Tables):
    """One run from a given start to its declared end, by 30 days."""
    return cep_series(
        derived.cep(t), derived.sims(t), _ONE_SIM, start=parse_instant("1997-06-01"), granularity=Granularity(width="P30D")
    ).rows


@query(f"""
    SELECT TIMESTAMP '1996-01-01' AS timestamp, jobs_running, average_power, down_nodes
    FROM ({derived.SYSTEM_SQL}) WHERE sim_id = '{_ONE_SIM}' AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1998-01-01'
    QUALIFY row_number() OVER (ORDER BY ts DESC, {", ".join(f"{c} DESC" for c in derived.SYSTEM_TIES)}) = 1
""")
def system_series_one(t: Tables):
    """Latest statistics of one run between given bounds."""
    return system_series(
        derived.system(t), derived.sims(t), _ONE_SIM, parse_instant("1996-01-01"), parse_instant("1998-01-01"),
        tie_breaks=derived.SYSTEM_TIES,
    ).rows.select("timestamp", "jobs_running", "average_power", "down_nodes")


@query(_one_run_sql(
    f"SELECT * FROM ({derived.POWER_SQL}) WHERE job_id = 'job-7'", "sim-view",
    f"SELECT min(ts) AS lo, max(ts) AS hi FROM ({derived.POWER_SQL}) WHERE sim_id = 'sim-view' AND job_id = 'job-7'",
    "21600000000", "max(power) AS power, any_value(job_id) AS job_id",
))
def job_power_one(t: Tables):
    """Power of one job between its first and its last sample."""
    return job_power_series(derived.power(t), "sim-view", "job-7", granularity=Granularity(width="PT6H"), fields="all").rows


@query("""
    SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01') AS timestamp, event_type,
           arg_max_null(CASE WHEN value < 20 THEN NULL ELSE value END, ts) AS value,
           arg_max(event_id, ts) AS event_id
    FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2
""")
def rollup_latest(t: Tables):
    """Newest value per bucket; a NULL in the newest row is the answer."""
    gaps = t.events.withColumn("value", F.when(F.col("value") >= 20, F.col("value")))
    return rollup(
        gaps, month(Granularity(width="P1D")), newest(["value", "event_id"], ["ts", "event_id"]), ["event_type"]
    )


@query("SELECT min(ts) AS extent_start, max(ts) + INTERVAL 1 SECOND AS extent_end FROM events")
def ts_extent(t: Tables):
    return extent(t.events, "ts")


@query("""
    SELECT event_id, event_type, ts, value FROM events
    QUALIFY epoch_us(date_trunc('second', ts)) // 1000000 % 5 = 0 OR ts = max(ts) OVER (PARTITION BY event_type)
""")
def downsample_grid(t: Tables):
    """The sampling operator: ticks on the 5 s grid, and each run's last tick."""
    return downsample(t.events.select("event_id", "event_type", "ts", "value"), ["event_type"], "ts", 5)


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           l_shipdate + to_microseconds((nullif(l_quantity, 1) * 1500000 - 250000)::BIGINT) AS at
    FROM lineitem
""", name="offset_to_time")
def offset_to_time_query(t: Tables):
    """Offsets in seconds to times; a missing offset stays missing."""
    offset = F.nullif(F.col("l_quantity"), F.lit(1.0)) * 1.5
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        naive(offset_to_time(F.col("l_shipdate"), offset, 0.25)).alias("at"),
    )


@query("""
    SELECT event_id, ts, user_id, event_type, value FROM events
    WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-25 12:30:01'
""")
def span_filter(t: Tables):
    """Half-open range whose end is rounded up to the second."""
    span = Span("2024-01-05T06:00Z", "2024-01-25T12:30:00.5Z", timedelta(seconds=1))
    return span.restrict(t.events).select("event_id", "ts", "user_id", "event_type", "value")


@query("""
    SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, user_id, event_type, max(value) AS value
    FROM events GROUP BY ALL
""", name="rollup_table")
def rollup_table_query(t: Tables):
    return rollup_table(t.events, timedelta(hours=1), ["user_id", "event_type"], ["value"])


@query("""
    SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS timestamp, event_type, max(value) AS value
    FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-28 17:20:00' GROUP BY 1, 2
""")
def grid_rollup(t: Tables):
    """Maxima from a stored two-hour grid that was extended twice, raw rows behind it."""
    grids = [
        Grid(shared_dir(t.spark, f"grid-{hours}h"), timedelta(hours=hours), ["event_type"], ["value"]) for hours in (2, 5)
    ]
    for grid in grids:
        for upto in ("2024-01-12T03:30Z", "2024-01-25T05:10Z"):
            grid.extend(t.events, parse_instant(upto))
    span = Span("2024-01-01T00:00Z", "2024-01-28T17:20Z", timedelta(hours=6))
    return rollup_from_grids(t.events, grids, span, ["value"], ["event_type"])


@query("""
    SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT value) AS readings
    FROM events GROUP BY 1
""")
def distinct_exact(t: Tables):
    return distinct_counts(t.events, ["event_type"], {"users": "user_id", "readings": "value"})


@query("""
    SELECT epoch_us(timestamp) AS bucket_us, value, [user_id, n, big] AS row FROM (
        SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01') AS timestamp, user_id,
               max(value) AS value, count(*) AS n, max(9007199254740993 + event_id) AS big
        FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2)
""")
def rows_as_arrays(t: Tables):
    """Array layout of the whole numbers of a series, beyond what a double holds too."""
    rows = rollup(
        t.events, month(Granularity(width="P1D")),
        {**maxima(["value"]), "n": F.count(F.lit(1)), "big": F.max(F.lit(9007199254740993) + F.col("event_id"))}, ["user_id"],
    )
    rows = rows.withColumn("bucket_us", F.unix_micros(F.col("timestamp").cast("timestamp")))
    return row_values(rows.drop("timestamp"), beside=["bucket_us", "value"])
