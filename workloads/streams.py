"""Streaming queries, run to the end of what is there; each equals its batch counterpart."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.functions.times import naive
from tidemark.session import shared_dir
from tidemark.sources.sinks import json_row
from tidemark.sources.streams import parquet_stream
from tidemark.sources.tables import read_jsonl, read_parquet
from tidemark.sources.topics import append_topics, topic_rows
from tidemark.streaming.changes import last_ticks, read_kept, start_appends, start_change_only, start_new_samples
from tidemark.streaming.ingest import decode_table, rejects_of, start_ingest, start_routing
from tidemark.streaming.live import live_latest, live_progress, live_rollup, read_upserts, start_upserts
from tidemark.streaming.ticks import REJECTS, TickStore, start_ticks
from workloads.logs import NEWEST
from workloads.registry import Tables, query

ALL_THERE_IS = {"availableNow": True}


def event_stream(t: Tables, in_order: bool = False):
    """The events as five micro-batches of as many files as there are cores, so that no batch is read by one task.

    Each batch reaches over the whole month, so that later batches bring rows older than those before;
    ``in_order`` gives six days to each instead.
    """
    path = shared_dir(t.spark, "events")
    files = t.spark.sparkContext.defaultParallelism
    if in_order:
        part = F.least(F.floor((F.dayofmonth("ts") - 1) / 6), F.lit(4))
        for number in range(5):
            write_batch(t.events.filter(part == number), path, files)
    else:
        for number in range(5):
            write_batch(t.events.filter(F.pmod(F.xxhash64("event_id"), F.lit(5)) == number), path, files)
    return parquet_stream(t.spark, path, t.events.schema, files_per_trigger=files)


def write_batch(rows, path: str, files: int) -> None:
    """Just so many files, if there are as many rows; files are read in the order in which they were written."""
    rows.repartition(files).write.mode("append").parquet(path)


def finish(started) -> None:
    started.awaitTermination()


#: Every fifth event is spoilt in one of four ways.
_SPOILT_SQL = """
    SELECT event_id, CASE event_id % 20 WHEN 0 THEN 'wrong type' WHEN 5 THEN 'not an object' WHEN 10 THEN 'no event time'
        WHEN 15 THEN 'wrong type' END AS reason FROM events
"""


def spoilt_rows(t: Tables):
    """JSON rows of job power; some have a word for a number, no time, or are no objects at all."""
    kind = F.col("event_id") % 20
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    row = json_row(
        F.when(kind != 10, time).alias("timestamp"),
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"),
        F.when((kind == 0) | (kind == 15), "oops").otherwise(F.col("value").cast("string")).alias("power"),
    )
    return t.events.select(F.when(kind == 5, F.concat(F.lit("["), row)).otherwise(row).alias("value"))


@query(f"SELECT reason, ['power'][1:(reason = 'wrong type')::INT] AS fields, count(*) AS lost FROM ({_SPOILT_SQL}) WHERE reason IS NOT NULL GROUP BY 1, 2")
def ingest_rejects(t: Tables):
    """What decoding could not use, with the reason and the fields."""
    lost = rejects_of(spoilt_rows(t), "job_power")
    return lost.groupBy("reason", "fields").agg(F.count(F.lit(1)).alias("lost"))


@query(f"""
    SELECT 'job-' || event_id AS job_id, CASE WHEN reason IS NULL THEN value END AS power
    FROM events JOIN ({_SPOILT_SQL}) USING (event_id) WHERE reason IS NULL OR reason = 'wrong type'
""")
def ingest_keeps_the_rest(t: Tables):
    """A field of a wrong type is NULL; the row's other fields arrive."""
    return decode_table(spoilt_rows(t), "job_power").select("job_id", "power")


@query("""
    SELECT ts, 'run-' || user_id AS sim_id, 'job-' || event_id AS job_id, value AS power, date_trunc('week', ts)::DATE AS seg
    FROM events
""")
def stream_ingest(t: Tables):
    """JSON rows as they come from a topic, decoded and appended to a segmented table."""
    raw = event_stream(t).select(
        json_row(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
            F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("sim_id"),
            F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"),
            F.col("value").alias("power"),
        ).alias("value")
    )
    path = shared_dir(t.spark, "ingest")
    finish(start_ingest(decode_table(raw, "job_power"), f"{path}/table", f"{path}/checkpoint", trigger=ALL_THERE_IS))
    return read_parquet(t.spark, f"{path}/table").withColumn("ts", naive(F.col("ts")))


@query("""
    SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS timestamp, event_type, max(value) AS value
    FROM events GROUP BY 1, 2
""")
def stream_rollup(t: Tables):
    rolled = live_rollup(event_stream(t), timedelta(hours=6), ["event_type"], ["value"])
    path = shared_dir(t.spark, "rollup")
    finish(start_upserts(rolled, f"{path}/log", f"{path}/checkpoint", ["timestamp", "event_type"], ALL_THERE_IS, compaction=4))
    current = read_upserts(t.spark, f"{path}/log", ["timestamp", "event_type"], rolled.schema)
    return current.withColumn("timestamp", naive(F.col("timestamp")))


@query(f"SELECT user_id, ts, event_id, event_type, value FROM events {NEWEST}")
def stream_latest_state(t: Tables):
    state = live_latest(
        event_stream(t), ["user_id"], ["ts", "event_id"], ["ts", "event_id", "event_type", "value"]
    )
    path = shared_dir(t.spark, "latest")
    finish(start_upserts(state, f"{path}/log", f"{path}/checkpoint", ["user_id"], ALL_THERE_IS, compaction=2))
    current = read_upserts(t.spark, f"{path}/log", ["user_id"], state.schema)
    return current.withColumn("ts", naive(F.col("ts")))


@query("""
    SELECT event_id, user_id, ts, event_type, value FROM events
    QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type
""")
def stream_change_only(t: Tables):
    """Batches bring rows older than those before; what they change is taken back."""
    path = shared_dir(t.spark, "changes")
    stream = event_stream(t).select("event_id", "user_id", "ts", "event_type", "value")
    keys, order = ["user_id"], ["ts", "event_id"]
    finish(start_change_only(stream, path, f"{path}/checkpoint", keys, order, F.col("event_type"), trigger=ALL_THERE_IS))
    return read_kept(t.spark, path, keys, order, stream.schema).withColumn("ts", naive(F.col("ts")))


@query("""
    SELECT event_id, user_id, ts, samples FROM (SELECT *, event_id % 97 AS samples FROM events)
    QUALIFY samples > coalesce(max(samples) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
""")
def stream_new_samples(t: Tables):
    """Sample counters over out-of-order batches."""
    path = shared_dir(t.spark, "samples")
    stream = event_stream(t).select("event_id", "user_id", "ts", (F.col("event_id") % 97).alias("samples"))
    keys, order = ["user_id"], ["ts", "event_id"]
    finish(start_new_samples(stream, path, f"{path}/checkpoint", keys, order, "samples", trigger=ALL_THERE_IS))
    return read_kept(t.spark, path, keys, order, stream.schema).withColumn("ts", naive(F.col("ts")))


@query("""
    SELECT user_id, ts, event_id, event_type FROM (
        SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts, max(ts) OVER () AS newest FROM events)
    WHERE coalesce(next_ts, newest) >= ts + INTERVAL 12 HOUR
""")
def stream_last_ticks(t: Tables):
    """The last row of each run, given out by a timer when the run has been silent for half a day."""
    path = shared_dir(t.spark, "ticks")
    ended = last_ticks(event_stream(t, in_order=True), ["user_id"], ["ts", "event_id"], ["ts", "event_id", "event_type"], "12 hours")
    finish(start_appends(ended, f"{path}/table", f"{path}/checkpoint", ALL_THERE_IS))
    return read_parquet(t.spark, f"{path}/table").withColumn("ts", naive(F.col("ts")))


@query("""
    SELECT u.user_id, first_seen, last_tick,
           round((epoch_us(last_tick) - epoch_us(first_seen)) / 2592000000000, 3) AS progress
    FROM (SELECT user_id, min(ts) AS first_seen, max(ts) AS last_tick FROM events GROUP BY 1) u
""")
def stream_progress(t: Tables):
    """Newest tick per run from the stream, joined with the runs when queried."""
    seen = live_progress(event_stream(t), "user_id")
    path = shared_dir(t.spark, "progress")
    finish(start_upserts(seen, f"{path}/log", f"{path}/checkpoint", ["user_id"], ALL_THERE_IS, compaction=2))
    current = read_upserts(t.spark, f"{path}/log", ["user_id"], seen.schema)
    runs = t.events.groupBy("user_id").agg(F.min("ts").alias("first_seen"))
    passed = F.unix_micros("last_tick") - F.unix_micros(F.col("first_seen").cast("timestamp"))
    return runs.join(current, "user_id").select(
        "user_id", "first_seen", naive(F.col("last_tick")).alias("last_tick"),
        F.round(passed / 2592000000000, 3).alias("progress"),
    )


@query("SELECT event_id, user_id, value, 'topic-' || event_type AS topic FROM events")
def stream_route_by_type(t: Tables):
    """One stream split over several outputs in a single pass."""
    stream = event_stream(t)
    rows = stream.select(
        F.concat(F.lit("topic-"), F.col("event_type")).alias("topic"),
        json_row("event_id", "user_id", "value").alias("value"),
    )
    path = shared_dir(t.spark, "routes")
    finish(start_routing(rows, f"{path}/topics", f"{path}/checkpoint", ALL_THERE_IS))
    return read_jsonl(t.spark, f"{path}/topics", "event_id bigint, user_id bigint, value double, topic string")


@query("""
    SELECT 'e' || event_id AS event_key,
           CASE WHEN event_id % 7 = 6 THEN 'unknown topic' WHEN event_id % 20 = 5 THEN 'not an object'
                ELSE ['runs', 'jobs', 'cdus', 'cep', 'job_power', 'system'][event_id % 7 + 1] END AS arrived_as,
           CASE WHEN event_id % 7 <> 6 AND event_id % 20 <> 5 THEN ts END AS ts,
           CASE WHEN event_id % 7 <> 6 AND event_id % 20 <> 5 THEN date_trunc('week', ts)::DATE END AS seg
    FROM events
""")
def stream_six_tables(t: Tables):
    """Six topics and a stray one, read from a topic log by one query that is started three times; some rows are
    spoilt."""
    tables = ["runs", "jobs", "cdus", "cep", "job_power", "system"]
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    key = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    row = json_row(time.alias("timestamp"), time.alias("time_snapshot"), key.alias("id"), key.alias("sim_id"))
    topics = F.array(*[F.lit(f"topic-{name}") for name in [*tables, "stray"]])
    # By all cores, also where the events are one file of few row groups.
    events = t.events.select("event_id", "ts").repartition(t.spark.sparkContext.defaultParallelism, "event_id")
    rows = events.select(
        "event_id",
        F.get(topics, (F.col("event_id") % 7).cast("int")).alias("topic"),
        F.when(F.col("event_id") % 20 == 5, F.concat(F.lit("["), row)).otherwise(row).alias("value"),
    )
    path = shared_dir(t.spark, "six")
    store = TickStore(f"{path}/store", {name: f"topic-{name}" for name in tables}, merge=2)
    for number in range(3):
        append_topics(rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == number), f"{path}/topics", number)
        finish(start_ticks(topic_rows(t.spark, f"{path}/topics", start="earliest"), store, ALL_THERE_IS))
    read = store.tables(t.spark)
    lost = read.pop(REJECTS).select(
        F.regexp_extract("value", "e[0-9]+", 0).alias("event_key"), F.col("reason").alias("arrived_as"),
        F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("date").alias("seg"),
    )
    for name, rows in read.items():
        own = rows.select(
            F.col("id" if name == "runs" else "sim_id").alias("event_key"), F.lit(name).alias("arrived_as"), "ts", "seg"
        )
        lost = lost.unionByName(own)
    return lost.withColumn("ts", naive(F.col("ts")))
