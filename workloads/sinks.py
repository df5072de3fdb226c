"""Write-and-read-back queries. They write below the session's shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.times import parse_instant
from tidemark.operators.spans import Segment, between
from tidemark.plans.histories import read_csv_text
from tidemark.session import shared_dir
from tidemark.sources.sinks import json_row, write_daily, write_jsonl, write_segmented
from tidemark.sources.tables import read_csv, read_jsonl, read_or_empty, read_parquet
from workloads.registry import Tables, query

EVENTS_SQL = "SELECT event_id, ts, user_id, event_type, value FROM events"
COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


@query(EVENTS_SQL)
def csv_roundtrip(t: Tables):
    path = shared_dir(t.spark, "csv")
    events = t.events.select(*COLUMNS)
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    events.write.option("header", "true").option("timestampNTZFormat", micros).csv(path)
    return read_csv(t.spark, path, events.schema)


@query(f"""
    SELECT event_id, ts, user_id, event_type, value, date_trunc('week', ts)::DATE AS seg FROM events
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-24 12:00:00'
""")
def partitioned_roundtrip(t: Tables):
    """Week-segmented table read for a range: only the segments of the range are opened."""
    path = shared_dir(t.spark, "segmented")
    write_segmented(t.events.select(*COLUMNS), path)
    return between(
        read_parquet(t.spark, path), "ts", parse_instant("2024-01-10"), parse_instant("2024-01-24T12:00Z"), segment=Segment("week")
    )


@query("SELECT event_id, ts, user_id, event_type, value, ts::DATE AS date FROM events")
def daily_repartition(t: Tables):
    """One folder per day, in files of bounded length."""
    path = shared_dir(t.spark, "daily")
    write_daily(t.events.select(*COLUMNS), path, "ts")
    return read_parquet(t.spark, path)


@query("SELECT event_id, user_id, event_type, value, 'events-' || event_type AS topic FROM events")
def jsonl_roundtrip(t: Tables):
    """JSON lines, one folder per topic, written in one pass and appended to once."""
    path = shared_dir(t.spark, "jsonl")
    schema = t.events.select("event_id", "user_id", "event_type", "value").schema
    topic = F.concat(F.lit("events-"), F.col("event_type")).alias("topic")
    early = F.col("ts") < F.expr("timestamp_ntz '2024-01-15'")
    for part in (t.events.filter(early), t.events.filter(~early)):
        write_jsonl(part.select(topic, json_row(*schema.fieldNames()).alias("value")), path)
    return read_jsonl(t.spark, path, schema.add("topic", "string"))


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def missing_table_empty(t: Tables):
    """A table that does not exist yet reads as empty and can be combined with one that does."""
    events = t.events.select(*COLUMNS)
    return events.unionByName(read_or_empty(t.spark, shared_dir(t.spark, "absent"), events.schema))


@query("""
    SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN user_id END AS user_id FROM events
""")
def csv_headers_differ(t: Tables):
    """Two files whose headers differ in order and in columns, read by name."""
    path = shared_dir(t.spark, "csv-headers")
    rows = t.events.select("event_id", "user_id", "event_type")
    even = rows.filter("event_id % 2 = 0").select("user_id", "event_type", "event_id")
    odd = rows.filter("event_id % 2 = 1").select("event_type", "event_id")
    for part in (even, odd):
        part.write.mode("append").option("header", "true").csv(path)
    found = read_csv_text(t.spark, path)
    return found.select(
        F.col("event_id").cast("long").alias("event_id"), "event_type", F.col("user_id").cast("long").alias("user_id")
    )
