"""Continuous ingest of the six JSON streams into segmented tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.times import DEFAULT_EVENT_TIME, event_time
from tidemark.schemas import EVENT_TIME_FIELD, TABLES
from tidemark.sources.sinks import SEGMENT, with_segment
from tidemark.sources.tables import assign_event_time

def _fields(schema: T.StructType, event_time_field: str) -> list[tuple[str, T.DataType]]:
    """The columns read from the text and their types; times travel as text."""
    return [
        (f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType)
        for f in schema.fields
        if f.name not in ("ts", event_time_field)
    ]


def with_texts(rows: DataFrame) -> DataFrame:
    """Adds ``_is_object``, whether ``value`` is a JSON object, and ``_texts``, its fields as texts; rows that have them
    stay as they are, so that several tables and their rejects can be made of rows parsed once."""
    if "_texts" in rows.columns:
        return rows
    object_text = F.get_json_object("value", "$")
    parsed = F.from_json(F.when(F.col("_is_object"), F.col("value")), T.MapType(T.StringType(), T.StringType()))
    # Out of an array of one, or filters and columns made of the texts would each parse the row anew.
    return rows.withColumn("_is_object", F.coalesce(object_text.startswith("{"), F.lit(False))).select(
        "*", F.explode(F.array(parsed)).alias("_texts")
    )


def _read(rows: DataFrame, schema: T.StructType, event_time_field: str) -> DataFrame:
    """``value``, the event time's text, all columns, and ``_unread``: present fields of a wrong type.

    Each field is decoded by itself, so a wrong one is NULL and leaves the others alone.
    """
    fields = _fields(schema, event_time_field)
    taken = with_texts(rows).select("value", "_is_object", "_texts")

    def decoded(name: str, kind: T.DataType):
        text = F.element_at("_texts", name)
        if isinstance(kind, T.StringType):
            return text
        if isinstance(kind, T.ArrayType):
            return F.from_json(text, kind)
        return text.try_cast(kind)

    read = taken.select(
        "*", F.element_at("_texts", event_time_field).alias(event_time_field),
        *[decoded(name, kind).alias(name) for name, kind in fields],
    )
    unread = F.filter(
        F.array(*[F.when(F.element_at("_texts", name).isNotNull() & F.col(name).isNull(), F.lit(name)) for name, _ in fields]),
        lambda name: name.isNotNull(),
    )
    return read.withColumn("_unread", F.coalesce(unread, F.array().cast("array<string>")))


def decode(
    rows: DataFrame, schema: T.StructType, event_time_field: str, default_time=None
) -> DataFrame:
    """Typed table rows from a ``value`` column of JSON text; works on batches and streams alike.

    A field of a wrong type is NULL. Rows that are not JSON objects are dropped, as are rows without an
    event time unless there is a default; :func:`rejects` has them all.
    """
    parsed = _read(rows, schema, event_time_field).filter("_is_object")
    timed = assign_event_time(parsed, [event_time_field], default=default_time)
    columns = [
        F.col(f.name).try_cast("timestamp").alias(f.name)
        if isinstance(f.dataType, T.TimestampType)
        else F.col(f.name)
        for f in schema.fields
    ]
    return timed.select(*columns)


def rejects(rows: DataFrame, schema: T.StructType, event_time_field: str, default_time=None) -> DataFrame:
    """(``value``, ``reason``, ``fields``) of what :func:`decode` lost: ``not an object``, ``no event time``,
    or ``wrong type`` with the names of the fields that became NULL."""
    read = _read(rows, schema, event_time_field)
    timed = read.withColumn("_time", event_time(F.col(event_time_field), default=default_time))
    reason = (
        F.when(~F.col("_is_object"), "not an object")
        .when(F.col("_time").isNull(), "no event time")
        .when(F.size("_unread") > 0, "wrong type")
    )
    return timed.select("value", reason.alias("reason"), F.col("_unread").alias("fields")).filter("reason IS NOT NULL")


def decode_table(rows: DataFrame, table: str) -> DataFrame:
    """:func:`decode` for one of the six tables. Run events without a time get the default one."""
    default = DEFAULT_EVENT_TIME if table == "runs" else None
    return decode(rows, TABLES[table], EVENT_TIME_FIELD[table], default)


def rejects_of(rows: DataFrame, table: str) -> DataFrame:
    """:func:`rejects` for one of the six tables; a side output to be kept beside the ingest."""
    default = DEFAULT_EVENT_TIME if table == "runs" else None
    return rejects(rows, TABLES[table], EVENT_TIME_FIELD[table], default)


def start_ingest(
    table_rows: DataFrame,
    path: str,
    checkpoint: str,
    unit: str = "week",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append a stream of table rows to a segmented Parquet table."""
    return (
        with_segment(table_rows, "ts", unit)
        .writeStream.format("parquet")
        .partitionBy(SEGMENT)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .start()
    )


def start_ingest_all(
    rows: DataFrame, root: str, topics: dict[str, str], trigger: dict | None = None
) -> dict[str, StreamingQuery]:
    """One ingest per table; ``topics`` maps table names to the topics in ``rows``."""
    return {
        table: start_ingest(
            decode_table(rows.filter(F.col("topic") == topic), table),
            f"{root}/{table}",
            f"{root}/_checkpoints/{table}",
            trigger=trigger,
        )
        for table, topic in topics.items()
    }


def start_routing(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Route ``topic, value`` rows to one folder of JSON lines per topic, in a single pass."""
    return (
        rows.writeStream.format("text")
        .partitionBy("topic")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .start()
    )


def start_kafka_routing(rows: DataFrame, servers: str, checkpoint: str) -> StreamingQuery:
    """Route ``topic, value`` rows to the topics of a broker."""
    return (
        rows.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
        .start()
    )
