"""Streaming sources of ``topic, value`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def kafka_rows(spark: SparkSession, servers: str, topics: str, per_trigger: int | None = None) -> DataFrame:
    """JSON rows of topics, from the newest offset on (needs Spark's Kafka connector)."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("startingOffsets", "latest")
    )
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return reader.load().select("topic", F.col("value").cast("string").alias("value"))


def file_rows(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON-line files below ``path``, as written by ``write_jsonl``."""
    reader = spark.readStream.schema("value string, topic string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select("topic", "value")


def parquet_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    glob: str = "*.parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet files appearing in a folder. Times without a zone become UTC instants, which is what
    watermarks need."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(folder)
    zoneless = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})
