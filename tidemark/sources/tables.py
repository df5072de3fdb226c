"""Batch readers and event-time assignment."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.times import DEFAULT_EVENT_TIME, event_time


def read_parquet(
    spark: SparkSession, path: str, schema: StructType | None = None, recursive: bool = False
) -> DataFrame:
    """Parquet below ``path``; other files are ignored.

    ``recursive`` takes nested folders as plain folders, so it is not for partitioned tables.
    """
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema else reader).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header line; columns are matched by position to the declared types."""
    return spark.read.option("header", "true").option("enforceSchema", "false").schema(schema).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_or_empty(
    spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet"
) -> DataFrame:
    """The table at ``path``, or no rows if the path does not exist; other errors are raised."""
    try:
        return spark.read.schema(schema).format(file_format).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def assign_event_time(
    df: DataFrame,
    candidates: Sequence[str],
    ts: str = "ts",
    default: datetime | None = DEFAULT_EVENT_TIME,
) -> DataFrame:
    """``ts`` from the first of the candidate columns that parses; else the default.

    Without a default, rows that have no time are dropped.
    """
    timed = df.withColumn(ts, event_time(*[F.col(c) for c in candidates], default=default))
    return timed if default is not None else timed.filter(F.col(ts).isNotNull())
