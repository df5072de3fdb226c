"""Views over a stream that depend on the order of an entity's rows: change-only snapshots, new samples, last ticks.

For the first two a row is kept or not according to the rows before it, of which the kept ones tell enough: the
last kept row has the state that held before a row, or the largest count. So a micro-batch needs one kept row per
entity it touches, the carried one, as long as rows come in order. A row that comes late may change whether later
rows are kept. Then the entity's kept rows and all its rows from the late one on are judged again, and what has
changed is written as upserts by entity and order: rows newly kept, and retractions of rows no longer kept.

All work runs as batch operators inside the micro-batch, so hot entities are cut into slices as in a batch query,
and no Python worker is involved.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tidemark.operators.changes import previous_value, running_max_before
from tidemark.operators.skew import TARGET_ROWS, same_key
from tidemark.operators.snapshots import latest_state
from tidemark.sources.tables import read_or_empty
from tidemark.streaming.upserts import BATCH, UpsertTable

#: Batches from one compaction to the next.
COMPACTION = 32
_KEPT, _WAS, _DONE, _NEWEST = "_kept", "_was", "_done", "_newest"


def _named(frame: DataFrame, keys: Sequence[str], *others: str) -> DataFrame:
    """The keys as ``_<key>``, for comparing them with those of another frame."""
    return frame.select(*[F.col(k).alias(f"_{k}") for k in keys], *others)


def _kept_rows(path: str, keys: Sequence[str], order: Sequence[str], schema: StructType) -> UpsertTable:
    """Whether a row is kept, by entity and order."""
    fields = [*schema.fields, StructField(_KEPT, BooleanType())]
    return UpsertTable(f"{path}/kept", [*keys, *order], StructType(fields), COMPACTION)


def _carried_rows(path: str, keys: Sequence[str], order: Sequence[str], schema: StructType) -> UpsertTable:
    """The last kept row of each entity, with the place of its newest row, which need not be kept."""
    newest = StructType([schema[c] for c in order])
    fields = [*schema.fields, StructField(_NEWEST, newest), StructField(_DONE, BooleanType())]
    return UpsertTable(f"{path}/carried", keys, StructType(fields), COMPACTION, drop=_DONE)


def read_kept(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], schema: StructType) -> DataFrame:
    """The rows that are kept as things stand."""
    return _kept_rows(path, keys, order, schema).current(spark).filter(_KEPT).select(*schema.names)


def start_keeping(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[str],
    keep: Callable[[DataFrame, int | None], DataFrame],
    *,
    finished: Column | None = None,
    target_rows: int = TARGET_ROWS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Maintain below ``path`` the rows of a stream for which ``keep(rows, target_rows)`` says so in ``_kept``; a
    ``target_rows`` of None promises few rows, which need no slices.

    ``order`` is the time column followed by tie-breaks; with ``keys`` it names a row. What ``keep`` says about a
    row must follow from that row and the last kept row before it. Rows may come in any order, in the same
    batch or later; :func:`read_kept` is always what ``keep`` gives on all rows so far. Entities whose newest row
    is ``finished`` are forgotten at the next compaction; rows that come still later begin them anew. A
    repeated batch is harmless: it reads what came before it and finds its own writes done. ``path``/rows holds
    all rows, for those that come late; in it, folders older than any late row may be deleted at any time.
    """
    place = F.struct(*order)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, schema = batch.sparkSession, StructType(batch.schema.fields)
        kept, carried = _kept_rows(path, keys, order, schema), _carried_rows(path, keys, order, schema)
        rows = batch.persist()
        held = [rows]
        try:
            rows.write.mode("overwrite").parquet(f"{path}/rows/{BATCH}={batch_id}")
            known = carried.current(spark, batch_id)
            touched = _named(rows.groupBy(*keys).agg(F.min(place).alias("_first")), keys, "_first")
            own = known.join(touched, same_key(known, touched, keys)).persist()
            held.append(own)
            late = own.filter(F.col("_first") <= F.col(_NEWEST))
            since = late.agg(F.min(f"_first.{order[0]}").alias("since")).first()["since"]

            before = own.filter(F.col("_first") > F.col(_NEWEST)).select(*batch.columns).withColumn(_WAS, F.lit(True))
            if since is not None:
                # All rows from the first late one on, of the entities that have any, and their kept rows.
                named = _named(late, keys, "_first")
                past = read_or_empty(spark, f"{path}/rows", StructType([*schema.fields, StructField(BATCH, LongType())]))
                past = past.filter((F.col(order[0]) >= since) & (F.col(BATCH) < batch_id))
                past = past.join(named, same_key(past, named, keys)).filter(place >= F.col("_first"))
                so_far = kept.current(spark, batch_id).filter(_KEPT)
                so_far = so_far.join(named, same_key(so_far, named, keys), "left_semi")
                again = past.select(*batch.columns).withColumn(_WAS, F.lit(False)).unionByName(
                    so_far.select(*batch.columns).withColumn(_WAS, F.lit(True))
                )
                others = [c for c in batch.columns if c not in (*keys, *order)]
                again = latest_state(again, [*keys, *order], [_WAS], [*others, _WAS])
                before = before.unionByName(again.select(*batch.columns, _WAS))
            log = rows.withColumn(_WAS, F.lit(None).cast("boolean")).unionByName(before).persist()
            held.append(log)
            judged = keep(log, None if log.limit(target_rows).count() < target_rows else target_rows).persist()
            held.append(judged)
            # Kept rows from before the late ones have only kept rows before them here, and stay kept.
            kept.write(judged.filter(F.col(_KEPT) != F.coalesce(_WAS, F.lit(False))), batch_id)

            done = F.lit(False) if finished is None else F.coalesce(finished, F.lit(False))
            ends = judged.groupBy(*keys).agg(F.max(place).alias(_NEWEST), F.max_by(done, place).alias(_DONE))
            ends = _named(ends, keys, _NEWEST, _DONE)
            last = latest_state(judged.filter(_KEPT), keys, order, [c for c in batch.columns if c not in keys])
            carried.write(last.join(ends, same_key(last, ends, keys)), batch_id)
        finally:
            for frame in held:
                frame.unpersist()

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .start()
    )


def start_change_only(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[str],
    state: Column,
    *,
    always: Column | None = None,
    **options,
) -> StreamingQuery:
    """Keep the rows that change the ``state`` of their entity, its first row included, and all rows for which
    ``always`` holds; read them with :func:`read_kept`. For ``options`` see :func:`start_keeping`."""
    # Wrapped, so that a NULL state on an earlier row is told from having no earlier row.
    current = F.struct(state.alias("state"))

    def keep(log: DataFrame, target_rows: int | None) -> DataFrame:
        if target_rows is None:
            marked = log.withColumn("_previous", F.lag(current).over(Window.partitionBy(*keys).orderBy(*order)))
        else:
            marked = previous_value(log, keys, order, current, "_previous", target_rows)
        kept = ~current.eqNullSafe(F.col("_previous"))
        if always is not None:
            kept = kept | F.coalesce(always, F.lit(False))
        return marked.withColumn(_KEPT, kept).drop("_previous")

    return start_keeping(stream, path, checkpoint, keys, order, keep, **options)


def start_new_samples(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], samples: str, **options
) -> StreamingQuery:
    """Keep the rows whose sample count exceeds every earlier count of their entity (initially 0); read them with
    :func:`read_kept`. A NULL count is no sample. For ``options`` see :func:`start_keeping`."""

    def keep(log: DataFrame, target_rows: int | None) -> DataFrame:
        if target_rows is None:
            earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
            marked = log.withColumn("_most", F.max(samples).over(earlier))
        else:
            marked = running_max_before(log, keys, order, F.col(samples), "_most", target_rows)
        kept = F.coalesce(F.col(samples) > F.greatest("_most", F.lit(0)), F.lit(False))
        return marked.withColumn(_KEPT, kept).drop("_most")

    return start_keeping(stream, path, checkpoint, keys, order, keep, **options)


def last_ticks(
    stream: DataFrame,
    run: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    silence: str,
    lateness: str = "0 seconds",
) -> DataFrame:
    """The newest row of each run once the run has ended, for writing in append mode.

    A run has ended when event time, less ``lateness``, has passed its newest row by ``silence``; a timer in the
    state store then gives out the row and lets the run go. State is one row per run that has not ended. Rows that
    come later than that are dropped, and a run that speaks again after its silence ends once more.
    """
    row = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("row")
    ended = stream.withWatermark(order[0], lateness).groupBy(F.session_window(order[0], silence), *run).agg(row)
    return ended.select(*run, *[F.col("row").getField(c).alias(c) for c in columns])


def start_appends(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the rows a stream gives out for good to a Parquet table."""
    return (
        rows.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .start()
    )
