import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark.operators.options import OptionError
from tidemark.sources.topics import Piece, TopicReader, append_topics, lines_between, topic_rows
from tidemark.streaming.ticks import REJECTS, TickStore, start_ticks, visible

NOW = {"availableNow": True}


@settings(max_examples=300, deadline=None)
@given(st.text("ab\n", max_size=40), st.integers(1, 9), st.integers(1, 7))
def test_ranges_side_by_side_give_each_line_once(text, size, chunk):
    data = text.encode()
    ranges = [(b, min(len(data), b + size)) for b in range(0, len(data), size)]
    got = [line for b, e in ranges for part in lines_between(io.BytesIO(data), b, e, chunk) for line in part]
    assert got == data.splitlines()


def write(spark, path, number, *pairs):
    append_topics(spark.createDataFrame(list(pairs), "topic string, value string"), path, number)


def drain(stream, tmp_path, name):
    """What a query (started again with the same name) takes in, all of it so far."""
    out = str(tmp_path / name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-cp").trigger(**NOW).start().awaitTermination()
    return rows(stream.sparkSession.read.schema("topic string, value string").parquet(out))


def test_earliest_latest_and_restart(spark, tmp_path):
    log = f"file:{tmp_path}/a log 100%"
    write(spark, log, 3, ("a", "1"), ("b", "2"), (None, "3"), ("x/y z", "4"))
    assert drain(topic_rows(spark, log), tmp_path, "late") == []
    first = [("a", "1"), ("b", "2"), ("x/y z", "4"), (None, "3")]
    assert drain(topic_rows(spark, log, start="earliest"), tmp_path, "early") == sorted(first, key=repr)
    assert drain(topic_rows(spark, log, "a,x/y z", "earliest"), tmp_path, "some") == [("a", "1"), ("x/y z", "4")]

    write(spark, log, 4, ("a", "ä" * 50), ("a", "5"), ("a", ""))
    new = [("a", ""), ("a", "5"), ("a", "ä" * 50)]
    assert drain(topic_rows(spark, log, piece_bytes=7), tmp_path, "late") == sorted(new, key=repr)
    assert drain(topic_rows(spark, log, start="earliest"), tmp_path, "early") == sorted(first + new, key=repr)
    assert drain(topic_rows(spark, log, start=4), tmp_path, "fourth") == sorted(new, key=repr)
    # Nothing new, nothing twice.
    assert drain(topic_rows(spark, log), tmp_path, "late") == sorted(new, key=repr)
    with pytest.raises(OptionError):
        topic_rows(spark, log, start="newest")


def test_one_large_file_is_read_by_all_cores(spark, tmp_path):
    log = str(tmp_path / "log")
    sent = spark.range(50_000).select(
        F.when(F.col("id") < 49_990, "a").otherwise("b").alias("topic"), F.rpad(F.col("id").cast("string"), 100, ".").alias("value")
    )
    append_topics(sent.coalesce(1), log, 0)
    seen = {}

    def look(batch, number):
        parts = batch.withColumn("task", F.spark_partition_id()).groupBy("topic")
        found = parts.agg(F.countDistinct("task"), F.count("value"), F.countDistinct("value"))
        seen.update({topic: counts for topic, *counts in found.collect()})

    topic_rows(spark, log, start="earliest").writeStream.foreachBatch(look).trigger(**NOW).start().awaitTermination()
    assert spark.sparkContext.defaultParallelism == 4
    assert seen == {"a": [4, 49_990, 49_990], "b": [1, 10, 10]}


def test_small_files_of_a_topic_share_a_task(spark, tmp_path):
    log = str(tmp_path / "log")
    append_topics(spark.range(100).selectExpr("'a' AS topic", "string(id) AS value").repartition(10), log, 0)
    reader = TopicReader({"path": log, "pieces": "4"})
    (piece,) = reader.partitions({"next": 0}, {"next": 1})
    assert isinstance(piece, Piece)
    got = [v for batch in reader.read(piece) for v in batch.column("value").to_pylist()]
    assert sorted(got, key=int) == [str(k) for k in range(100)]


def test_a_batch_without_mark_holds_back_later_ones(spark, tmp_path):
    log = str(tmp_path / "log")
    for number in range(3):
        write(spark, log, number, ("a", str(number)))
    mark = tmp_path / "log" / "batch_id=1" / "_SUCCESS"
    mark.unlink()
    assert drain(topic_rows(spark, log, start="earliest"), tmp_path, "out") == [("a", "0")]
    mark.touch()
    assert len(drain(topic_rows(spark, log, start="earliest"), tmp_path, "out")) == 3


def test_a_log_that_is_not_there_yet(spark, tmp_path):
    log = str(tmp_path / "log")
    assert drain(topic_rows(spark, log), tmp_path, "out") == []
    write(spark, log, 0, ("a", "0"))
    assert drain(topic_rows(spark, log), tmp_path, "out") == [("a", "0")]


def power(job, value="1"):
    return ("p", f'{{"timestamp": "2024-05-01T00:00:00Z", "job_id": "{job}", "power": {value}}}')


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), "topic string, value string")


def jobs_of(spark, store):
    return sorted(r.job_id for r in store.tables(spark)["job_power"].collect())


def test_visible_runs():
    assert visible([(0, 0), (1, 1), (0, 1), (2, 2), (0, 3), (4, 4), (2, 3)]) == [(0, 3), (4, 4)]
    assert visible([]) == []


def test_a_tick_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store = TickStore(str(tmp_path / "s"), {"job_power": "p", "cep": "c"})
    assert jobs_of(spark, store) == []
    store.add(frame(spark, power("a"), ("c", "no object"), ("?", "{}"), (None, "{}"), power("b", '"x"')), 0)
    assert jobs_of(spark, store) == ["a", "b"]
    lost = rows(store.tables(spark)[REJECTS], "topic", "reason", "fields")
    assert lost == sorted([("c", "not an object", []), ("?", "unknown topic", []), (None, "unknown topic", []),
                           ("p", "wrong type", ["power"])], key=repr)

    # Stopped between tables: invisible, and whole once it comes again.
    real = TickStore._write

    def fails(self, rows, table, ticks):
        if table == REJECTS:
            raise RuntimeError("lost")
        real(self, rows, table, ticks)

    monkeypatch.setattr(TickStore, "_write", fails)
    with pytest.raises(RuntimeError):
        store.add(frame(spark, power("c")), 1)
    monkeypatch.undo()
    assert jobs_of(spark, store) == ["a", "b"]
    store.add(frame(spark, power("c")), 1)
    store.add(frame(spark, power("again")), 1)
    assert jobs_of(spark, store) == ["a", "b", "c"]


def test_rows_of_a_tick_are_parsed_once(spark, tmp_path, monkeypatch):
    store, plans = TickStore(str(tmp_path / "s"), {"cdus": "d", "cep": "c"}), {}

    def look(self, rows, table, ticks):
        plans[table] = rows._jdf.queryExecution().optimizedPlan().toString()

    monkeypatch.setattr(TickStore, "_write", look)
    store.add(frame(spark, ("c", "{}")), 0)
    # The plan of the rows kept for the tick, with the one parse, is in each plan once for each use of them.
    for plan in plans.values():
        kept = plan.count("InMemoryRelation")
        assert kept and plan.count("from_json(") + plan.count("get_json_object(") == 2 * kept


def test_ticks_are_merged_and_folders_stay_few(spark, tmp_path):
    store = TickStore(str(tmp_path / "s"), {"job_power": "p"}, merge=3)
    for tick in range(14):
        before = store.tables(spark)["job_power"]
        store.add(frame(spark, power(f"j{tick:02}")), tick)
        # A reader that had chosen its folders before is right still.
        assert before.count() == tick
        assert jobs_of(spark, store) == [f"j{k:02}" for k in range(tick + 1)]
    assert visible(store.marked(spark)) == [(0, 8), (9, 11), (12, 12), (13, 13)]
    assert len(list((tmp_path / "s" / "job_power").glob("ticks=*"))) <= 10


def test_merging_again_after_an_interruption(spark, tmp_path, monkeypatch):
    store = TickStore(str(tmp_path / "s"), {"job_power": "p"}, merge=2)
    store.add(frame(spark, power("a")), 0)
    real = TickStore._mark

    def fails(self, spark, ticks):
        if ticks == (0, 1):
            raise RuntimeError("lost")
        real(self, spark, ticks)

    monkeypatch.setattr(TickStore, "_mark", fails)
    with pytest.raises(RuntimeError):
        store.add(frame(spark, power("b")), 1)
    monkeypatch.undo()
    assert jobs_of(spark, store) == ["a", "b"]
    store.add(frame(spark, power("b")), 1)
    assert visible(store.marked(spark)) == [(0, 1)] and jobs_of(spark, store) == ["a", "b"]


def test_ticks_from_a_topic_log(spark, tmp_path):
    log, store = str(tmp_path / "log"), TickStore(str(tmp_path / "s"), {"job_power": "p"})
    for number, job in enumerate("abc"):
        write(spark, log, number, power(job), ("other", "{}"))
        start_ticks(topic_rows(spark, log, start="earliest"), store, NOW).awaitTermination()
    assert jobs_of(spark, store) == ["a", "b", "c"]
    assert store.tables(spark)[REJECTS].filter(F.col("reason") == "unknown topic").count() == 3
