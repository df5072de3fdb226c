import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows, same_rows
from tidemark.functions.times import bucket
from tidemark.operators.changes import change_only, new_samples_only
from tidemark.operators.snapshots import latest_state
from tidemark.schemas import TABLES
from tidemark.sources.sinks import write_jsonl
from tidemark.sources.streams import file_rows, parquet_stream
from tidemark.sources.tables import read_parquet
from tidemark.streaming import changes, ingest, live
from tidemark.streaming.upserts import UpsertTable

NOW = {"availableNow": True}


@pytest.fixture
def arriving(spark, events, tmp_path):
    """The events as five files in time order, one per micro-batch."""
    folder = tmp_path / "in"
    day = F.dayofmonth("ts")
    for n in range(5):
        events.filter((day > n * 6) & (day <= n * 6 + 6)).coalesce(1).write.mode("append").parquet(str(folder))
    return parquet_stream(spark, str(folder), events.schema, files_per_trigger=1), events.withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture
def shuffled(spark, events, tmp_path):
    """The events as six files, each reaching over the whole month; the last repeats entities of the first alone."""
    folder = tmp_path / "mixed"
    part = F.pmod(F.xxhash64("event_id"), F.lit(6))
    for n in range(6):
        events.filter(part == n).coalesce(1).write.mode("append").parquet(str(folder))
    return parquet_stream(spark, str(folder), events.schema, files_per_trigger=1), events.withColumn("ts", F.col("ts").cast("timestamp"))


KEYS, ORDER = ["user_id"], ["ts", "event_id"]


@pytest.mark.parametrize(("compaction", "target"), [(2, 20), (32, 4_000_000)])
@pytest.mark.parametrize("source", ["arriving", "shuffled"])
def test_change_only_over_batches(spark, request, source, tmp_path, monkeypatch, compaction, target):
    monkeypatch.setattr(changes, "COMPACTION", compaction)
    stream, events = request.getfixturevalue(source)
    out = str(tmp_path / "out")
    always = F.col("value") > 180
    changes.start_change_only(
        stream, out, f"{out}/cp", KEYS, ORDER, F.col("event_type"), always=always, target_rows=target, trigger=NOW
    ).awaitTermination()
    got = changes.read_kept(spark, out, KEYS, ORDER, stream.schema)
    expected = change_only(events, KEYS, ORDER, F.col("event_type"), always=always)
    assert rows(got.select(*expected.columns)) == rows(expected)
    if source == "shuffled":  # some rows were kept for a while
        assert spark.read.parquet(f"{out}/kept/delta").filter("not _kept").count() > 0


@pytest.mark.parametrize(("compaction", "target"), [(2, 20), (32, 4_000_000)])
def test_new_samples_over_batches(spark, shuffled, tmp_path, monkeypatch, compaction, target):
    monkeypatch.setattr(changes, "COMPACTION", compaction)
    stream, events = shuffled
    counted = F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 97 - 3)
    out = str(tmp_path / "out")
    changes.start_new_samples(
        stream.withColumn("n", counted), out, f"{out}/cp", KEYS, ORDER, "n", target_rows=target, trigger=NOW
    ).awaitTermination()
    got = changes.read_kept(spark, out, KEYS, ORDER, stream.withColumn("n", counted).schema)
    expected = new_samples_only(events.withColumn("n", counted), KEYS, ORDER, "n")
    assert got.count() > 10 and rows(got.select(*expected.columns)) == rows(expected)


def test_finished_entities_are_forgotten(spark, arriving, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "COMPACTION", 5)
    stream, _ = arriving
    out = str(tmp_path / "out")
    changes.start_change_only(
        stream, out, f"{out}/cp", KEYS, ORDER, F.col("event_type"), finished=F.col("event_type") == "error", trigger=NOW
    ).awaitTermination()
    carried = spark.read.parquet(f"{out}/carried/base/batch_id=4")
    assert carried.count() > 0 and carried.filter("event_type = 'error'").count() == 0


def test_last_ticks(spark, arriving, tmp_path):
    stream, events = arriving
    out = str(tmp_path / "out")
    ended = changes.last_ticks(stream, KEYS, ORDER, ["ts", "event_id", "value"], "36 hours")
    changes.start_appends(ended, out, f"{out}-cp", NOW).awaitTermination()
    by_user, newest = {}, None
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        by_user.setdefault(r.user_id, []).append(r)
        newest = r.ts
    silent = timedelta(hours=36)
    wanted = [
        (user, a.ts, a.event_id, a.value)
        for user, seen in by_user.items()
        for a, b in zip(seen, [r.ts for r in seen[1:]] + [newest])
        if b >= a.ts + silent
    ]
    assert len(wanted) > 20
    same_rows(spark.read.parquet(out), wanted, "user_id", "ts", "event_id", "value")


def test_upsert_table_stays_small_and_whole(spark, tmp_path):
    """Two hundred batches, one of them twice, and a reader that chose its folders before a compaction."""
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([(0, 0)], "k int, v int")
    table = UpsertTable(path, ["k"], frame.schema, compaction=8)
    early = None
    for n in range(200):
        table.write(spark.createDataFrame([(n % 5, n), (100 + n % 3, n)], frame.schema), n)
        if n == 60:
            early = table.current(spark)
            chosen = rows(early)
            table.write(spark.createDataFrame([(0, -1)], frame.schema), n)  # comes again, and was written
        if n == 65:  # past the compaction at 63
            assert rows(early) == chosen
    assert rows(table.current(spark)) == sorted([(k, 195 + k) for k in range(5)] + [(100, 198), (101, 199), (102, 197)], key=repr)
    folders = list((tmp_path / "t").glob("*/batch_id=*"))
    assert len(folders) <= 2 * 8 + 3
    # What a broken write leaves is not read.
    (tmp_path / "t" / "delta" / "batch_id=200").mkdir()
    assert table.current(spark).count() == 8
    assert rows(table.current(spark, before=195)) != rows(table.current(spark))


def test_live_aggregates_over_batches(spark, arriving, tmp_path):
    stream, events = arriving
    cases = {
        "rollup": (live.live_rollup(stream, timedelta(days=4), ["event_type"], ["value"]), ["timestamp", "event_type"]),
        "latest": (live.live_latest(stream, ["user_id"], ["ts", "event_id"], ["event_id", "event_type"]), ["user_id"]),
        "progress": (live.live_progress(stream, "user_id"), ["user_id"]),
    }
    expected = {
        "rollup": events.groupBy(bucket(F.col("ts"), timedelta(days=4)).alias("timestamp"), "event_type").agg(F.max("value").alias("value")),
        "latest": latest_state(events, ["user_id"], ["ts", "event_id"], ["event_id", "event_type"]),
        "progress": events.groupBy("user_id").agg(F.max("ts").alias("last_tick")),
    }
    for name, (aggregate, keys) in cases.items():
        out = str(tmp_path / name)
        assert live.read_upserts(spark, f"{out}/log", keys, aggregate.schema).count() == 0
        live.start_upserts(aggregate, f"{out}/log", f"{out}/cp", keys, NOW, compaction=2).awaitTermination()
        got = live.read_upserts(spark, f"{out}/log", keys, aggregate.schema)
        assert rows(got.select(*expected[name].columns)) == rows(expected[name])
        assert (tmp_path / name / "log" / "base").exists()


def test_watermark_gives_append_rows(spark, arriving, tmp_path):
    stream, events = arriving
    rolled = live.live_rollup(stream, timedelta(hours=6), ["event_type"], ["value"], watermark="10 minutes")
    out = str(tmp_path / "w")
    (
        rolled.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", f"{out}-cp").trigger(**NOW).start().awaitTermination()
    )
    whole = events.groupBy(bucket(F.col("ts"), timedelta(hours=6)).alias("timestamp"), "event_type").agg(F.max("value").alias("value"))
    got, everything = set(rows(spark.read.parquet(out))), set(rows(whole))
    assert got and got <= everything


MESSAGES = {
    "runs": [
        {"id": "r1", "user": "u", "state": "running", "start": "2024-01-01T00:00:00Z", "end": "2024-01-02T00:00:00+00:00",
         "execution_start": "2024-05-01T00:00:00Z", "timestamp": "2024-05-01T00:00:00Z", "config": json.dumps({"a": 1})},
        {"id": "r2", "state": "running"},
    ],
    "jobs": [
        {"sim_id": "r1", "job_id": "1", "node_count": 2, "time_snapshot": "2024-01-01T00:00:01Z", "time_limit": 60,
         "time_submission": "2024-01-01T00:00:00Z", "time_end": None, "state_current": "RUNNING", "nodes": ["a", "b"]},
        {"sim_id": "r1", "job_id": "2"},
    ],
    "system": [{"sim_id": "r1", "timestamp": "2024-01-01T00:00:01Z", "down_nodes": [], "num_samples": 3, "p_flops": 1.5}],
    "cdus": [{"sim_id": "r1", "timestamp": "2024-01-01T00:00:01Z", "name": "x1", "row": 1, "rack_1_power": 2.5}],
    "cep": [{"sim_id": "r1", "timestamp": "2024-01-01T00:00:01Z", "pue_output": 1.1}],
    "job_power": [{"sim_id": "r1", "job_id": "1", "timestamp": "2024-01-01T00:00:01Z", "power": 7.5}],
}


def test_ingest_of_all_tables(spark, tmp_path):
    sent = [(table, json.dumps(m)) for table, messages in MESSAGES.items() for m in messages]
    sent.append(("jobs", "{not json"))
    write_jsonl(spark.createDataFrame(sent, "topic string, value string"), str(tmp_path / "in"))
    stream = file_rows(spark, str(tmp_path / "in"))
    root = str(tmp_path / "tables")
    for query in ingest.start_ingest_all(stream, root, {t: t for t in TABLES}, NOW).values():
        query.awaitTermination()
    got = {t: read_parquet(spark, f"{root}/{t}") for t in TABLES}
    assert {t: df.count() for t, df in got.items()} == {"runs": 2, "jobs": 1, "system": 1, "cdus": 1, "cep": 1, "job_power": 1}
    for table, df in got.items():
        assert df.drop("seg").schema.simpleString() == TABLES[table].simpleString()
    job = got["jobs"].first()
    assert (job.nodes, job.time_end, job.node_count, str(job.seg)) == (["a", "b"], None, 2, "2024-01-01")
    same_rows(got["runs"].select("id", F.year("ts"), F.get_json_object("config", "$.a")), [("r1", 2024, "1"), ("r2", 2010, None)])


def test_a_row_is_parsed_once(spark):
    sent = spark.createDataFrame([('{"timestamp": "2024-05-01", "power": "x", "sim_id": 1}',), ("[",)], "value string")
    assert rows(ingest.rejects_of(sent, "job_power"), "reason", "fields") == [("not an object", []), ("wrong type", ["power"])]
    for made in (ingest.rejects_of(sent, "cdus"), ingest.decode_table(sent, "cdus")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1, plan


def test_routing(spark, tmp_path):
    sent = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "topic string, value string")
    write_jsonl(sent, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    ingest.start_routing(file_rows(spark, str(tmp_path / "in")), out, f"{out}-cp", NOW).awaitTermination()
    assert rows(spark.read.text(f"{out}/topic=a")) == [("1",), ("3",)]
    assert rows(spark.read.text(f"{out}/topic=b")) == [("2",)]


def test_batches_of_events_are_read_by_all_cores(spark):
    from workloads.registry import Tables
    from workloads.streams import event_stream, finish

    t = Tables(spark, "/root/testdata/sf0.001")
    for in_order in (False, True):
        seen = {}

        def look(batch, number):
            found = batch.agg(F.count("event_id"), F.min("ts"), F.max("ts")).first()
            seen[number] = (batch.select(F.input_file_name()).distinct().count(), *found)

        stream = event_stream(t, in_order)
        finish(stream.writeStream.foreachBatch(look).trigger(availableNow=True).start())
        files = spark.sparkContext.defaultParallelism
        assert sorted(seen) == [0, 1, 2, 3, 4] and sum(s[1] for s in seen.values()) == t.events.count()
        assert {s[0] for s in seen.values()} == {files} and files > 1
        assert in_order == all(seen[n][3] < seen[n + 1][2] for n in range(4))


def test_topics_are_written_by_all_cores(spark, monkeypatch):
    from workloads import streams
    from workloads.registry import Tables

    class Seen(Exception):
        pass

    def look(rows, path, number):
        raise Seen(rows.select(F.spark_partition_id()).distinct().count())

    monkeypatch.setattr(streams, "append_topics", look)
    with pytest.raises(Seen) as seen:
        streams.stream_six_tables(Tables(spark, "/root/testdata/sf0.001"))
    assert seen.value.args[0] == spark.sparkContext.defaultParallelism > 1
