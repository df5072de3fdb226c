import json
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows, same_rows
from tidemark.operators import changes, lifecycle, lookup, overlap, reshape, skew
from tidemark.operators.rollup import maxima, rollup, rollup_groups
from tidemark.operators.snapshots import as_of, earliest_state, latest_state
from tidemark.operators.spans import Granularity, Span, extent, group_spans

UTC = timezone.utc


def skewed_log(spark, n=3000, seed=1):
    """Half of the rows belong to one key, and half of those fall into a thousandth of the time."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = 0 if i % 2 else rng.randrange(1, 40)
        t = rng.randrange(10**9) if i % 4 else 5 * 10**8 + rng.randrange(10**6)
        state = rng.choice(["a", "b", "c", None]) if rng.random() < 0.5 else "a"
        data.append((i, key, 1704067200 * 10**6 + t * 1000, state, rng.randrange(100)))
    df = spark.createDataFrame(data, "i int, k int, us long, state string, n int")
    return data, df.withColumn("ts", F.timestamp_micros("us"))


def by_key(data):
    groups = defaultdict(list)
    for row in sorted(data, key=lambda r: (r[2], r[0])):
        groups[row[1]].append(row)
    return groups


@pytest.mark.parametrize("target", [10**9, 100, 7])
def test_change_only_with_split_keys(spark, target):
    data, log = skewed_log(spark)
    expected = []
    for group in by_key(data).values():
        last = group[-1][2]
        for before, row in zip([None, *group], group):
            if before is None or before[3] != row[3] or row[4] == 99 or row[2] == last:
                expected.append((row[0],))
    got = changes.change_only(
        log, ["k"], ["ts", "i"], F.col("state"), always=F.col("n") == 99, run=["k"], target_rows=target
    )
    same_rows(got, expected, "i")
    assert got.columns == log.columns


@pytest.mark.parametrize("target", [10**9, 100, 7])
def test_new_samples_with_split_keys(spark, target):
    data, log = skewed_log(spark, seed=2)
    expected = []
    for group in by_key(data).values():
        top = 0
        for row in group:
            if row[4] > top:
                expected.append((row[0],))
                top = row[4]
    same_rows(changes.new_samples_only(log, ["k"], ["ts", "i"], "n", target_rows=target), expected, "i")


def test_slices_follow_the_order_and_are_even(spark):
    _, log = skewed_log(spark)
    sliced = skew.ordered_slices(log, ["k"], ["ts", "i"], 30)
    assert sliced.filter("_slice <> 0 OR _cut").join(skew.hot_keys(log, ["k"], 30), "k", "left_anti").count() == 0
    hot = sliced.filter("k = 0").groupBy("_slice").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).orderBy("_slice").collect()
    assert all(x.b <= y.a for x, y in zip(hot, hot[1:]))
    # Half of the key's rows lie in a thousandth of its time, yet no slice is much above the target.
    assert 45 <= len(hot) <= 55 and max(x.n for x in hot) <= 60


def test_equal_times_and_null_keys_are_cut_alike_each_time(spark):
    df = spark.range(3000).select(
        F.col("id").cast("int").alias("i"), F.when(F.col("id") % 3 == 0, 1).alias("k"),
        F.timestamp_seconds(F.lit(7)).alias("ts"), (F.col("id") % 5).cast("string").alias("state"),
    )
    once = skew.ordered_slices(df, ["k"], ["ts", "i"], 100)
    for key in ("k = 1", "k IS NULL"):
        assert once.filter(key).select("_slice").distinct().count() >= 9
    again = skew.ordered_slices(df.repartition(7, "i"), ["k"], ["ts", "i"], 100)
    assert rows(once.select("i", "_slice"), "i") == rows(again.select("i", "_slice"), "i")
    got = changes.previous_value(df, ["k"], ["ts", "i"], F.col("i"), target_rows=100)
    before = {}
    for row in df.orderBy("i").collect():
        before[row.i] = before.get(("last", row.k))
        before["last", row.k] = row.i
    assert {r.i: r._previous for r in got.collect()} == {k: v for k, v in before.items() if isinstance(k, int)}


def test_building_starts_no_job(spark):
    _, log = skewed_log(spark)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    dim = log.groupBy("k").agg(F.max("n").alias("top"))
    lookup.enrich(log, dim, "k", ["top"])
    changes.change_only(log, ["k"], ["ts", "i"], F.col("state"), run=["k"], target_rows=50)
    spans = group_spans(extent(log, "ts", ["k"]), ["k"], Granularity(resolution=20))
    rollup_groups(log, spans, ["k"], maxima(["n"]))
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("tests", "")


def test_lookups_take_facts_with_maps_inside(spark):
    facts = spark.range(10).select(F.col("id").alias("k"), F.struct(F.create_map(F.lit("a"), "id").alias("m")).alias("s"))
    dim = spark.range(5).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    assert lookup.enrich(facts, dim, "k", ["v"]).filter("v = 1").count() == 5


def test_changes_then_latest_is_latest(spark):
    _, log = skewed_log(spark)
    kept = changes.change_only(log, ["k"], ["ts", "i"], F.col("state"), target_rows=50)
    a = latest_state(kept, ["k"], ["ts", "i"], ["state"])
    b = latest_state(log, ["k"], ["ts", "i"], ["state"])
    assert rows(a) == rows(b)


def test_hot_keys(spark):
    _, log = skewed_log(spark)
    assert rows(skew.hot_keys(log, ["k"], 400)) == [(0, 4)]


def test_latest_earliest_and_time_travel(spark):
    data, log = skewed_log(spark)
    groups = by_key(data)
    same_rows(latest_state(log, ["k"], ["ts", "i"], ["i", "state"]), [(k, g[-1][0], g[-1][3]) for k, g in groups.items()])
    same_rows(earliest_state(log, ["k"], ["ts", "i"], ["i", "state"]), [(k, g[0][0], g[0][3]) for k, g in groups.items()])
    end = log.agg(F.max("ts")).first()[0].replace(tzinfo=UTC)
    assert rows(latest_state(as_of(log, end), ["k"], ["ts", "i"], ["i"])) == rows(latest_state(log, ["k"], ["ts", "i"], ["i"]))
    past = datetime.fromtimestamp(1704067200 + 500, UTC)
    cut = {k: [r for r in g if r[2] <= (1704067200 + 500) * 10**6] for k, g in groups.items()}
    same_rows(latest_state(as_of(log, past), ["k"], ["ts", "i"], ["i"]), [(k, g[-1][0]) for k, g in cut.items() if g])


def test_rollup_groups_equals_single_rollups(spark):
    _, log = skewed_log(spark)
    granularity = Granularity(resolution=20)
    spans = group_spans(extent(log, "ts", ["k"]), ["k"], granularity)
    got = rollup_groups(log, spans, ["k"], maxima(["n"]), ["state"])
    expected = []
    for bounds in extent(log, "ts", ["k"]).collect():
        span = Span.resolve(bounds.extent_start, bounds.extent_end, granularity)
        single = rollup(log.filter(F.col("k") == bounds.k), span, maxima(["n"]), ["state"])
        expected += [(bounds.k, *r) for r in single.collect()]
    same_rows(got, expected)


def test_rollup_keeps_totals_and_order(spark):
    _, log = skewed_log(spark)
    span = Span.resolve("2024-01-01T00:00:07Z", "2024-01-01T00:16:00Z", Granularity(width=13.7))
    got = rollup(log, span, {"rows": F.count(F.lit(1))}, ["k"])
    assert got.agg(F.sum("rows")).first()[0] == span.restrict(log).count()
    order = [(r.timestamp, r.k) for r in got.collect()]
    assert order == sorted(order)
    only_time = rollup(log, span, {"rows": F.count(F.lit(1))}, ["k"], ["rows"])
    assert only_time.columns == ["timestamp", "rows"] and only_time.count() == got.count()


def test_rollup_has_map_side_aggregation_and_pushdown(spark, events):
    span = Span.resolve("2024-01-05", "2024-01-06", Granularity(width=60))
    plan = rollup(events, span, maxima(["value"]), ["event_type"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max(value" in plan and "GreaterThanOrEqual(ts" in plan and "user_id" not in plan


def test_downsample(spark):
    start = 1704067200
    data = [(r, start + s) for r in (1, 2) for s in range(0, 13 + r)] + [(1, start + 13)]
    df = spark.createDataFrame(data, "r int, s long").withColumn("ts", F.timestamp_seconds("s"))
    expected = [(r, s) for r, s in data if s % 5 == 0 or s == start + 12 + r]
    same_rows(changes.downsample(df, ["r"], "ts", 5), expected, "r", "s")


def test_mask_future_end(spark):
    df = spark.createDataFrame([(1, 5, 4), (1, 5, 5), (None, 5, 9), (1, None, 9)], "a int, b int, t int")
    assert [r.b for r in changes.mask_future_end(df, "a", "b", "t").collect()] == [None, 5, None, None]


def random_intervals(rng, n, span):
    out = []
    for i in range(n):
        a = rng.randrange(span)
        out.append((i, a, a + int(rng.choice([0, 1, 50, 3000, span * 2]) * rng.random())))
    return out


def test_join_spans_equals_brute_force(spark):
    rng = random.Random(3)
    jobs, spans = random_intervals(rng, 400, 20000), random_intervals(rng, 60, 20000)
    jobs += [(900 + i, 7000, 7000 + i) for i in range(200)] + [(2000, 50, 10)]

    def frame(data, *names):
        df = spark.createDataFrame(data, f"{names[0]} int, a long, b long")
        return df.select(names[0], F.timestamp_seconds("a").alias(names[1]), F.timestamp_seconds("b").alias(names[2]))

    got = overlap.join_spans(
        frame(jobs, "j", "began", "ended"), frame(spans, "s", "span_start", "span_end"), "began", "ended",
        bin_width=timedelta(seconds=10),
    )
    expected = [(j, s) for j, a, b in jobs for s, c, d in spans if a <= d and b >= c]
    same_rows(got, expected, "j", "s")


def test_overlap_predicates(spark):
    def ts(day):
        return None if day is None else datetime(2024, 1, day)

    data = [(1, 1, 3), (2, 1, 9), (3, 10, 12), (4, 11, 12), (5, 5, None), (6, None, 5), (7, 9, 11)]
    jobs = spark.createDataFrame([(i, ts(a), ts(b)) for i, a, b in data], "i int, a timestamp, b timestamp").withColumn("ts", F.coalesce("a", F.lit(ts(9))))
    start, end = datetime(2024, 1, 9, tzinfo=UTC), datetime(2024, 1, 10, tzinfo=UTC)
    assert [r[0] for r in rows(overlap.overlapping_closed(jobs, start, end, "a", "b", lookback=None), "i")] == [2, 3, 7]
    assert [r[0] for r in rows(overlap.overlapping_closed(jobs, start, end, "a", "b"), "i")] == [3, 7]
    assert [r[0] for r in rows(overlap.overlapping_open(jobs, start, end, "a", "b"), "i")] == [3, 5, 7]


def test_lookups(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None)], "i int, id string")
    dim = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "id string, at int, v string")
    same_rows(lookup.enrich(facts, dim, "id", ["v"], ["at"]), [(1, "new"), (2, "only"), (3, None), (4, None)], "i", "v")
    same_rows(lookup.orphans(facts, dim, "id"), [(3,), (4,)], "i")
    same_rows(lookup.having_id(facts, dim, "id"), [(1,), (2,)], "i")


def test_names_of(spark):
    data = [(1, [2, 1, 2]), (2, []), (3, None), (4, [9, None])]
    df = spark.createDataFrame(data, "i int, x array<int>")
    dim = spark.createDataFrame([(1, "one"), (2, "two")], "n int, name string")
    got = lookup.names_of(df, ["i"], "x", dim, "n", "name")
    same_rows(got, [(1, ["two", "one", "two"]), (2, []), (3, None), (4, [None, None])])


def test_merge_sides(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, p double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, q double")
    same_rows(reshape.merge_sides(["k"], a, b), [(1, 1.0, None), (2, 2.0, 5.0), (3, None, 6.0)])


def test_flat_keys(spark):
    unit = "simulator[1].datacenter[1].computeBlock[{}].cdu[1].summary.{}"
    readings = {unit.format(1, "m_flow_prim"): 9.0, unit.format(1, "T_sec_r_C"): 1.0, unit.format(12, "W_flow_CDUP_kW"): 2.0, "pue": 1.1}
    df = reshape.long_readings(spark.createDataFrame([(1, readings)], "t int, m map<string,double>"), ["t"], "m")
    wide = reshape.wide_cdus(df, ["t"])
    same_rows(wide, [(1, 1, 1.0, None), (1, 12, None, 2.0)], "t", "cdu", "rack_return_temp", "work_done_by_cdup")
    plant = reshape.wide_plant(df, ["t"])
    assert (plant.first().pue_output, plant.first().htw_flowrate, len(plant.columns)) == (1.1, None, 22)


@pytest.mark.parametrize(
    "paths, problems",
    [
        (["a", "b.c", "b.d", "b['e'].f"], []),
        (["a.b", "a['b']"], [("a/b", "duplicate")]),
        (["a.b", 'a["b"].c[1]'], [("a/b", "nested")]),
        (["a[1]", "a['1']"], []),
        (["a.b[1]['c d']", "a.b[2]", "[3].x"], []),
        (["a..b", "a b", "", "a['']"], [("", "invalid"), ("a b", "invalid"), ("a['']", "invalid"), ("a..b", "invalid")]),
        (["a['x.y']", "a.x.y"], []),
    ],
)
def test_path_conflicts(spark, paths, problems):
    df = spark.createDataFrame([(1, p) for p in paths] + [(2, "a.b")], "r int, path string")
    same_rows(reshape.path_conflicts(df, ["r"]), [(1, *p) for p in problems])


def test_racks(spark):
    df = spark.createDataFrame([(1, 5.0, 0.1, 5.0, 0.1)], "k int, `Rack 1` double, `Loss 1` double, Sum double, Loss double")
    wide = reshape.rack_columns(df, ["k"])
    assert tuple(wide.first()) == (1, 5.0, None, None, 5.0, 0.1, None, None, 0.1)
    same_rows(reshape.racks_to_rows(wide, ["k"]), [(1, 1, 5.0, 0.1)])


def day(n, hour=0):
    return datetime(2024, 1, n, hour)


RUN = "id string, state string, error_messages string, start timestamp, end timestamp, execution_start timestamp, execution_end timestamp, progress_date timestamp, ts timestamp"


def test_progress(spark):
    data = [
        ("seen", "running", None, day(1), day(5), day(1), None, None, day(1)),
        ("past", "running", None, day(1), day(5), day(1), None, None, day(1)),
        ("early", "running", None, day(2), day(5), day(1), None, None, day(1)),
        ("new", "running", None, day(1), day(5), day(1), None, None, day(1)),
        ("done", "success", None, day(1), day(5), day(1), day(2), day(5), day(1)),
        ("half", "fail", "x", day(1), day(5), day(1), day(2), day(3), day(1)),
        ("zero", "running", None, day(1), day(1), day(1), None, None, day(1)),
    ]
    seen = [("seen", day(2)), ("past", day(9)), ("early", day(1)), ("done", day(2)), ("zero", day(1))]
    ticks = lifecycle.last_seen(spark.createDataFrame(seen, "sim_id string, ts timestamp"))
    got = lifecycle.with_progress(spark.createDataFrame(data, RUN), ticks)
    before_end = day(5) - timedelta(seconds=1)
    expected = [
        ("seen", 0.25, day(2)), ("past", 0.99, before_end), ("early", 0.0, day(1)), ("new", 0.0, day(1)),
        ("done", 1.0, day(5)), ("half", 0.5, day(3)), ("zero", None, day(1) - timedelta(seconds=1)),
    ]
    same_rows(got, expected, "id", "progress", "progress_date")


def test_completion_and_stale_runs(spark):
    data = [(name, "running", None, day(1), day(5), day(1, h), None, None, day(1, h)) for name, h in (("a", 0), ("b", 0), ("c", 0), ("d", 12))]
    log = spark.createDataFrame(data, RUN)
    outcomes = spark.createDataFrame([("a", day(2), None, day(2)), ("b", day(3), "broken", None)], "id string, ended_at timestamp, error string, last_tick timestamp")
    log = log.unionByName(lifecycle.completion_events(log, outcomes))
    state = latest_state(log, ["id"], ["ts"])
    same_rows(
        state,
        [("a", "success", None, day(2), day(5)), ("b", "fail", "broken", day(3), day(1)), ("c", "running", None, None, None), ("d", "running", None, None, None)],
        "id", "state", "error_messages", "execution_end", "progress_date",
    )
    now = datetime(2024, 1, 1, 12, 1, tzinfo=UTC)
    live = spark.createDataFrame([("x",), ("x",)], "id string")
    swept = lifecycle.stale_run_events(state, live, now)
    same_rows(swept, [("c", "fail", lifecycle.CRASH_MESSAGE, now.replace(tzinfo=None))], "id", "state", "error_messages", "execution_end")
    assert lifecycle.stale_run_events(state, spark.createDataFrame([("c",)], "id string"), now).count() == 0


@pytest.mark.parametrize(
    "path, parts",
    [
        ("a", ["a"]),
        ("a.b_2[10].c", ["a", "b_2", "[10]", "c"]),
        ("a['b']", ["a", "b"]),
        ("a[\"it's\"]['say \"hi\"'].x", ["a", "it's", 'say "hi"', "x"]),
        ("['a b']['c.d[1]']", ["a b", "c.d[1]"]),
        ("[3][4]", ["[3]", "[4]"]),
        ("é.ß1", ["é", "ß1"]),
        *[(bad, None) for bad in ("", ".", "a.", "a..b", "a b", "a[]", "a['']", "a['b", "a['b'", "a['b\"]", "a[1", "a[x]", "a[1]b", "['a']b", "a]", "a[1 ]")],
    ],
)
def test_path_reader(spark, path, parts):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(reshape.path_parts(F.col("path")).alias("p")).first().p == parts


def test_plain_spelling(spark):
    cases = {"a.b": "a.b", "['a']['b'][1][\"c\"]": "a.b[1].c", "['a']b": "['a']b", "a['b c'].d": "a['b c'].d", "a['b\"]": "a['b\"]"}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r.path: r.plain for r in df.select("path", reshape.plain_path(F.col("path")).alias("plain")).collect()} == cases


@pytest.mark.parametrize("readings, expected", [
    ({"a": 1.5, "b.c": 2.0, "b['d']": None, 'b["e"].f': 4.0, "b[10]": 5.0, "b[9].x": 6.0, "z.z.z.z": 7.0, "z.z.y": 8.0},
     {"a": 1.5, "b": {"c": 2.0, "d": None, "e": {"f": 4.0}, "[10]": 5.0, "[9]": {"x": 6.0}}, "z": {"z": {"z": {"z": 7.0}, "y": 8.0}}}),
    ({"q['\"\\ é']": 1.0}, {"q": {'"\\ é': 1.0}}),
    ({"a[1]": 1.0, "a['1']": 2.0}, {"a": {"[1]": 1.0, "1": 2.0}}),
    ({"a.b": 1.0, "a['b']": 2.0, "c": 1.0}, 1),
    ({"a": 1.0, "a.b": 2.0, "a.c": 3.0, "b..": 1.0}, 2),
    ({"": 1.0, "x": 2.0}, 1),
])
def test_nested_rows(spark, readings, expected):
    df = spark.createDataFrame([(1, p, v) for p, v in readings.items()], "r int, path string, value double")
    row = reshape.nested_rows(df, ["r"]).select(F.to_json("nested").alias("n"), "conflicts").first()
    if isinstance(expected, int):
        assert row.n is None and row.conflicts >= 1
        wrong = reshape.path_conflicts(df, ["r"]).count()
        assert wrong == expected
    else:
        assert json.loads(row.n) == expected and row.conflicts == 0


def test_nested_values_and_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, "a['it''s']", 1.0), (1, "a[2].b", 3.0), (1, "a.t", None), (None, "a", 2.0), (2, None, 1.0), (2, "a", 1.0)],
        "r int, path string, value double",
    )
    got = reshape.nested_rows(df.replace("a['it''s']", 'a["it\'s"]', "path"), ["r"])
    same_rows(
        got.select("r", "conflicts", reshape.nested_value("nested", ["a", "it's"]), reshape.nested_value("nested", ["a", 2, "b"]),
                   reshape.nested_value("nested", ["a"]), reshape.nested_value("nested", ["a", "t"])),
        [(1, 0, 1.0, 3.0, None, None), (None, 0, None, None, 2.0, None), (2, 1, None, None, None, None)],
    )
    assert reshape.nested_rows(df.limit(0), ["r"]).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_group_is_combined_after_its_join(spark):
    """The join's partitions are not those of the aggregation, so a group is dealt among tasks and combined map-side."""
    log = spark.range(20_000).select((F.col("id") < 0).alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("n"))
    spans = group_spans(extent(log, "ts", ["k"]), ["k"], Granularity(resolution=1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rollup_groups(log, spans, ["k"], maxima(["n"]))
        above, _, below = plan_of(got).partition("SortMergeJoin")
        assert "Exchange hashpartitioning(k" in above and "hashpartitioning(k" in below
        same_rows(got.select("k", "n"), [(False, 19_999)])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_paths_are_read_in_place(spark):
    """Few frequent paths would meet in few tasks of a join on paths."""
    df = spark.createDataFrame([(1, "a.b", 1.0), (1, "a['b']", 2.0), (1, None, 3.0)], "r int, path string, value double")
    assert "Join" not in plan_of(reshape.path_conflicts(df, ["r"]))
    same_rows(reshape.path_conflicts(df, ["r"]), [(1, "a/b", "duplicate")])


@pytest.mark.parametrize("path, parts", [
    (".a", ["a"]), (".[1]", None), ("a.", None), ("a.[1]", None), ("[1]a", None), ("[1].a", ["[1]", "a"]), ("[]", None),
    ("['']", None), ("['a\"]", None), ("[1", None), ("a\n", None), ("['a\n]b']", ["a\n]b"]), ('["it\'s"][2]', ["it's", "[2]"]),
    ("é_1.\U0001d49c", ["é_1", "\U0001d49c"]), ("['[1]']", ["[1]"]), ("a" + ".b" * 20_000, ["a"] + ["b"] * 20_000),
])
def test_odd_paths(spark, path, parts):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(reshape.path_parts(F.col("path")).alias("p")).first().p == parts
