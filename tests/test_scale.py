"""Reads that touch little of large tables: deep pages, stored grids, Bloom filters."""

import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark.operators.deep import deep_page
from tidemark.operators.grids import Grid, fitting_grid, grid_rollup
from tidemark.operators.options import OptionError
from tidemark.operators.rollup import maxima, rollup
from tidemark.operators.sorting import Sort, page
from tidemark.operators.spans import Span
from tidemark.operators.sweep import overlap_totals
from tidemark.sources import sinks, tables

FIELDS = {"site": "string", "load": "number", "seen": "date", "id": "number"}


@pytest.fixture(scope="module")
def many(spark):
    """A third of all sites are one, some are NULL; loads tie, are NULL or not a number."""
    n = F.col("id")
    site = F.when(n % 3 == 0, "hot").when(n % 50 == 1, None).otherwise(F.concat(F.lit("s"), (n * 7919 % 400).cast("string")))
    load = F.when(n % 11 == 0, None).when(n % 97 == 0, float("nan")).otherwise((n * 31 % 1000) / 8 - 20)
    seen = F.timestamp_seconds(n * 104_729 % 1_000_003)
    return spark.range(20_000).select("id", site.alias("site"), load.alias("load"), seen.alias("seen")).repartition(6).cache()


@pytest.mark.parametrize(
    "order", [["asc:site", "desc:load"], ["desc:site", "asc:load"], ["desc:load"], ["asc:seen"], ["desc:seen", "asc:site"], []]
)
def test_deep_pages_are_pages(many, order):
    sort = Sort.parse(FIELDS, order, ["asc:id"])
    whole = [r.id for r in sort.apply(many).collect()]
    for offset in (0, 4_321, 13_330, 19_990):
        found = deep_page(many, sort, ["id"], 30, offset, small=50)
        assert [r.id for r in found.rows.collect()] == whole[offset : offset + 30], offset
    assert found.total() == 20_000


def test_deep_page_ends(many):
    sort = Sort.parse(FIELDS, ["asc:load"], ["asc:id"])
    assert deep_page(many, sort, ["id"], 10, 20_000).rows.count() == 0
    assert deep_page(many.limit(0), sort, ["id"], 10, 0).rows.count() == 0
    assert deep_page(many, sort, ["id"], 0, 10).rows.count() == 0
    # A page over slot borders, and ties that no key divides.
    assert deep_page(many, sort, ["id"], 6_000, 9_000, small=50).rows.count() == 6_000
    tied = Sort.parse(FIELDS, ["desc:site"])
    assert {r.site for r in deep_page(many, tied, ["site"], 500, 15_000, small=50).rows.collect()} == {
        r.site for r in page(many, tied, ["site"], 500, 15_000).rows.collect()
    }
    with pytest.raises(OptionError):
        deep_page(many, sort, offset=-1)


def test_deep_page_sorts_few_rows(many):
    sort = Sort.parse(FIELDS, ["asc:site"], ["asc:id"])
    found = deep_page(many, sort, ["id"], 10, 10_000, small=500).rows
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Offset and limit together, as each task keeps them.
    kept = int(re.search(r"TakeOrderedAndProject\(limit=(\d+)", plan)[1])
    assert 10 <= kept <= 510
    plain = page(many, sort, ["id"], 10, 10_000).rows._jdf.queryExecution().executedPlan().toString()
    assert int(re.search(r"TakeOrderedAndProject\(limit=(\d+)", plain)[1]) == 10_010


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def test_grids_give_the_rollup(spark, events, tmp_path):
    one, three = (Grid(str(tmp_path / f"g{h}"), timedelta(hours=h), ["user_id", "event_type"], ["value"]) for h in (1, 3))
    span = Span(at("2024-01-02T03:00"), at("2024-01-20T10:30"), timedelta(hours=6))

    def equal(series=events, dims=("event_type",), span=span):
        plain = rollup(series, span, maxima(["value"]), dims)
        assert rows(grid_rollup(series, [one, three], span, ["value"], dims)) == rows(plain)

    equal()  # nothing is stored yet
    early = events.filter(F.col("event_id") % 5 != 0)
    for grid in (one, three):
        grid.extend(early, at("2024-01-05T02:30"))
        grid.extend(early, at("2024-01-05T02:00"))
        assert grid.covered(spark) == int(at("2024-01-05T02:00" if grid is one else "2024-01-05T00:00").timestamp() * 1e6)
        grid.extend(early, at("2024-01-16T07:59"))
    equal(early)
    equal(early, ())
    equal(early, ("event_type", "user_id"))
    # The start is on the finer grid only, then on none.
    odd = Span(at("2024-01-02T04:00"), at("2024-01-20T10:30"), timedelta(hours=6))
    assert fitting_grid([one, three], odd, [], ["value"]) is one and fitting_grid([one, three], span, [], ["value"]) is three
    ragged = Span(at("2024-01-02T04:10"), at("2024-01-20T10:30"), timedelta(hours=6))
    assert fitting_grid([one, three], ragged, [], ["value"]) is None and fitting_grid([one], span, ["other"], []) is None
    equal(early, span=odd)
    equal(early, span=ragged)
    # Rows that come late are taken in, any number of times; those behind the grid are read raw.
    late = events.filter(F.col("event_id") % 5 == 0)
    for grid in (one, three):
        grid.add_late(late)
        grid.add_late(late)
    equal()


def test_stored_buckets_are_not_read_raw(spark, events, tmp_path):
    events.write.parquet(str(tmp_path / "raw"))
    series = spark.read.parquet(str(tmp_path / "raw"))
    grid = Grid(str(tmp_path / "grid"), timedelta(hours=1), ["event_type"], ["value"])
    grid.extend(series, at("2024-01-25T00:00"))
    span = Span(at("2024-01-01T00:00"), at("2024-01-26T00:00"), timedelta(days=1))
    plan = grid_rollup(series, [grid], span, ["value"])._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert len(filters) == 2 and sum(">= 2024-01-25 00:00:00" in line for line in filters) == 1


def test_totals_of_overlaps(spark):
    draw = random.Random(5)
    jobs = [(draw.randrange(300), draw.choice([0, 0, 3, 40, -2]), draw.choice([None, 1, 5])) for _ in range(900)]
    # A third of all jobs begin at one moment.
    jobs = [(a, a + d, m) for a, d, m in jobs] + [(150, 150 + k % 9, 2) for k in range(450)] + [(None, 3, 1), (3, None, 1)]
    spans = [(k, a, a + draw.choice([0, 1, 25])) for k, a in enumerate(range(-5, 350, 2))]
    spans += [(900, None, 4), (901, 10, 3), (902, 100, 101), (903, 100, 101), (904, 5000, 6000)]

    def table(rows, names):
        seconds = [F.timestamp_seconds(c).alias(c) if c in ("a", "b", "span_start", "span_end") else F.col(c) for c in names]
        return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names)).select(*seconds)

    def meets(a, b, lo, hi):
        return None not in (a, b, lo, hi) and a <= b and lo <= hi and a <= hi and b >= lo

    expected = []
    for k, lo, hi in spans:
        met = [m for a, b, m in jobs if meets(a, b, lo, hi)]
        expected.append((k, len(met), sum(m or 0 for m in met)))
    log, asked = table(jobs, ["a", "b", "m"]), table(spans, ["k", "span_start", "span_end"])
    for target in (16, 100_000):
        found = overlap_totals(log, asked, "a", "b", {"total": "m"}, target_rows=target)
        assert sorted(tuple(r) for r in found.select("k", "jobs", "total").collect()) == sorted(expected)
    assert overlap_totals(log.limit(0), asked, "a", "b").filter("jobs <> 0").count() == 0
    assert overlap_totals(log, asked.limit(0), "a", "b").count() == 0
    with pytest.raises(OptionError):
        overlap_totals(log.withColumn("m", F.lit(0.5)), asked, "a", "b", {"total": "m"})
    with pytest.raises(OptionError):
        overlap_totals(log, asked, "a", "b", count="k")


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    key = F.sha2(F.col("id").cast("string"), 256)
    log = spark.range(60_000).select(key.alias("job"), F.timestamp_seconds(F.col("id")).alias("ts"))
    read = {}
    for name, bloom in (("plain", None), ("bloom", {"job": 60_000})):
        path = str(tmp_path / name)
        sinks.write_segmented(log.coalesce(1), path, sort_by=["ts"], bloom=bloom)
        for value, expected in (("missing", 0), ("present", 1)):
            wanted = F.sha2(F.lit("-1" if value == "missing" else "777"), 256)
            found = tables.read_parquet(spark, path).filter(F.col("job") == wanted)
            assert len(found.collect()) == expected
            scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
            read[name, value] = scan.metrics().apply("numOutputRows").value()
    assert read["plain", "missing"] > 0 and read["bloom", "missing"] == 0 and read["bloom", "present"] > 0
