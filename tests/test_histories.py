import gzip
from datetime import datetime, timezone

import pytest

from tests.helpers import same_rows
from tidemark.plans import histories as h
from tidemark.sources.tables import read_parquet

ALLOCATIONS = """,allocation_id,begin_time,end_time,num_nodes,queue
0,10,2019-05-01 10:00:00.5,2019-05-01 12:00:00,4,batch
1,11,2019-05-01 09:00:00,2019-05-20 00:00:00,x,batch
2,12,2019-04-01 09:00:00,2019-05-20 00:00:00,1,batch
3,13,never,,1,batch
"""
NODES = """,allocation_id,node_name,energy
0,10,n1,5
1,10,n2,7
2,11,n1,9
"""


@pytest.fixture
def raw(spark, tmp_path):
    for name, text in (("a", ALLOCATIONS), ("n", NODES)):
        (tmp_path / f"{name}.csv").write_text(text)
    return h.read_csv_text(spark, str(tmp_path / "a.csv")), h.read_csv_text(spark, str(tmp_path / "n.csv"))


def at(*args):
    return datetime(2019, 5, *args, tzinfo=timezone.utc)


def test_load_store_replay(spark, raw, tmp_path):
    table = h.load(raw[0], h.LASSEN_ALLOCATIONS)
    assert table.filter("allocation_id = 13 AND ts = timestamp '2010-01-01' AND begin_time IS NULL").count() == 1
    assert table.filter("num_nodes IS NULL").select("column_1").first()[0] == 1
    h.write(table, h.LASSEN_ALLOCATIONS, str(tmp_path / "t"))
    stored = read_parquet(spark, str(tmp_path / "t"))
    assert {str(r.seg) for r in stored.select("seg").collect()} == {"2019-01-01", "2010-01-01"}
    found = h.replay(stored, h.LASSEN_ALLOCATIONS, at(1, 11), at(2), zoneless=["begin_time"])
    same_rows(found, [(10,), (11,)], "allocation_id")
    everything = h.replay(stored, h.LASSEN_ALLOCATIONS, at(1, 11), at(2), lookback=None)
    same_rows(everything, [(10,), (11,), (12,)], "allocation_id")


def test_nodes_are_indexed_by_their_allocation(raw):
    nodes = h.load(h.with_begin_time(raw[1], raw[0]), h.LASSEN_NODES)
    same_rows(nodes, [(10, "n1", 5), (10, "n2", 7), (11, "n1", 9)], "allocation_id", "node_name", "energy")
    assert nodes.filter("ts = timestamp '2019-05-01 09:00:00'").count() == 1
    with pytest.raises(LookupError):
        h.with_begin_time(raw[1], raw[0].filter("allocation_id = 10"))
    with pytest.raises(ValueError):
        h.replay(nodes, h.LASSEN_NODES, at(1), at(2))


def test_lists_come_as_arrays_or_text(spark):
    for nodes in ("array(1, 2)", "'1,2'"):
        raw = spark.sql(f"SELECT {nodes} AS nodes, '2020-05-05 10:00:00' AS start_time, 7 AS job_id")
        row = h.load(raw, h.MARCONI100).first()
        assert (row.nodes, row.job_id, row.end_time, row.ts) == ([1, 2], 7, None, datetime(2020, 5, 5, 10))


def test_catalogues():
    assert len(h.FUGAKU.columns) == 44 and len(h.MARCONI100.columns) == 34
    assert h.MARCONI100.int_lists[0] == "nodes" and h.FUGAKU.times[0] == "adt"


def test_headers_of_files_are_their_own(spark, tmp_path):
    folder = tmp_path / "with space"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y\n1,2\n")
    (folder / "b.csv").write_text("y,x\n3,4\n")
    (folder / "c.csv").write_text("x\r\n5\r\n")
    (folder / "d.csv").write_text("")
    (folder / "e.csv").write_text("y,x")
    with gzip.open(folder / "f.csv.gz", "wt") as zipped:
        zipped.write("x,y\n6,7\n")
    same_rows(h.read_csv_text(spark, str(folder)), [("1", "2"), ("4", "3"), ("5", None), ("6", "7")], "x", "y")
    # Only beginnings are read: a line that never ends is not met, as it comes second.
    (tmp_path / "long.csv").write_text("x\n" + "1" * 3_000_000)
    assert [r.header for r in h._first_lines(spark, str(tmp_path / "long.csv")).collect()] == ["x"]
