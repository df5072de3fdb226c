"""Recorded job histories made from the test tables: written as files, loaded, stored by time and replayed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.times import naive, parse_instant
from tidemark.plans import histories
from tidemark.plans.replay import replay_nodes
from tidemark.session import shared_dir
from tidemark.sources.tables import read_parquet
from workloads.registry import Tables, query

#: An order as an allocation: it runs for up to nine days; files of odd orders lack the queue.
ALLOCATIONS_SQL = """
    SELECT o_orderkey AS allocation_id, o_orderdate AS begin_time, o_orderdate + to_days((o_orderkey % 10)::INT) AS end_time,
           o_custkey AS num_nodes, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS queue
    FROM orders
"""


def _allocation_files(t: Tables) -> str:
    path = shared_dir(t.spark, "allocations")
    key = F.col("o_orderkey")
    columns = {
        "allocation_id": key, "begin_time": F.col("o_orderdate"),
        "end_time": F.col("o_orderdate") + F.make_dt_interval(days=(key % 10).cast("int")),
        "num_nodes": F.col("o_custkey"), "queue": F.col("o_orderpriority"),
    }
    for odd, names in enumerate([[*columns], ["num_nodes", "end_time", "begin_time", "allocation_id"]]):
        part = t.orders.filter(key % 2 == odd).select(*[columns[n].alias(n) for n in names])
        part.write.mode("append").option("header", "true").csv(path)
    return path


def _stored(t: Tables, table, history: histories.History, name: str):
    path = shared_dir(t.spark, name)
    histories.write(table, history, path)
    return read_parquet(t.spark, path)


@query(f"""
    SELECT * FROM ({ALLOCATIONS_SQL})
    WHERE begin_time <= TIMESTAMP '1997-06-30' AND end_time >= TIMESTAMP '1997-01-01' AND begin_time >= TIMESTAMP '1996-12-25'
""")
def history_csv(t: Tables):
    """CSV files with two kinds of headers, stored by year; half a year is replayed."""
    raw = histories.read_csv_text(t.spark, _allocation_files(t))
    table = _stored(t, histories.load(raw, histories.LASSEN_ALLOCATIONS), histories.LASSEN_ALLOCATIONS, "lassen")
    found = histories.replay(
        table, histories.LASSEN_ALLOCATIONS, parse_instant("1997-01-01"), parse_instant("1997-06-30"),
        zoneless=["begin_time", "end_time"],
    )
    return found.select("allocation_id", "begin_time", "end_time", "num_nodes", "queue")


@query("""
    SELECT l_orderkey AS allocation_id, 'n' || l_linenumber AS node_name, l_partkey AS energy, o_orderdate AS ts
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderdate >= TIMESTAMP '1996-12-29' AND o_orderdate <= TIMESTAMP '1997-06-30'
""")
def history_csv_nodes(t: Tables):
    """Rows of nodes, indexed by the time at which their allocation began, and replayed by it."""
    raw = histories.read_csv_text(t.spark, _allocation_files(t))
    nodes = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("allocation_id"),
        F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("node_name"),
        F.col("l_partkey").cast("string").alias("energy"),
    )
    timed = histories.with_begin_time(nodes, raw, check=False)
    table = _stored(t, histories.load(timed, histories.LASSEN_NODES), histories.LASSEN_NODES, "lassen-nodes")
    found = replay_nodes(table, parse_instant("1997-01-01"), parse_instant("1997-06-30"))
    return found.select("allocation_id", "node_name", "energy", naive(F.col("ts")).alias("ts"))


@query("""
    SELECT l_orderkey || '-' || l_linenumber AS jid, l_shipdate AS sdt, l_shipdate + to_days(l_quantity::INT) AS edt,
           l_suppkey AS nnuma, l_extendedprice AS econ, l_returnflag AS "exit state", date_trunc('week', l_shipdate)::DATE AS seg
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1997-06-30' AND l_shipdate + to_days(l_quantity::INT) >= TIMESTAMP '1997-01-01'
      AND l_shipdate >= TIMESTAMP '1996-12-25'
""")
def history_parquet(t: Tables):
    """Parquet files of jobs, stored by week and replayed."""
    path = shared_dir(t.spark, "fugaku-raw")
    t.lineitem.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("jid"),
        F.col("l_shipdate").alias("sdt"),
        (F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_quantity").cast("int"))).alias("edt"),
        F.col("l_suppkey").cast("string").alias("nnuma"), F.col("l_extendedprice").alias("econ"),
        F.col("l_returnflag").alias("exit state"),
    ).write.parquet(path)
    table = _stored(t, histories.load(t.spark.read.parquet(path), histories.FUGAKU), histories.FUGAKU, "fugaku")
    found = histories.replay(
        table, histories.FUGAKU, parse_instant("1997-01-01"), parse_instant("1997-06-30"), zoneless=["sdt", "edt"]
    )
    return found.select("jid", "sdt", "edt", "nnuma", "econ", "exit state", "seg")
