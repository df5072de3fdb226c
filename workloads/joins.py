"""Overlap, lookup and membership queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.functions.times import parse_instant
from tidemark.operators.lookup import enrich, having_id, names_of, orphans
from tidemark.operators.overlap import join_spans, looking_back
from tidemark.operators.sweep import overlap_totals
from tidemark.plans.replay import replay_jobs, replay_summary
from workloads.registry import Tables, query

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_SQL = ", ".join(LINE)

#: A line item as a job that runs from its ship date for as many days as its quantity.
HISTORY_SQL = f"""
    SELECT {LINE_SQL}, l_shipdate AS ts, l_shipdate AS began, l_shipdate + to_days(l_quantity::INT) AS ended,
           l_orderkey || ',' || l_suppkey AS nodes
    FROM lineitem
"""


def history(t: Tables):
    length = F.make_dt_interval(days=F.col("l_quantity").cast("int"))
    return t.lineitem.select(
        *LINE, F.col("l_shipdate").alias("ts"), F.col("l_shipdate").alias("began"),
        (F.col("l_shipdate") + length).alias("ended"),
        F.concat_ws(",", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("nodes"),
    )


@query(f"""
    SELECT {LINE_SQL}, began, ended, [l_orderkey::INT, l_suppkey::INT] AS nodes FROM ({HISTORY_SQL})
    WHERE ts <= TIMESTAMP '1998-08-01' AND ts >= TIMESTAMP '1998-05-25'
      AND began <= TIMESTAMP '1998-08-01' AND ended >= TIMESTAMP '1998-06-01'
""")
def replay_overlap_closed(t: Tables):
    """Jobs meeting two months, looking back a week on event time, node lists as integers."""
    found = replay_jobs(
        history(t), parse_instant("1998-06-01"), parse_instant("1998-08-01"), "began", "ended", int_lists=["nodes"]
    )
    return found.drop("ts")


@query(f"""
    SELECT {LINE_SQL}, time_start, time_end, string_split(xnames, ',') AS xnames FROM (
        SELECT {LINE_SQL}, CASE WHEN l_linenumber > 1 THEN began END AS time_start,
               CASE WHEN l_linenumber < 6 THEN ended END AS time_end, nodes AS xnames FROM ({HISTORY_SQL}))
    WHERE (time_end IS NULL OR time_end > TIMESTAMP '1998-06-01')
      AND time_start IS NOT NULL AND time_start <= TIMESTAMP '1998-08-01'
""")
def replay_overlap_halfopen(t: Tables):
    """Jobs that have started by the end and may still be running."""
    number = F.col("l_linenumber")
    text = {c: F.lit(None).cast("string") for c in "slurm_version account group user name state_current state_reason".split()}
    times = {c: F.lit(None).cast("timestamp_ntz") for c in "time_submission time_eligible time_snapshot".split()}
    jobs = history(t).withColumns({
        **text, **times,
        "allocation_id": F.col("l_partkey"), "job_id": F.col("l_suppkey"),
        "time_limit": F.col("l_orderkey"), "time_elapsed": F.lit(0), "node_count": number,
        "time_start": F.when(number > 1, F.col("began")), "time_end": F.when(number < 6, F.col("ended")),
        "xnames_str": F.col("nodes"),
    })
    found = replay_summary(jobs, parse_instant("1998-06-01"), parse_instant("1998-08-01"))
    return found.select(
        F.col("time_limit").alias("l_orderkey"), F.col("node_count").alias("l_linenumber"),
        F.col("allocation_id").alias("l_partkey"), F.col("job_id").alias("l_suppkey"),
        "time_start", "time_end", "xnames",
    )


@query(f"""
    WITH parts AS (
        SELECT TIMESTAMP '1995-01-01' + to_days(p_size * 40) AS span_start,
               TIMESTAMP '1995-01-01' + to_days(p_size * 40) + to_hours(p_size) AS span_end, count(*) AS n_parts
        FROM part GROUP BY 1, 2)
    SELECT span_start, span_end, n_parts, count(*) AS n_jobs,
           min(began) AS first_began, max(ended) AS last_ended
    FROM ({HISTORY_SQL}) JOIN parts ON began <= span_end AND ended >= span_start
    GROUP BY 1, 2, 3
""")
def range_join_spans(t: Tables):
    """What runs during the maintenance span of any part: jobs meet each distinct span once, as an
    equi-join on time bins, and are summed up per span."""
    start = F.expr("timestamp_ntz '1995-01-01'") + F.make_dt_interval(days=F.col("p_size") * 40)
    spans = t.part.select(
        start.alias("span_start"), (start + F.make_dt_interval(hours=F.col("p_size"))).alias("span_end")
    ).groupBy("span_start", "span_end").agg(F.count(F.lit(1)).alias("n_parts"))
    pairs = join_spans(history(t), spans, "began", "ended", bin_width=timedelta(days=4))
    return pairs.groupBy("span_start", "span_end", "n_parts").agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.min("began").alias("first_began"), F.max("ended").alias("last_ended"),
    )


@query(f"""
    WITH spans AS (SELECT DISTINCT o_orderdate FROM orders),
    met AS (
        SELECT o_orderdate, count(*) AS n_jobs, sum(l_linenumber) AS n_nodes
        FROM ({HISTORY_SQL}) JOIN spans ON began <= o_orderdate + INTERVAL 12 HOUR AND ended >= o_orderdate
        GROUP BY 1)
    SELECT o_orderkey, coalesce(n_jobs, 0) AS n_jobs, coalesce(n_nodes, 0)::BIGINT AS n_nodes
    FROM orders LEFT JOIN met USING (o_orderdate)
""")
def span_totals(t: Tables):
    """Jobs and nodes at work around the time of each order, by running sums in place of pairs."""
    spans = t.orders.select(
        "o_orderkey", F.col("o_orderdate").alias("span_start"),
        (F.col("o_orderdate") + F.expr("interval 12 hours")).alias("span_end"),
    )
    jobs = history(t).withColumn("nodes_used", F.col("l_linenumber").cast("long"))
    found = overlap_totals(jobs, spans, "began", "ended", {"n_nodes": "nodes_used"}, count="n_jobs", target_rows=1000)
    return found.select("o_orderkey", "n_jobs", "n_nodes")


@query(f"""
    SELECT {LINE_SQL}, ts FROM ({HISTORY_SQL})
    WHERE ts >= TIMESTAMP '1998-05-29' AND ts <= TIMESTAMP '1998-08-01'
""")
def lookback_scan(t: Tables):
    found = looking_back(history(t), parse_instant("1998-06-01"), parse_instant("1998-08-01"))
    return found.select(*LINE, "ts")


@query(f"""
    SELECT {LINE_SQL}, d.o_orderdate AS begin_time
    FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') d ON l_orderkey = o_orderkey
""")
def lookup_enrich(t: Tables):
    """Begin time of each line item's order; orders of one status are missing from the dimension."""
    dim = t.orders.filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("begin_time")
    )
    return enrich(t.lineitem.select(*LINE), dim, "l_orderkey", ["begin_time"])


@query("""
    SELECT event_id, user_id, last_type FROM events JOIN (
        SELECT user_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1) USING (user_id)
""")
def lookup_enrich_repeated(t: Tables):
    """A dimension that repeats its keys: the last row of a key is taken."""
    dim = t.events.select("user_id", "event_id", F.col("event_type").alias("last_type"))
    return enrich(t.events.select("event_id", "user_id"), dim, "user_id", ["last_type"], ["event_id"])


@query(f"""
    SELECT {LINE_SQL} FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
""")
def lookup_orphans(t: Tables):
    dim = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return orphans(t.lineitem.select(*LINE), dim, "l_orderkey")


@query("""
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
""")
def semi_in_list(t: Tables):
    ids = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return having_id(t.orders, ids, "o_custkey").select("o_orderkey", "o_totalprice")


@query(f"""
    SELECT {LINE_SQL}, s_name AS name, s_nationkey // 5 AS row, s_nationkey % 5 AS col
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
""")
def dim_lookup(t: Tables):
    """Unit index to its name and position."""
    nation = F.col("s_nationkey")
    dim = t.supplier.select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"),
        F.floor(nation / 5).cast("int").alias("row"), (nation % 5).alias("col"),
    )
    return enrich(t.lineitem.select(*LINE), dim, "l_suppkey", ["name", "row", "col"])


@query(f"""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'O' THEN []
           ELSE [a.n_name, b.n_name, NULL, a.n_name] END AS nodes
    FROM orders JOIN nation a ON a.n_nationkey = o_custkey % 25
                JOIN nation b ON b.n_nationkey = (o_custkey + 7) % 25
""")
def dim_lookup_array(t: Tables):
    """Arrays of node indexes to arrays of names: order kept, repeats and unknown indexes too."""
    first, second = F.col("o_custkey") % 25, (F.col("o_custkey") + 7) % 25
    known = F.transform(F.array(first, second, F.lit(999), first), lambda i: i.cast("int"))
    empty = F.array().cast("array<int>")
    rows = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", known).when(F.col("o_orderstatus") == "O", empty).alias("nodes"),
    )
    return names_of(rows, ["o_orderkey"], "nodes", t.nation, "n_nationkey", "n_name")
