"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _stamp(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s")).first()
    return row["n"], row["s"] or 0


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``component``) of every node in ``links`` (``a``, ``b``: long); component: smallest node.

    Every round joins edges with one minimum per node, combined map-side, and is written to the shared
    folder, so lineage stays short and no node's neighbours meet in one place. Rounds grow with the
    logarithm of a component's size. Links of a node with itself and repeated links do no harm; NULLs are
    no links.
    """
    edges = written(
        links.filter("a IS NOT NULL AND b IS NOT NULL")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    stamp = _stamp(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a OR a = b").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "large-star")
        least = large.filter("a > b").groupBy("a").agg(F.min("b").alias("m"))
        joined = large.filter("a > b").join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(
            joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        loops = large.filter("a = b")
        following = written(small.unionByName(loops).distinct(), "small-star")
        now = _stamp(following)
        if now == stamp:
            break
        edges, stamp = following, now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
