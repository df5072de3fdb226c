"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. Rows are dealt to source blocks by a hash of their content, and each block is counted.
2. A blocks x shards matrix of counts is drawn: row sums are the block sizes, column sums the shard
   sizes (at most one apart). Its law is that of a uniform shuffle, so no row has to be compared with
   rows of other blocks.
3. Each block is permuted by a second hash and cut at the drawn counts (the exchange).
4. Each shard is permuted again by a third hash; slots are gapless. Shards are ranked in hash ranges,
   so no task sorts a shard.

Only counts reach the driver: blocks x shards and shards x ranges numbers.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import whole_text, written


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Counts with the given row and column sums, distributed as under a uniform shuffle."""
    left = np.array(shard_sizes, dtype=np.int64)
    if sum(block_sizes) != left.sum():
        raise ValueError("block and shard sizes have different sums")
    draw = np.random.default_rng(seed)
    matrix = np.zeros((len(block_sizes), len(left)), dtype=np.int64)
    for block, size in enumerate(block_sizes):
        # One multivariate draw as a chain of two-way splits, which has no limit on the sums.
        rest, wanted = int(left.sum()), int(size)
        for shard in range(len(left)):
            have = int(left[shard])
            rest -= have
            got = wanted if rest == 0 else _split(draw, have, rest, wanted)
            matrix[block, shard] = got
            wanted -= got
        left -= matrix[block]
    return matrix


def _split(draw: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """How many of ``taken`` rows, drawn without replacement, are among the ``good`` ones."""
    if not good or not taken:
        return 0
    if good + bad < 10**9:  # the library's bound
        return int(draw.hypergeometric(good, bad, taken))
    return _large_split(draw, good, bad, taken)


def _large_split(draw: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """The same law by inversion, for any size.

    Neighbouring probabilities have a simple ratio, so relative probabilities follow from the mode outwards, in
    logarithms. 14 standard deviations to either side hold all but 1e-40 of the mass; that many numbers are in
    memory, some millions at 10^12 rows.
    """
    total = good + bad
    mode = (good + 1) * (taken + 1) // (total + 2)
    deviation = math.sqrt(taken * (good / total) * (bad / total) * ((total - taken) / max(1, total - 1)))
    reach = int(14 * deviation) + 50
    least, most = max(0, taken - bad, mode - reach), min(good, taken, mode + reach)
    k = np.arange(least, most, dtype=np.float64)
    ratios = np.log(good - k) + np.log(taken - k) - np.log(k + 1) - np.log(bad - taken + k + 1)
    weights = np.concatenate([[0.0], np.cumsum(ratios)])
    weights = np.exp(weights - weights.max())
    sums = np.cumsum(weights)
    return least + int(np.searchsorted(sums, draw.random() * sums[-1], side="right"))


def shard_rows(
    docs: DataFrame,
    shards: int = 8,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: int = 17,
    blocks: int | None = None,
) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    Shard sizes are at most one row apart. ``size`` is the UTF-8 length of the text plus one; a NULL text
    counts as empty, as does the empty text. NULL ids are shuffled like other ids. Repeated rows are
    separate rows; which of two identical rows gets which slot has no meaning. Other columns are ignored,
    and an empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = blocks or max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = whole_text(text_column)
    rows = docs.select(
        F.col(f"`{id_column}`").alias("_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumns(
        {
            "_block": F.pmod(F.xxhash64(F.lit(seed), "_id", "text_crc32"), F.lit(blocks)).cast("int"),
            "_local": F.xxhash64(F.lit(seed + 1), "_id", "text_crc32"),
            "_final": F.xxhash64(F.lit(seed + 2), "_id", "text_crc32"),
        }
    )
    # Later passes read these few bytes a row, never the texts.
    rows = written(rows, "shard-rows")
    counted = dict(rows.groupBy("_block").count().collect())
    sizes = [counted.get(block, 0) for block in range(blocks)]
    total = sum(sizes)
    targets = [total // shards + (shard < total % shards) for shard in range(shards)]
    cuts = communication_matrix(sizes, targets, seed).cumsum(axis=1).tolist()
    # One literal, folded once, however many blocks there are.
    cut_of_block = F.element_at(F.from_json(F.lit(json.dumps(cuts)), "array<array<bigint>>"), F.col("_block") + 1)
    local = F.row_number().over(Window.partitionBy("_block").orderBy("_local", "_id", "text_crc32"))
    dealt = (
        rows.withColumn("_rank", local)
        .withColumn("shard", F.size(F.filter(cut_of_block, lambda cut: cut < F.col("_rank"))).cast("int"))
        .withColumn("_range", F.shiftrightunsigned("_final", 54))
    )
    dealt = written(dealt.select("_id", "size", "text_crc32", "shard", "_final", "_range"), "shard-dealt")
    # At most shards x 1024 rows.
    offsets = (
        dealt.groupBy("shard", "_range")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(Window.partitionBy("shard").orderBy("_range")) - F.col("_rows"))
        .select("shard", "_range", "_before")
    )
    within = Window.partitionBy("shard", "_range").orderBy("_final", "_id", "text_crc32")
    return (
        dealt.withColumn("_within", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "_range"])
        .select(
            F.col("_id").alias(id_column),
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("_before") + F.col("_within") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
