"""Packing documents into sequences by non-negative least squares over length patterns.

1. Documents become pieces of at most the sequence length; each piece knows its rank among the pieces of
   its length.
2. The histogram of lengths, which has one number per possible length, goes to the driver. Patterns of
   two and three lengths that fill a sequence exactly are enumerated, and repeat counts are fitted so that
   the patterns use up the histogram: least squares without negative counts.
3. Counts are rounded down, as far as the histogram allows; lengths left over are packed best-fit, longest
   first, on the histogram.
4. The plan is a table of rank ranges: a piece's length and rank tell its sequence and offset.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, whole_text, written
from tidemark.llm.wordids import word_ids


def patterns(counts: np.ndarray, length: int) -> np.ndarray:
    """Rows of three lengths (the last may be 0) that occur and sum to ``length``, in descending order."""
    there = np.flatnonzero(counts[:length])
    there = there[there > 0]
    have = np.zeros(length + 1, bool)
    have[there] = True
    found = []
    for a in there[::-1]:
        rest = length - a
        # The second is no longer than the first; the third no longer than the second, or none.
        b = there[(there <= min(a, rest)) & (2 * there >= rest)]
        b = b[(b == rest) | have[rest - b]]
        found.append(np.stack([np.full(len(b), a), b, rest - b], axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return rows.astype(np.int64)


def fit_repeats(counts: np.ndarray, rows: np.ndarray, sweeps: int = 6) -> np.ndarray:
    """Non-negative least squares by coordinate descent; patterns of frequent lengths go first, so that
    few patterns get large counts."""
    order = np.argsort(-counts[rows].astype(float).min(axis=1, initial=np.inf, where=rows > 0), kind="stable")
    fitted = np.zeros(len(rows))
    rest = counts.astype(float).tolist()
    triples = rows[order].tolist()
    now = [0.0] * len(triples)
    for _ in range(sweeps):
        moved = 0.0
        for k, (a, b, c) in enumerate(triples):
            if c == 0:
                slope, size = (2 * rest[a], 4) if a == b else (rest[a] + rest[b], 2)
            elif a == b == c:
                slope, size = 3 * rest[a], 9
            elif a == b:
                slope, size = 2 * rest[a] + rest[c], 5
            elif b == c:
                slope, size = rest[a] + 2 * rest[b], 5
            else:
                slope, size = rest[a] + rest[b] + rest[c], 3
            change = max(slope / size, -now[k])
            if change:
                now[k] += change
                rest[a] -= change
                rest[b] -= change
                if c:
                    rest[c] -= change
                moved += abs(change)
        if moved < 0.01 * max(1.0, float(counts.sum())):
            break
    fitted[order] = now
    return fitted


def best_fit(counts: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """(contents, repeats) packing the histogram best-fit, longest first; equal sequences stay together."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    spaces: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(contents: tuple[int, ...], repeats: int, space: int) -> None:
        if space == 0:
            done.append((contents, repeats))
            return
        if not groups[space]:
            heapq.heappush(spaces, space)
        groups[space].append((contents, repeats))

    for size in range(length, 0, -1):
        left = int(counts[size])
        skipped = []
        while left:
            while spaces and spaces[0] < size:
                skipped.append(heapq.heappop(spaces))
            if not spaces:
                # Several of one length to a new sequence.
                each = min(length // size, left)
                put((size,) * each, left // each, length - each * size)
                left %= each
                continue
            space = spaces[0]
            contents, repeats = groups[space].pop()
            if not groups[space]:
                heapq.heappop(spaces)
            each = min(space // size, left)
            used = min(repeats, left // each)
            if used < repeats:
                put(contents, repeats - used, space)
            put(contents + (size,) * each, used, space - each * size)
            left -= used * each
        for space in skipped:
            heapq.heappush(spaces, space)
    return done + [group for listed in groups.values() for group in listed]


@dataclass(frozen=True)
class Plan:
    """Rank ranges: pieces of a length from ``first`` on go to sequences from ``sequence`` on, at ``offset``."""

    sequences: int
    keys: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (lengths.astype(np.int64) << 44) | ranks, side="right") - 1
        return self.sequence[at] + ranks - self.first[at], self.offset[at]


def make_plan(counts: np.ndarray, length: int) -> Plan:
    """``counts[n]`` pieces have length n, up to ``length``."""
    counts = counts.astype(np.int64)
    left = counts.copy()
    groups: list[tuple[tuple[int, ...], int]] = []
    if left[length]:
        groups.append(((length,), int(left[length])))
        left[length] = 0
    rows = patterns(left, length)
    if len(rows):
        fitted = fit_repeats(left, rows)
        for k in np.argsort(-fitted, kind="stable"):
            wanted = int(fitted[k] + 1e-6)
            if not wanted:
                break
            contents = tuple(int(x) for x in rows[k] if x)
            wanted = min(wanted, *(int(left[x]) // contents.count(x) for x in set(contents)))
            if wanted:
                groups.append((contents, wanted))
                for x in contents:
                    left[x] -= wanted
    groups += best_fit(left, length)
    used = np.zeros(length + 1, np.int64)
    ranges = []
    sequence = 0
    for contents, repeats in groups:
        offset = 0
        for size in contents:
            ranges.append((size, int(used[size]), sequence, offset))
            used[size] += repeats
            offset += size
        sequence += repeats
    if (used != counts).any():
        raise AssertionError("the plan does not use up the histogram")
    ranges.sort()
    table = np.array(ranges, np.int64).reshape(-1, 4)
    return Plan(sequence, (table[:, 0] << 44) | table[:, 1], table[:, 1], table[:, 2], table[:, 3])


@dataclass(frozen=True)
class Packing:
    """``pieces``: the written pieces with their ids; ``placement``: where each goes."""

    pieces: DataFrame
    placement: DataFrame
    sequences: int

    def packed(self) -> DataFrame:
        """(``sequence_id``, ``ids``, ``parts``): whole sequences, ids of their pieces put together."""
        placed = self.placement.select("_block", "_row", "sequence_id", "offset")
        parts = F.array_sort(F.collect_list(F.struct("offset", "length", "document", "piece", "ids")))
        return (
            self.pieces.join(placed, ["_block", "_row"])
            .groupBy("sequence_id")
            .agg(parts.alias("parts"))
            .select(
                "sequence_id",
                F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"),
                F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"),
            )
        )


def cut_pieces(
    docs: DataFrame,
    vocabulary_path: str,
    length: int,
    end_id: int,
    *,
    spaces_kept: bool,
    id_column: str,
    text_column: str,
) -> DataFrame:
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), whole_text(text_column).alias("_text"))
    ends = np.array([end_id], "<u4").tobytes()

    def work():
        model = word_ids(vocabulary_path, spaces_kept)
        block, seen, row = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64), 0

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal row
            source, piece, start, size, ids, ranks = [], [], [], [], [], []
            for k, packed in enumerate(model.encode_all(batch.column(1).to_pylist())):
                packed += ends
                total = len(packed) // 4
                for number, at in enumerate(range(0, total, length)):
                    part = packed[4 * at : 4 * (at + length)]
                    n = len(part) // 4
                    source.append(k)
                    piece.append(number)
                    start.append(at)
                    size.append(n)
                    ids.append(part)
                    ranks.append(int(seen[n]))
                    seen[n] += 1
            made = pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(source, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([block] * len(ids), pa.int32()),
                    pa.array(range(row, row + len(ids)), pa.int64()),
                    pa.array(ranks, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["document", "piece", "start", "length", "ids_crc32", "_block", "_row", "_rank", "ids"],
            )
            row += len(ids)
            return made

        return step

    kind = rows.schema["_id"].dataType.simpleString()
    return in_batches(
        rows,
        f"document {kind}, piece int, start bigint, length bigint, ids_crc32 bigint,"
        " _block int, _row bigint, _rank bigint, ids binary",
        work,
        step_rows=256,
    )


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    length: int = 2048,
    *,
    end_id: int = 0,
    spaces_kept: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> Packing:
    """Pack every document, its ids followed by ``end_id``, into sequences of at most ``length`` ids.

    Only documents longer than that are cut, every ``length`` ids. NULL and empty texts hold the end id
    alone. NULL ids, ties and repeated rows are documents like others; other columns are ignored; an empty
    table gives no sequences. The ids are written once, to the shared folder; ranks are counted there, so
    nothing is sorted.
    """
    pieces = written(
        cut_pieces(
            docs, vocabulary_path, length, end_id,
            spaces_kept=spaces_kept, id_column=id_column, text_column=text_column,
        ),
        "packed-pieces",
    )
    # Pieces of one length in one block have ranks 0 to n - 1.
    blocks = pieces.groupBy("length", "_block").agg((F.max("_rank") + 1).alias("n"))
    counts = np.zeros(length + 1, np.int64)
    for row in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    plan = make_plan(counts, length)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_block")) - F.col("n")
    ranked = pieces.drop("ids").join(
        blocks.select("length", "_block", before.alias("_before")), ["length", "_block"]
    )
    columns = ["document", "piece", "start", "length", "ids_crc32", "_block", "_row"]
    rows = ranked.select(*columns, (F.col("_before") + F.col("_rank")).alias("_rank"))

    def work():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sequence, offset = plan.place(batch.column(3).to_numpy(), batch.column(7).to_numpy())
            return pa.RecordBatch.from_arrays(
                [*batch.columns[:7], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"]
            )

        return step

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:7])
    placement = in_batches(rows, f"{kinds}, sequence_id bigint, offset bigint", work, step_rows=100_000)
    return Packing(pieces, placement, plan.sequences)
