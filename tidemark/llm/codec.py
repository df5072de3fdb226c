"""Byte-level BPE encoding and decoding of document columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import Encoder, decode_bytes, read_ranks, stream_decode
from tidemark.llm.common import in_batches, whole_text

_ENCODERS: dict[tuple[str, str], Encoder] = {}
_TOKENS: dict[str, dict[int, bytes]] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One per worker process, so that what one task has determinised serves the next."""
    key = (ranks_path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(ranks_path), pattern)
    return _ENCODERS[key]


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, ``n_tokens``, ``ids``): ids as little-endian unsigned 32-bit integers, one row per row.

    NULL and empty texts have no ids. Texts are encoded whole, in time proportional to their length.
    Repeated rows, NULL ids and ties are rows like others; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), whole_text(text_column).alias("_text"))

    def work():
        code = encoder(ranks_path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [code.encode(text) for text in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["_id", "n_tokens", "ids"],
            )

        return step

    kind = rows.schema["_id"].dataType.simpleString()
    return in_batches(rows, f"_id {kind}, n_tokens bigint, ids binary", work).withColumnRenamed("_id", id_column)


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``): texts encoded, and the ids decoded again, in one
    Python stage; hashes are lowercase hex of the packed ids and of the decoded bytes.

    As :func:`encode` and :func:`decode` one after the other, but neither ids nor texts go back to the JVM,
    and a worker keeps one set of tables. The decoded text is hashed piece by piece.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), whole_text(text_column).alias("_text"))

    def work():
        code = encoder(ranks_path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, named, decoded = [], [], []
            for text in batch.column(1):
                ids = code.encode(text.as_py())
                digest = hashlib.sha256()
                for piece in stream_decode(np.frombuffer(ids, "<u4"), code.transducer.tokens, step=4096):
                    digest.update(piece.encode())
                counts.append(len(ids) // 4)
                named.append(hashlib.sha256(ids).hexdigest())
                decoded.append(digest.hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(named, pa.string()), pa.array(decoded, pa.string())],
                ["_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return step

    kind = rows.schema["_id"].dataType.simpleString()
    made = in_batches(rows, f"_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", work)
    return made.withColumnRenamed("_id", id_column)


def decode(encoded: DataFrame, ranks_path: str, *, id_column: str = "doc_id") -> DataFrame:
    """(id, ``text``, ``raw``, ``ids_sha256``): ids back to text; ``raw`` are the bytes, which are the
    text's unless ids were cut amid a character. Empty or NULL ids give the empty text."""
    rows = encoded.select(F.col(f"`{id_column}`").alias("_id"), F.coalesce("ids", F.lit(b"")).alias("ids"))

    def work():
        if ranks_path not in _TOKENS:
            _TOKENS[ranks_path] = {rank: token for token, rank in read_ranks(ranks_path).items()}
        tokens = _TOKENS[ranks_path]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = batch.column(1).to_pylist()
            ids = [np.frombuffer(x, "<u4").tolist() for x in packed]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(["".join(stream_decode(x, tokens)) for x in ids], pa.string()),
                    pa.array([decode_bytes(x, tokens) for x in ids], pa.binary()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                ],
                ["_id", "text", "raw", "ids_sha256"],
            )

        return step

    kind = rows.schema["_id"].dataType.simpleString()
    made = in_batches(rows, f"_id {kind}, text string, raw binary, ids_sha256 string", work)
    return made.withColumnRenamed("_id", id_column)
