"""The queries of the operators: whole tables, production parameters, digests of the operators' output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    centroids,
    codec,
    licenses,
    neardup,
    negatives,
    orderhash,
    packing,
    personal,
    secrets,
    sharding,
    tokenfiles,
    toxicity,
    vectors,
)
from tidemark.llm.oracles import ORACLES
from tidemark.session import shared_dir

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    scanned = licenses.scan_licenses(table(spark, folder, "documents"))
    base = F.filter("hits", lambda h: h["exact"])

    def labels(hits):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")

    # Certainty of the best hit: 1 for an exact phrase, less for every edit.
    certainty = F.transform("hits", lambda h: F.lit(1.0) / (1 + h["edits"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(certainty), F.lit(0.0)).alias("score"),
    )


@query
def op2_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return codec.round_trip(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_rows(table(spark, folder, "documents"), 8)


@query
def op4_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"), 0.93)


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack(table(spark, folder, "documents"), vocabulary, 2048, end_id=0)
    return packed.placement.select(
        F.col("document").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"), shared_dir(spark, "blob-ledger"))
    kinds = F.array(*[F.lit(rule.kind) for rule in secrets.RULES])

    def listed(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ","
        )

    def counted(number):
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < secrets.BASE_KINDS)
    return found.select(
        F.col("path").alias("doc_id"),
        counted(0).alias("n_assign"),
        counted(1).alias("n_access"),
        counted(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


@query
def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = orderhash.with_next(table(spark, folder, "documents"))
    length = F.char_length("_text")
    third = F.floor(length / 3).cast("int")
    edited = F.concat(
        F.substring("_text", F.lit(1), length - third), F.substring("_next_text", F.lit(1), third)
    )
    rows = rows.withColumn("_edited", edited).drop("_next_text")
    rows = orderhash.with_fingerprint(rows, F.col("_edited"), "_edited_mark")
    return rows.select(
        F.col("_id").alias("doc_id"),
        length.cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        orderhash.as_text(F.col("_mark")).alias("fingerprint"),
        orderhash.as_text(F.col("_edited_mark")).alias("edited_fingerprint"),
        orderhash.likeness(F.col("_mark"), F.col("_edited_mark")).alias("near_edited"),
        orderhash.likeness(F.col("_mark"), F.col("_next_mark")).alias("near_next"),
    )


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


@query
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    tokenfiles.write_ids(table(spark, folder, "documents"), path, vocabulary, end_id=2)
    return tokenfiles.read_ids(spark, path).select(
        F.col("document").alias("doc_id"), "start", "n_tokens", "ids_crc32"
    )


@query
def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), words=4, percent=80)


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.pmod(F.col("label") + 1, F.lit(10)).cast(rows.schema["label"].dataType)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10)


@query
def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings"), 16, 3)


@query
def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.find_personal(table(spark, folder, "documents"))
    kinds = F.array(*[F.lit(kind) for kind in personal.KINDS])

    def listed(spans):
        texts = F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"]))
        return F.array_join(texts, ",")

    def counted(number):
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    return found.select(
        "doc_id",
        *[counted(number).alias(f"n_{kind}") for number, kind in enumerate(personal.KINDS)],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
