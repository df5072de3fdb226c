"""Secret scans over an incremental blob ledger.

Every version of every text is named by the SHA-256 of its content. The ledger is a folder of findings
per blob and rule version; a scan looks only at blobs the ledger lacks under the present rules, appends
what it finds (also "nothing"), and joins the findings back to all paths that hold the blob. Copies,
unchanged files and reverted versions are scanned once. A change of the rules changes their version, so
everything is due again under the new one.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from tidemark.llm.common import whole_text
from tidemark.sources.tables import read_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java pattern, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int
    at_least: int


#: The first three are fixed values; the others are the operator's own.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 30),
)
#: Texts without a match of this hold no match of the kind that is long enough.
PROBES = {
    "assign": r"(?i:passw|secret|token|api_?key)",
    "hex": r"[0-9a-f]{32}",
}
BASE_KINDS = 3

SPAN = "struct<start: bigint, kind: int, end: bigint>"
FINDINGS = (
    StructType()
    .add("blob", StringType())
    .add("spans", ArrayType(StructType().add("start", LongType()).add("kind", IntegerType()).add("end", LongType())))
)


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_name(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _pieces(text: Column, number: int, rule: Rule) -> Column:
    """The matches of a rule in order, each as (gap before it, length, length of the group that counts).

    Pieces between matches and the matches themselves are all that is needed to know the positions.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length)
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length)
    pairs = F.zip_with(gaps, whole, lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")))
    rows = F.zip_with(
        F.filter(pairs, lambda p: p["size"].isNotNull()),
        value,
        lambda p, v: F.struct(
            F.lit(number).alias("kind"),
            p["gap"].cast("long").alias("gap"),
            p["size"].cast("long").alias("size"),
            (v >= rule.at_least).alias("counts"),
        ),
    )
    probe = F.lit(PROBES.get(rule.kind, rule.pattern))
    return F.when(F.regexp_like(text, probe), rows).otherwise(F.lit(None).cast("array<struct<kind:int,gap:bigint,size:bigint,counts:boolean>>"))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) to (blob, spans): code-point spans, end exclusive, by start, then kind.

    Matches are leftmost and non-overlapping within a kind; those that are too short are dropped after
    matching. Empty texts have no spans.
    """
    empty = F.array().cast("array<struct<kind:int,gap:bigint,size:bigint,counts:boolean>>")
    pieces = [F.coalesce(_pieces(F.col("text"), number, rule), empty) for number, rule in enumerate(rules)]
    rows = blobs.select("blob", F.concat(*pieces).alias("_pieces"))
    # Positions are running sums over the matches of one kind in one blob.
    so_far = Window.partitionBy("blob", "kind").orderBy("_at")
    found = (
        rows.filter(F.size("_pieces") > 0)
        .select("blob", F.posexplode("_pieces").alias("_at", "_piece"))
        .select("blob", "_at", "_piece.*")
        .repartition("blob")
        .withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
        .filter("counts")
        .groupBy("blob")
        .agg(
            F.array_sort(
                F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end"))
            ).alias("spans")
        )
    )
    return found


def scan(
    docs: DataFrame,
    ledger: str,
    rules: tuple[Rule, ...] = RULES,
    *,
    path_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(path, blob, spans) for every row of ``docs``, bringing the ledger folder up to date on the way.

    A NULL text is the empty text and has no spans; a NULL path is kept as a path. Repeated rows come
    back as often as they came. Columns other than the two named ones are ignored. The ledger must be a
    folder all executors share. A scan that fails adds nothing, one that is repeated finds its blobs done.
    Beside its findings the ledger keeps the texts with probe hits of each scan (``-looked``), which may be
    deleted when the scan is over.
    """
    spark = docs.sparkSession
    folder = f"{ledger.rstrip('/')}/rules={rule_version(rules)}"
    versions = docs.select(
        F.col(f"`{path_column}`").alias("path"),
        blob_name(whole_text(text_column)).alias("blob"),
        whole_text(text_column).alias("text"),
    )
    known = read_or_empty(spark, f"{folder}/*", FINDINGS)
    # Combined map-side: however many copies, a task sends each blob once.
    unseen = versions.select("blob", "text").dropDuplicates(["blob"]).join(known.select("blob"), "blob", "left_anti")
    _append(unseen.select("blob", "text"), rules, folder)
    # Scans at the same time may have added the same blobs, with the same findings.
    found = spark.read.schema(FINDINGS).parquet(f"{folder}/*").filter(F.size("spans") > 0)
    found = found.groupBy("blob").agg(F.first("spans").alias("spans"))
    none = F.array().cast(f"array<{SPAN}>")
    return (
        versions.select("path", "blob")
        .join(found, "blob", "left")
        .select("path", "blob", F.coalesce("spans", none).alias("spans"))
    )


def _append(blobs: DataFrame, rules: tuple[Rule, ...], folder: str) -> None:
    """One row per blob, those without findings included. The blobs are written once, with their text
    only where a probe hits, so that a lost executor repeats no shuffle of texts."""
    spark = blobs.sparkSession
    batch = f"{folder}/batch={uuid.uuid4().hex}"
    hit = reduce(
        lambda a, b: a | b, (F.regexp_like("text", F.lit(PROBES.get(r.kind, r.pattern))) for r in rules)
    )
    looked = f"{folder}-looked/batch={uuid.uuid4().hex}"
    blobs.select("blob", F.when(hit, F.col("text")).alias("text")).write.option("compression", "zstd").parquet(looked)
    rows = spark.read.schema("blob string, text string").parquet(looked)
    none = F.array().cast(f"array<{SPAN}>")
    found = scan_blobs(rows.filter("text IS NOT NULL"), rules)
    # What another scan has added meanwhile is left out again.
    since = read_or_empty(spark, f"{folder}/*", FINDINGS).select("blob")
    (
        rows.select("blob")
        .join(since, "blob", "left_anti")
        .join(found, "blob", "left")
        .select("blob", F.coalesce("spans", none).alias("spans"))
        .write.option("compression", "zstd")
        .parquet(batch)
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``[SECRET]``; overlapping spans are replaced as one.

    Goes from left to right once, so its cost follows the text.
    """
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(
                    acc["parts"],
                    F.array(
                        F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                        F.lit("[SECRET]"),
                    ),
                ),
            )
            .otherwise(acc["parts"])
            .alias("parts"),
        ),
        lambda acc: F.concat(
            F.array_join(acc["parts"], ""),
            F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)),
        ),
    )
    return F.when(F.size(spans) > 0, cut).otherwise(text)
