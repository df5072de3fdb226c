"""Order MinHash fingerprints of whole texts, sensitive to edit distance.

K-mers are runs of ``kmer`` words, numbered by occurrence, so that repeats count. Every numbered k-mer gets
one hash, a point on a circle. Each of ``bins`` samplers has an order of its own: the way from its own
point around the circle. It selects the two minimal k-mers, puts them back into text order and hashes
the pair. Two texts agree in a sampler if they share its minimal k-mers in the same order. (One hash per k-mer
and a turned order per sampler, instead of a hash per sampler, is what makes this affordable: texts are hashed
once, not ``bins`` times. Short texts, whose samplers find their k-mers farther around, keep pairs and so order.)

Everything is array functions on longs: a k-mer is its hash in the upper 34 bits and its position in the
lower 30, so sorting longs sorts k-mers and keeps their places. No text that Spark holds has 2^30 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import whole_text

BINS = 64
POSITION_BITS = 30
POSITIONS = (1 << POSITION_BITS) - 1


def _name(name: str, step: str) -> str:
    return f"_{name}_{step}"


def with_fingerprint(frame: DataFrame, text: Column, name: str, kmer: int = 2, bins: int = BINS) -> DataFrame:
    """Adds ``name``, array<int>: for each sampler its number and the hash of its pair.

    Words are separated by ASCII white space. A text of fewer than ``kmer`` words is one k-mer; a text
    without words, or that is NULL, has no k-mers and an empty array. A text of one k-mer has that in all samplers.
    """
    words, kmers, sorted_, numbered, least = (
        _name(name, s) for s in ("words", "kmers", "sorted", "numbered", "least")
    )
    shift = 64 - (bins - 1).bit_length()
    # Each array is a column of its own, so that no step is evaluated twice. Functions are called once a
    # word, so they are kept small.
    plain = text
    for space in "\t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    hashed = F.transform(F.split(plain, " "), lambda w: F.xxhash64(w))
    frame = frame.withColumn(words, F.array_remove(hashed, F.xxhash64(F.lit(""))))
    w = F.col(words)

    def place(h: Column, i: Column) -> Column:
        return F.shiftleft(F.shiftrightunsigned(h, POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("long"))

    runs = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - (kmer - 1), F.lit(0))),
        lambda h, i: place(F.xxhash64(h, *[F.get(w, i + k) for k in range(1, kmer)]), i),
    )
    short = F.transform(F.slice(w, 1, F.least(F.size(w), F.lit(1))), lambda h, i: place(F.xxhash64(w), i))
    frame = frame.withColumn(kmers, F.when(F.size(w) >= kmer, runs).otherwise(short))
    frame = frame.withColumn(sorted_, F.sort_array(F.coalesce(kmers, F.array().cast("array<bigint>"))))
    s = F.col(sorted_)

    def key(x: Column) -> Column:
        return F.shiftrightunsigned(x, POSITION_BITS)

    def same(x: Column, i: Column, back: Column) -> Column:
        """The k-mer ``back`` places before in the sorted array is the same one."""
        return F.coalesce(key(F.get(s, i - back)) == key(x), F.lit(False))

    def occurrence(x: Column, i: Column) -> Column:
        # Equal k-mers are neighbours, so the number is found by doubling and halving, not by counting.
        steps = F.reverse(F.sequence(F.lit(0), F.ceil(F.log2(F.size(s) + 1.0)).cast("int")))
        found = F.aggregate(
            steps,
            F.lit(0),
            lambda acc, k: F.when(
                same(x, i, acc + _power(k)), acc + _power(k)
            ).otherwise(acc),
        )
        return found

    # A k-mer's first occurrence keeps its hash, later ones get the number into it; then all are sorted.
    frame = frame.withColumn(
        numbered,
        F.sort_array(
            F.transform(
                s,
                lambda x, i: F.when(
                    key(F.get(s, i - 1)) == key(x),
                    F.shiftleft(F.shiftrightunsigned(F.xxhash64(key(x), occurrence(x, i)), POSITION_BITS), POSITION_BITS).bitwiseOR(
                        x.bitwiseAND(F.lit(POSITIONS).cast("long"))
                    ),
                ).otherwise(x),
            )
        ),
    )

    def sampler(x: Column) -> Column:
        return F.shiftright(x, shift)

    # A sampler's k-mers are neighbours now; the first two are those with another sampler two places before.
    n = F.col(numbered)
    frame = frame.withColumn(
        least, F.filter(n, lambda x, i: (i < 2) | (sampler(F.get(n, i - 2)) != sampler(x)))
    )
    # From a sampler's point on, the next two k-mers are among these: its own, or the first ones of later samplers.
    m = F.col(least)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((2 * bins).bit_length()))])

    def pair(number: Column) -> Column:
        before = F.aggregate(
            steps, F.lit(0), lambda at, k: F.when(sampler(F.get(m, at + k - 1)) < number - bins // 2, at + k).otherwise(at)
        )
        around = F.transform(F.array(before, before + 1), lambda at: F.get(m, at % F.size(m)))
        return F.transform(F.array(around), lambda ab: hashed_pair(number, F.get(ab, 0), F.get(ab, 1)))[0]

    def hashed_pair(number: Column, a: Column, b: Column) -> Column:
        at = F.lit(POSITIONS).cast("long")
        forward = a.bitwiseAND(at) <= b.bitwiseAND(at)
        mixed = F.when(forward, F.xxhash64(key(a), key(b))).otherwise(F.xxhash64(key(b), key(a)))
        return number * 65536 + F.pmod(mixed, F.lit(65536)).cast("int")

    every = F.array(*map(F.lit, range(bins)))
    frame = frame.withColumn(name, F.when(F.size(m) > 0, F.transform(every, pair)).otherwise(F.array().cast("array<int>")))
    return frame.drop(words, kmers, sorted_, numbered, least)


def _power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def as_text(signature: Column) -> Column:
    """Six hexadecimal digits per filled sampler: its number and its pair."""
    return F.array_join(F.transform(signature, lambda v: F.lpad(F.hex(v), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing samplers among those that either text fills; 1 if neither has any."""
    filled = F.size(F.array_union(*[F.transform(x, lambda v: F.shiftright(v, 16)) for x in (a, b)]))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / filled)


def with_next(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", kmer: int = 2, bins: int = BINS,
    buckets: int | None = None,
) -> DataFrame:
    """(``_id``, ``_text``, ``_mark``, ``_next_text``, ``_next_mark``): every document with its fingerprint
    and those of the next one in descending id order; after the last comes the first.

    Ids are cut into buckets along their quantiles; texts move once, to their bucket. Only the first
    document of each bucket is looked up from elsewhere. Ids are numbers. Rows that share an id (or have
    none; those come last) follow each other by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), whole_text(text_column).alias("_text"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / buckets for k in range(1, buckets)]
    # Bounds need not be exact; they are settled here once.
    bounds = rows.agg(F.percentile_approx("_id", F.array(*map(F.lit, shares)), F.lit(20 * buckets))).first()[0] or []
    bounds = sorted(set(bounds))
    number = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_id"))) if bounds else F.lit(0)
    rows = rows.withColumn("_bucket", F.when(F.col("_id").isNull(), F.lit(-1)).otherwise(number).cast("int"))
    placed = with_fingerprint(rows.repartition("_bucket"), F.col("_text"), "_mark", kmer, bins)
    order = Window.partitionBy("_bucket").orderBy(F.col("_id").desc(), "_text")
    placed = placed.withColumn("_next", F.lead(F.struct("_text", "_mark")).over(order))
    # The first of each bucket: its largest id, and the least text under it.
    tops = rows.groupBy("_bucket").agg(F.max("_id").alias("_id")).collect()
    tops = sorted((r["_bucket"], r["_id"]) for r in tops if r["_bucket"] >= 0)
    has_null = rows.filter("_bucket = -1").limit(1).count() > 0
    chain = [b for b, _ in reversed(tops)] + ([-1] if has_null else [])
    if not chain:
        return placed.select("_id", "_text", "_mark", F.col("_next._text").alias("_next_text"), F.col("_next._mark").alias("_next_mark"))
    before = {b: chain[k - 1] for k, b in enumerate(chain)}
    wanted = F.col("_id").isin([i for _, i in tops]) | F.col("_id").isNull()
    after = F.create_map(*[x for b, p in before.items() for x in (F.lit(b), F.lit(p))])[F.col("_bucket")]
    firsts = (
        rows.filter(wanted)
        .groupBy("_bucket", "_id")
        .agg(F.min("_text").alias("_first_text"))
        .select(after.alias("_bucket"), "_first_text")
    )
    firsts = with_fingerprint(firsts, F.col("_first_text"), "_first_mark", kmer, bins)
    joined = placed.join(firsts, "_bucket", "left")
    return joined.select(
        "_id",
        "_text",
        "_mark",
        F.when(F.col("_next").isNull(), F.col("_first_text")).otherwise(F.col("_next._text")).alias("_next_text"),
        F.when(F.col("_next").isNull(), F.col("_first_mark")).otherwise(F.col("_next._mark")).alias("_next_mark"),
    )


def fingerprints(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", kmer: int = 2, bins: int = BINS
) -> DataFrame:
    """(id, ``text``, ``signature``) of every row; equal texts have equal signatures. NULL texts are empty,
    and empty and blank texts have an empty signature. Repeated rows and NULL ids are rows like others;
    other columns are ignored."""
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), whole_text(text_column).alias("_text"))
    marked = with_fingerprint(rows, F.col("_text"), "_mark", kmer, bins)
    return marked.select(
        F.col("_id").alias(id_column), F.col("_text").alias("text"), F.col("_mark").alias("signature")
    )
