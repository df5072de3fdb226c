"""Order MinHash against a plain version, large hypergeometric draws, concurrent scans, clashing pipeline columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import orderhash, secrets, sharding
from tidemark.llm.queries import QUERIES
from tidemark.session import shared_dir

FOLDER = "/root/testdata/sf0.001"


def hashes(spark, values, columns):
    """Spark's own xxhash64 of rows of plain values."""
    if not values:
        return []
    frame = spark.createDataFrame([(k, *v) for k, v in enumerate(values)], f"k int, {columns}")
    named = [c.split()[0] for c in columns.split(",")]
    return [r[0] for r in frame.orderBy("k").select(F.xxhash64(*named)).collect()]


def by_hand(spark, text, bins=64, kmer=2):
    """Number k-mers by occurrence, give each a point, and walk around the circle from every sampler's point."""
    words = text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    w = hashes(spark, [(x,) for x in words if x], "a string")
    runs = list(zip(w, w[1:])) if len(w) >= kmer else [(x,) for x in w[:1]]
    h = hashes(spark, runs, ", ".join(f"{c} long" for c in "ab"[: len(runs[0])])) if runs else []
    unsigned = [(x & (2**64 - 1)) >> orderhash.POSITION_BITS for x in h]
    seen, repeated = {}, []
    for i, x in enumerate(unsigned):
        if x in seen:
            repeated.append((i, (x, seen[x])))
        seen[x] = seen.get(x, 0) + 1
    again = hashes(spark, [v for _, v in repeated], "a long, b int")
    for (i, _), x in zip(repeated, again):
        unsigned[i] = (x & (2**64 - 1)) >> orderhash.POSITION_BITS
    # Longs are sorted with their sign, so the circle begins at the upper half.
    half = 1 << (63 - orderhash.POSITION_BITS)
    points = sorted(((x + half) % (2 * half), i, x) for i, x in enumerate(unsigned))
    if not points:
        return []
    out, pairs = [], []
    for number in range(bins):
        start = number * 2 * half // bins
        around = [p for p in points if p[0] >= start] + [p for p in points if p[0] < start]
        first, second = around[0], around[1 % len(around)]
        a, b = (first, second) if first[1] <= second[1] else (second, first)
        pairs.append((a[2], b[2]))
    for number, mixed in enumerate(hashes(spark, pairs, "a long, b long")):
        out.append(number * 65536 + mixed % 65536)
    return out


TEXTS = [
    "", "   ", "one", "one two", "one two three", "a b a b a b a b", "x " * 50, " ".join(f"w{k}" for k in range(30)),
    " ".join(f"w{k * k % 211}" for k in range(900)), "tabs\tand\nlines  here",
]


@pytest.mark.parametrize("text", TEXTS)
def test_signatures_by_hand(spark, text):
    frame = orderhash.with_fingerprint(spark.createDataFrame([(text,)], "t string"), F.col("t"), "m")
    assert frame.first().m == by_hand(spark, text)


@pytest.mark.parametrize("words", [20, 40, 400, 4000])
def test_swapped_halves_lose_likeness(spark, words):
    rows = []
    for k in range(20):
        a = [f"{k}w{i}" for i in range(words)]
        rows.append((" ".join(a), " ".join(a[words // 2 :] + a[: words // 2])))
    frame = spark.createDataFrame(rows, "a string, b string")
    for c in "ab":
        frame = orderhash.with_fingerprint(frame, F.col(c), f"m{c}")
    mean = frame.agg(F.avg(orderhash.likeness(F.col("ma"), F.col("mb")))).first()[0]
    assert 0.25 < mean < 0.62


def test_fingerprint_query_by_hand(spark):
    docs = sorted(
        ((r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()), reverse=True
    )
    got = {r.doc_id: r for r in QUERIES["op7_fingerprints"](spark, FOLDER).collect()}
    import hashlib

    assert len(got) == len(docs)
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if k < 3:
            marks = [by_hand(spark, t) for t in (text, edited, after)]
            assert got[i].fingerprint == "".join(f"{v:06X}" for v in marks[0])
            assert got[i].edited_fingerprint == "".join(f"{v:06X}" for v in marks[1])
            likeness = [len(set(marks[0]) & set(m)) / 64 for m in marks[1:]]
            assert np.allclose([got[i].near_edited, got[i].near_next], likeness)


@pytest.mark.parametrize("good, bad, taken", [(6 * 10**8, 6 * 10**8, 10**9), (10**11, 9 * 10**11, 10**10), (5, 2 * 10**9, 10**9)])
def test_large_draws_have_the_hypergeometric_moments(good, bad, taken):
    draw = np.random.default_rng(5)
    total = good + bad
    mean = taken * good / total
    variance = mean * (bad / total) * ((total - taken) / (total - 1))
    many = 300 if variance > 1e6 else 3000
    drawn = np.array([sharding._split(draw, good, bad, taken) for _ in range(many)], float)
    assert abs(drawn.mean() - mean) < 5 * math.sqrt(variance / many)
    assert abs(drawn.var() / variance - 1) < 6 * math.sqrt(2 / many)


def test_large_draws_equal_the_library_below_its_bound():
    draw = np.random.default_rng(6)
    own = np.array([sharding._large_split(draw, 3000, 5000, 2000) for _ in range(6000)])
    theirs = draw.hypergeometric(3000, 5000, 2000, 6000)
    cuts = np.quantile(theirs, np.linspace(0.1, 0.9, 9))
    for c in cuts:
        assert abs((own <= c).mean() - (theirs <= c).mean()) < 0.04


def test_two_scans_of_the_same_blobs(spark):
    docs = spark.createDataFrame([(1, "token = abcdefgh12"), (2, "token = abcdefgh12"), (3, "clean")], "doc_id long, text string")
    ledger = shared_dir(spark, "ledger")
    wanted = sorted((r.path, len(r.spans)) for r in secrets.scan(docs, ledger).collect())
    folder = f"{ledger}/rules={secrets.rule_version()}"
    # What two scans at once leave: the same blobs in two batches.
    once = spark.read.schema(secrets.FINDINGS).parquet(f"{folder}/*").collect()
    spark.createDataFrame(once, secrets.FINDINGS).write.parquet(f"{folder}/batch=other")
    assert sorted((r.path, len(r.spans)) for r in secrets.scan(docs, ledger).collect()) == wanted == [(1, 1), (2, 1), (3, 0)]


def test_pipeline_keeps_columns_of_its_own_names(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "token = abcdefgh12", 77, "s"), (2, "clean", 78, "t")], "doc_id long, text string, _pipeline_row long, _Pipeline_Spans string")
    got = corpus_pipeline.take_out_secrets(spark, docs, "").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "[SECRET]", 77, "s"), (2, "clean", 78, "t")]
