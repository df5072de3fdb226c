import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import licenses, neardup, orderhash, secrets, sharding, toxicity
from tidemark.llm.components import components
from tidemark.session import shared_dir

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# licenses


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("gnu general public license apache mit cc by x é nc".split()), max_size=25), st.sampled_from([" ", ", ", "-"]))
def test_exact_phrases(words, separator):
    count, hits = licenses.Scanner().scan(separator.join(words).encode())
    found = WORD.findall(separator.join(words))
    assert count == len(found)
    wanted = sorted(
        (label, k)
        for phrase, label in licenses.EXACT.items()
        for k in range(len(found))
        if found[k : k + phrase.count(" ") + 1] == phrase.split()
    )
    assert sorted((h.label, h.start) for h in hits if h.exact) == wanted


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_bounded_errors_lose_no_place(data):
    notice = data.draw(st.sampled_from([n for n in licenses.NOTICES if n.edits]))
    text = f" {notice.phrase} "
    for _ in range(notice.edits):
        at = data.draw(st.integers(1, len(text) - 2))
        kind = data.draw(st.sampled_from("ids"))
        new = data.draw(st.sampled_from("qxz"))
        text = text[:at] + ("" if kind == "d" else new) + text[at + (kind != "i") :]
    _, hits = licenses.Scanner((notice,), {}).scan(("yy" + text + "yy").encode())
    near = distance(" ".join(text.split()), notice.phrase) <= notice.edits
    assert not near or notice.label in {h.label for h in hits}


def test_license_scan(odd_docs, no_docs):
    rows = licenses.scan_licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    first = next(r for r in rows if r.doc_id == 1)
    assert [(h.label, h.start, h.end, h.edits, h.exact) for h in first.hits] == [("apache", 3, 5, 0, True)]
    assert {r.doc_id: r.n_words for r in rows if r.doc_id in (2, 3, 4)} == {2: 0, 3: 0, 4: 0}
    assert licenses.scan_licenses(no_docs).count() == 0


# secrets


def secrets_by_hand(text):
    found = []
    for number, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if len(m.group(rule.group)) >= rule.at_least:
                found.append((m.start(), number, m.end()))
    return sorted(found)


PARTS = st.sampled_from(
    ["token", "Api_Key", "SECRET", "=", ": ", '"', "abcdef12", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "é🙂", " ", "ghp_", "x", "passwd"]
)


def test_spans_equal_search_by_hand(spark):
    texts: list[str] = []
    settings(max_examples=300, deadline=None)(given(st.lists(PARTS, max_size=20))(lambda p: texts.append("".join(p))))()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secrets.scan(docs, shared_dir(spark, "test-ledger")).collect()
    assert {r.path: [(s.start, s.kind, s.end) for s in r.spans] for r in rows} == {
        k: secrets_by_hand(t) for k, t in enumerate(texts)
    }


def test_ledger_scans_only_what_is_new(spark, odd_docs, odd_rows, no_docs):
    ledger = shared_dir(spark, "test-ledger")
    first = secrets.scan(odd_docs, ledger).collect()
    assert sorted((str(r.path), str([tuple(s) for s in r.spans])) for r in first) == sorted(
        (str(i), str([(a, k, b) for a, k, b in secrets_by_hand(t or "")])) for i, t in odd_rows
    )
    folder = f"{ledger}/rules={secrets.rule_version()}/*"
    known = spark.read.schema(secrets.FINDINGS).parquet(folder).count()
    assert known == len({t or "" for _, t in odd_rows})
    more = odd_docs.limit(5).unionByName(odd_docs.limit(1).withColumn("text", F.lit("token = abcdefgh")))
    again = secrets.scan(more, ledger)
    assert again.count() == 6
    assert spark.read.schema(secrets.FINDINGS).parquet(folder).count() == known + 1
    assert secrets.scan(no_docs, ledger).count() == 0
    other = secrets.scan(odd_docs, ledger, secrets.RULES[:1])
    assert other.filter("exists(spans, s -> s.kind > 0)").count() == 0


def test_redaction(spark):
    rows = spark.createDataFrame(
        [("é token=abcdefgh1 x", [(2, 0, 17)]), ("abcdefgh", [(0, 0, 4), (2, 1, 6)]), ("plain", [])],
        f"text string, spans array<{secrets.SPAN}>",
    )
    got = [r[0] for r in rows.select(secrets.redact(F.col("text"), F.col("spans"))).collect()]
    assert got == ["é [SECRET] x", "[SECRET]gh", "plain"]


# sharding


def test_communication_matrix_sums():
    matrix = sharding.communication_matrix([5, 0, 7, 100], [28, 28, 28, 28], 3)
    assert matrix.sum(axis=1).tolist() == [5, 0, 7, 100] and matrix.sum(axis=0).tolist() == [28] * 4
    means = np.mean([sharding.communication_matrix([10, 30], [20, 20], s) for s in range(400)], axis=0)
    assert np.allclose(means, [[5, 5], [15, 15]], atol=0.4)


def test_shards(odd_docs, real, no_docs):
    for docs, n in ((real, 8), (odd_docs, 3), (real.limit(3), 8)):
        rows = sharding.shard_rows(docs, n).collect()
        assert len(rows) == docs.count()
        sizes = [sorted(r.slot for r in rows if r.shard == s) for s in range(n)]
        assert all(slots == list(range(len(slots))) for slots in sizes)
        assert max(map(len, sizes)) - min(map(len, sizes)) <= 1
    by_id = {r.doc_id: r for r in sharding.shard_rows(odd_docs, 3).collect()}
    assert (by_id[2]["size"], by_id[2].text_crc32, by_id[3]["size"]) == (1, 0, 1)
    assert sharding.shard_rows(no_docs, 8).count() == 0


# fingerprints


def test_fingerprints(spark, odd_docs, odd_rows, no_docs):
    rows = orderhash.fingerprints(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    marks = {}
    for r in rows:
        marks.setdefault(r.text, set()).add(tuple(r.signature))
    assert all(len(found) == 1 for found in marks.values())
    assert marks[""] == {()} and marks[" \n\t "] == {()}
    assert orderhash.fingerprints(no_docs).count() == 0


def occurrences(words, kmer):
    seen, made = {}, []
    for k in range(len(words) - kmer + 1):
        gram = tuple(words[k : k + kmer])
        made.append((gram, seen.get(gram, 0)))
        seen[gram] = seen.get(gram, 0) + 1
    return made


def test_signature_follows_occurrences_and_order(spark):
    draw = np.random.default_rng(1)
    base = [f"w{k}" for k in draw.integers(0, 40, 400)]
    swapped = base[200:] + base[:200]
    doubled = base + base
    texts = [" ".join(x) for x in (base, swapped, doubled, [f"v{k}" for k in range(400)])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = {r.doc_id: list(r.signature) for r in orderhash.fingerprints(rows).collect()}
    share = lambda a, b: len(set(marks[a]) & set(marks[b])) / 64
    assert share(0, 3) == 0 and 0 < share(0, 1) < 1 and 0 < share(0, 2) < 1
    # A doubled text has each k-mer under two numbers or more; the set of numbered k-mers differs.
    assert len(set(occurrences(base, 2))) < len(set(occurrences(doubled, 2)))


def test_next_document(spark, odd_docs):
    docs = spark.createDataFrame([(k, f"text {k} " * (k + 1)) for k in range(40)], "doc_id long, text string")
    rows = {r._id: r for r in orderhash.with_next(docs, buckets=7).collect()}
    assert len(rows) == 40
    marks = {r.doc_id: list(r.signature) for r in orderhash.fingerprints(docs).collect()}
    for k in range(40):
        following = k - 1 if k else 39
        assert rows[k]._next_text == f"text {following} " * (following + 1)
        assert list(rows[k]._next_mark) == marks[following]
    odd = orderhash.with_next(odd_docs, buckets=3).collect()
    assert len(odd) == odd_docs.count() and all(r._next_text is not None for r in odd)


# near duplicates


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not found:
        return frozenset()
    return frozenset([tuple(found)] if len(found) < words else [tuple(found[k : k + words]) for k in range(len(found) - words + 1)])


def components_by_hand(sets, percent):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                parent[max(root(x), root(y))] = min(root(x), root(y))
    return [root(x) for x in range(len(sets))]


def near_copies(seed, groups, copies):
    draw = np.random.default_rng(seed)
    texts = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in draw.integers(0, 10_000, 120)]
        for _ in range(copies):
            words = list(base)
            for at in draw.integers(0, len(words), draw.integers(0, 9)):
                words[at] = f"new{draw.integers(0, 10**9)}"
            texts.append(" ".join(words))
    return texts


def test_near_duplicates(spark, real):
    texts = near_copies(7, 3, 60) + [r.text for r in real.limit(60).collect()] + ["", None, "a b", "A  B", "a b c"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in neardup.near_duplicates(docs, words=4).collect()}
    sets = [shingles(t, 4) for t in texts]
    wanted = components_by_hand(sets, 80)
    assert len(set(wanted)) > 10
    for k in range(len(texts)):
        assert rows[k].n_shingles == len(sets[k])
        assert (rows[k].component_id, rows[k].kept) == (wanted[k], wanted[k] == k), k


def test_near_duplicates_of_odd_rows(odd_docs, odd_rows, no_docs):
    rows = neardup.near_duplicates(odd_docs, words=4).collect()
    assert len(rows) == len(odd_rows)
    six = [r for r in rows if r.doc_id in (6, 7)]
    assert {r.component_id for r in six} == {6} and [r.kept for r in sorted(six, key=lambda r: r.doc_id)] == [True, True, False]
    assert all(not r.kept for r in rows if r.doc_id is None)
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2, 3, 4}
    assert neardup.near_duplicates(no_docs).count() == 0


def test_near_duplicates_with_many_null_and_repeated_ids(spark):
    """Texts are looked up by id and text: 300 rows without an id, and 300 with one, cost 600 lookups."""
    texts = near_copies(11, 20, 30)
    rows = [(None if k % 2 else 7, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = neardup.signatures(docs, 4, 2, 2, 3, 5).filter("set_key IS NOT NULL")
    wanted = signed.select("_id", "text_key", "set_key").distinct().withColumn("number", F.xxhash64("set_key"))
    assert neardup._class_sets(docs, wanted, 4, "doc_id", "text").count() == len(set(texts))
    roots = components_by_hand([shingles(t, 4) for t in texts], 80)
    named = {root for root, (doc_id, _) in zip(roots, rows) if doc_id == 7}
    wanted = Counter((doc_id, 7 if root in named else None, doc_id == 7) for root, (doc_id, _) in zip(roots, rows))
    found = neardup.near_duplicates(docs, words=4).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in found) == wanted


@pytest.mark.parametrize("strangers", [1, 6])
def test_members_of_a_group_are_not_paired_with_each_other(spark, strangers):
    rows = [("s", k, 100, 0, 3) for k in range(5000)] + [("s", 9000 + k, 100, 9000 + k, 4) for k in range(strangers)]
    rows += [("own", k, 100, 0, 5) for k in range(5000)] + [("two", 1, 100, 0, 1), ("two", 9000, 100, 9000, 1)]
    first = spark.createDataFrame(rows, "shingle string, number long, n int, label long, at int")
    pairs = neardup._across(first)
    found = Counter((r.shingle, *sorted((r.number_a, r.number_b))) for r in pairs.collect())
    wanted = {("s", k, 9000 + x) for k in range(5000) for x in range(strangers)} | {("two", 1, 9000)}
    wanted |= {("s", 9000 + x, 9000 + y) for y in range(strangers) for x in range(y)}
    assert set(found) == wanted and set(found.values()) == {1}


def test_parities_bound_differences(spark):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k:], draw.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in (0, 5, 40, 299)]
    table = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "number long, set binary")
    made = {r.number: [r[p] for p in neardup._PARITIES] for r in neardup._parities(table).collect()}
    for x in range(4):
        for y in range(4):
            apart = sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(made[x], made[y]))
            differ = len(set(sets[x]) ^ set(sets[y]))
            assert apart <= differ and (apart == 0) == (x == y) and (differ - apart) % 2 == 0


def test_least_ids_of_heavy_and_light_components(spark):
    rows = [(str(k), None if k % 3 == 0 else 5000 - k, 1 if k < 3000 else k) for k in range(4000)]
    classes = spark.createDataFrame(rows, "set_key string, _id long, component long")
    found = {r.set_key: r.component_id for r in neardup._with_least_id(classes).collect()}
    assert len(found) == 4000
    assert {found[str(k)] for k in range(3000)} == {5000 - 2999}
    assert all(found[str(k)] == (None if k % 3 == 0 else 5000 - k) for k in range(3000, 4000))


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


# toxicity


def test_toxicity_learns_and_meets_misspellings(spark, odd_docs, no_docs):
    draw = np.random.default_rng(5)
    bad = ["horrible", "disgusting", "idiotic"]
    rows, marks = [], []
    for k in range(700):
        words = [f"w{x}" for x in draw.integers(0, 300, 40)]
        toxic = int(k % 5 == 0)
        if toxic:
            words[3], words[20] = draw.choice(bad, 2)
        rows.append((k, " ".join(words)))
        marks.append((k, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [r.doc_id for r in docs.filter(toxicity.held_out("doc_id")).collect()]
    assert len(held) > 80
    assert np.mean([(scored[k] >= 0.5) == (k % 5 == 0) for k in held]) > 0.95
    pair = ["w1 w2 horribble w9 disgustingg w4", "w1 w2 w7 w9 w8 w4"]
    a, b = (model.scorer().score(t) for t in pair)
    assert a > b
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(no_docs, model).count() == 0
    blank = toxicity.fit(no_docs, labels.limit(0))
    assert blank.scorer().score("anything") == pytest.approx(blank.scorer().score(""))
