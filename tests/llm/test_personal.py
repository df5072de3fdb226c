"""Personal data: patterns against the plain regexes, the field's programs against all cuts, held-out sentences."""

import itertools
import random
import re

import numpy as np
import pytest

from tidemark.llm import personal
from tidemark.llm.personal import KINDS, Finder, Lattice, Model, Span

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain(text):
    """The four patterns, read as they stand."""
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and sum(doubled) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append(Span(kind, *m.span()))
    return found


def test_base_spans_equal_the_patterns():
    draw = random.Random(4)
    pieces = ["a", "b.c", "@", "x.y", ".", "-", " ", "+", "1", "255", "256", "007", "4111111111111111", "(", ")", "é", "\n", "%"]
    for _ in range(20_000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 25)))
        assert sorted(personal.base_spans(text)) == sorted(plain(text)), text


def test_base_spans_of_real_texts(real):
    for row in real.collect():
        assert sorted(personal.base_spans(row.text or "")) == sorted(plain(row.text or ""))


def all_cuts(grid, scores, transitions):
    """(score, segments) of every way to cut the stretch."""
    tokens, outside = len(grid.places) - 1, len(KINDS)

    def go(at, previous):
        if at == tokens:
            yield 0.0, ()
            return
        for value, rest in go(at + 1, outside):
            yield value, rest
        for row, (i, j, _) in enumerate(grid.segments):
            if i == at:
                for kind in range(outside):
                    for value, rest in go(j, kind):
                        yield value + scores[row, kind] + transitions[previous, kind], ((kind, i, j), *rest)

    return list(go(0, outside))


def test_programs_equal_all_cuts():
    draw = np.random.default_rng(3)
    for _ in range(20):
        segments = [(i, j, [f"{i} {j}"]) for i in range(4) for j in range(i + 1, 5) if draw.random() < 0.5]
        grid = Lattice(list(range(5)), segments)
        features = {f: k for k, (_, _, (f,)) in enumerate(segments)}
        model = Model(features, draw.normal(size=(len(features), 4)), draw.normal(size=(5, 4)))
        cuts = all_cuts(grid, model.scores(grid), model.transitions)
        assert list(max(cuts)[1]) == model.best(grid)
        if not segments:
            continue
        gold = list(cuts[draw.integers(len(cuts))][1])
        value, slope, by_transition = personal.likelihood(grid, model.scores(grid), model.transitions, gold)
        own = next(v for v, cut in cuts if list(cut) == gold)
        assert np.isclose(value, own - np.log(sum(np.exp(v) for v, _ in cuts)))
        for k, x in itertools.product(range(len(segments)), range(4)):
            moved = model.scores(grid)
            moved[k, x] += 1e-5
            higher = personal.likelihood(grid, moved, model.transitions, gold)[0]
            assert np.isclose((higher - value) / 1e-5, slope[k, x], atol=1e-3)
        moved = model.transitions.copy()
        moved[4, 1] += 1e-5
        assert np.isclose((personal.likelihood(grid, model.scores(grid), moved, gold)[0] - value) / 1e-5, by_transition[4, 1], atol=1e-3)


@pytest.fixture(scope="module")
def finder():
    return Finder(personal.fit())


def test_held_out_sentences(finder):
    draw = random.Random(2024)
    right = wrong = missed = 0
    for _ in range(500):
        text, spans = personal.make_sentence(draw)
        found = set()
        for start, end in personal.stretches(text):
            cut = finder._cut(text[start:end], text[start - 1 : start], text[end : end + 1], "")
            found |= {Span(kind, start + a, start + b) for kind, a, b in cut}
        right += len(found & set(spans))
        wrong += len(found - set(spans))
        missed += len(set(spans) - found)
    assert right > 500 and right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_other_spellings(finder):
    def added(text):
        return [(KINDS[s.kind], text[s.start : s.end]) for s in finder.spans(text)[1]]

    assert added("write to jane.doe [at] example [dot] org today") == [("email", "jane.doe [at] example [dot] org")]
    assert added("call (212) 555-0147, ok") == [("phone", "(212) 555-0147")]
    assert added("host 10[.]1[.]20[.]3 is down") == [("ip", "10[.]1[.]20[.]3")]
    for clean in ("in 2024-03-05 at 12:30:45", "version 1.2.3", "took 8548923 ms", "order 4173893178530725", "$1,234.50", "see @name", ""):
        assert finder.spans(clean) == ([], [])


def test_added_spans_overlap_nothing(finder):
    draw = random.Random(8)
    for _ in range(300):
        text = "".join(personal.make_sentence(draw)[0] for _ in range(3))
        base, added = finder.spans(text)
        for s in added:
            assert all(s.end <= o.start or o.end <= s.start for o in [*base, *added] if o is not s)


def test_long_texts(finder):
    for piece in ("a", "1", "1 ", "@", "a@", "1.", "+1(", "x@y.zz ", "\t"):
        finder.spans(piece * 20_000)
    text = "word " * 50_000 + "jane@example.org " + "9" * 50_000
    assert finder.spans(text)[0] == [Span(0, 250_000, 250_016)]


def test_odd_documents(spark, odd_docs, odd_rows, no_docs):
    got = personal.find_personal(odd_docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in odd_rows)
    assert all(r.base == [] for r in got)
    assert personal.find_personal(no_docs).collect() == []


def test_query(spark):
    from tidemark.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in QUERIES["op13_personal_data"](spark, folder).collect()}
    import hashlib

    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        base = sorted(plain(doc.text or ""))
        row = rows[doc.doc_id]
        listed = ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in base)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s.kind == k for s in base) for k in range(4)]
        assert set(filter(None, listed.split(","))) <= set(filter(None, row.spans.split(",")))
