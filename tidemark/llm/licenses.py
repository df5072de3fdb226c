"""License notices in whole texts: exact phrases by words, altered ones by bounded errors.

A text is its words, joined by single spaces. A phrase with at most k edits, cut into k + 1 pieces, keeps
one piece unchanged (pigeonhole), so exact search for the pieces finds every place worth a look. Windows
around them are matched by the regex library with a bound on errors, which reports span and edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, whole_text

#: The phrases that are looked for exactly.
EXACT = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Notice:
    """A phrase of words, its label, and how many edits (insertions, deletions, substitutions) it bears."""

    phrase: str
    label: str
    edits: int


#: Short notices looked for with errors: those above that are long enough, and more.
NOTICES = (
    Notice("gnu general public license", "gpl", 3),
    Notice("apache license", "apache", 1),
    Notice("cc by", "cc-by", 0),
    Notice("mit license", "mit", 1),
    Notice("gnu lesser general public license", "lgpl", 2),
    Notice("gnu affero general public license", "agpl", 2),
    Notice("mozilla public license", "mpl", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("creative commons attribution", "cc-by", 2),
    Notice("creative commons zero", "cc0", 1),
    Notice("cc by nc", "cc-by-nc", 0),
    Notice("cc by sa", "cc-by-sa", 0),
    Notice("cc by nd", "cc-by-nd", 0),
    Notice("isc license", "isc", 0),
    Notice("bsd 2 clause", "bsd", 1),
    Notice("bsd 3 clause", "bsd", 1),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    Notice("all rights reserved", "proprietary", 1),
)

_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """UTF-8 words: digits, letters a-z (A-Z lower-cased) and all characters beyond ASCII."""
    return text.translate(_WORD_BYTES).split()


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly equal length, with their places."""
    cuts = [len(phrase) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


@dataclass(frozen=True)
class Hit:
    label: str
    start: int  #: first word
    end: int  #: word after the last
    edits: int
    exact: bool  #: one of the exact phrases


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES, exact: dict[str, str] = EXACT):
        self.notices = notices
        self.exact = {n.phrase for n in notices if exact.get(n.phrase) == n.label}
        if missing := exact.keys() - self.exact:
            raise ValueError(f"exact phrases must be among the notices: {sorted(missing)}")
        self.patterns = [
            regex.compile(f"(?:{regex.escape(f' {n.phrase} ', literal_spaces=True)}){{e<={n.edits}}}", regex.BESTMATCH)
            for n in notices
        ]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(notices):
            for at, piece in pieces(f" {notice.phrase} ", notice.edits):
                seeds.setdefault(piece, []).append((number, at))
        # Seeds as bytes in Latin-1, so that the automaton runs over the bytes of the text.
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def windows(self, joined: str) -> dict[int, list[tuple[int, int]]]:
        """By notice: stretches, merged where they overlap, outside which it cannot occur."""
        found: dict[int, list[tuple[int, int]]] = {}
        for last, (size, uses) in self.seeds.iter(joined):
            for number, at in uses:
                notice = self.notices[number]
                whole = len(notice.phrase) + 2
                low = max(0, last - size + 1 - at - notice.edits)
                high = last - size + 1 - at + whole + 2 * notice.edits
                stretch = found.setdefault(number, [])
                if stretch and low <= stretch[-1][1]:
                    stretch[-1] = (min(low, stretch[-1][0]), max(high, stretch[-1][1]))
                else:
                    stretch.append((low, high))
        return found

    def places(self, joined: str) -> Iterator[tuple[int, int, str, int, bool]]:
        """(start, number of words, label, edits, exact) with starts in characters."""
        for number, stretches in self.windows(joined).items():
            notice, pattern = self.notices[number], self.patterns[number]
            exact = notice.phrase in self.exact
            phrase = f" {notice.phrase} "
            for low, high in stretches:
                if exact:
                    at = joined.find(phrase, low, high)
                    while at >= 0:
                        yield at + 1, notice.phrase.count(" ") + 1, notice.label, 0, True
                        # The space that ends one place may begin the next.
                        at = joined.find(phrase, at + 1, high)
                for match in pattern.finditer(joined, low, min(high, len(joined))):
                    text = match.group()
                    edits = sum(match.fuzzy_counts)
                    if text.strip() and not (exact and edits == 0):
                        yield match.start() + len(text) - len(text.lstrip()), len(text.split()), notice.label, edits, False

    def scan(self, text: bytes) -> tuple[int, list[Hit]]:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        # Bytes as characters: seeds and phrases are ASCII, and an edit of a letter beyond ASCII counts
        # for each of its bytes.
        hits, seen, first = [], 0, -1
        for start, length, label, edits, exact in sorted(self.places(joined.decode("latin-1"))):
            # The word a place begins in, which may be amid it, as edits may have eaten a space.
            first += joined.count(b" ", seen, start)
            seen = start
            hits.append(Hit(label, first, first + length, edits, exact))
        return len(words), sorted(hits, key=lambda h: (h.start, h.end, h.label, not h.exact))


def scan_licenses(
    docs: DataFrame,
    notices: tuple[Notice, ...] = NOTICES,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, ``n_words``, ``hits``), hits (label, start, end, edits, exact) by their place in words.

    NULL and empty texts have no words and no hits. NULL ids and repeated rows are scanned like others;
    other columns are ignored. The cost follows the length of the text; only stretches around a seed are
    matched with errors.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), whole_text(text_column).cast("binary").alias("_text"))
    hit_type = pa.struct(
        [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("exact", pa.bool_())]
    )

    def work():
        scanner = Scanner(notices)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [scanner.scan(text) for text in batch.column(1).to_pylist()]
            hits = [[vars(h) for h in listed] for _, listed in found]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(hits, pa.list_(hit_type))],
                ["_id", "n_words", "hits"],
            )

        return step

    kind = rows.schema["_id"].dataType.simpleString()
    hits = "array<struct<label:string,start:bigint,end:bigint,edits:int,exact:boolean>>"
    return in_batches(rows, f"_id {kind}, n_words bigint, hits {hits}", work).withColumnRenamed("_id", id_column)
