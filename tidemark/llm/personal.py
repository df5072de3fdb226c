"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field for other spellings.

The field labels whole segments, not characters or tokens: a candidate segment (a run of at most ``MOST_TOKENS``
tokens) has features of the whole span - its shape, its groups of digits, its separators, whether its digits pass
Luhn's test, what stands around it - and one dynamic program over all ways to cut a stretch of text into segments
finds boundaries and types together. Tokens outside segments score nothing, and only segments with digits,
an ``@``, or a spelt-out one can be personal data; so stretches without any of these need no program, and the
result is that of one over the whole text.

Training maximises the likelihood of made sentences with known spans (forward-backward, Adagrad); formats are
listed below. No table has labels of this kind, and nothing of the texts that are scanned is looked at.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, whole_text

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match takes whole runs of digits, so one can start at the beginning of a run only.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Most tokens of a segment, and characters after which a stretch is cut for it.
MOST_TOKENS = 24
STRETCH_CHARS = 4096
#: Segments have so many digits, in so many groups at most; without an ``@``, four groups or so many digits
#: at least.
LEAST_DIGITS, MOST_DIGITS, MOST_GROUPS = 7, 21, 8
#: Most of ``@`` and its spellings, and of spelt-out dots, in a segment.
MOST_MARKS = 4
#: Stretches whose result a worker remembers, and their longest text.
REMEMBERED, REMEMBERED_CHARS = 20_000, 200

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
#: What makes a stretch worth a program. Every alternative is found in one pass over the text.
HOT = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]")
MARK = re.compile(r"[\[(](?:at|dot)[\])]")


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and int(digits) <= 255


def base_emails(text: str) -> Iterator[Span]:
    """Every match has one ``@``, so it is looked for around each; the run before it is walked once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield Span(0, start, match.end())
        done = match.end() if match else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each pattern, without those that fail their test."""
    spans = list(base_emails(text)) if "@" in text else []
    spans += [Span(1, *m.span()) for m in ADDRESS.finditer(text) if all(map(octet, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(Span(2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                spans.append(Span(3, *m.span()))
    return spans


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Disjoint pieces of the text in which all possible segments lie: blank-separated words with a digit or
    ``@`` that follow each other, and the words beside a spelt-out ``@`` or dot."""
    start = end = -1
    reach = False
    for hot in HOT.finditer(text):
        marked = len(hot.group()) > 1
        if hot.start() < end:
            if marked and not reach:
                end, reach = _next_word(text, end), True
            continue
        # Nothing before the last stretch is looked at again, so all searches together are linear.
        left, right = _word_start(text, hot.start(), max(0, end)), _word_end(text, hot.start())
        if marked:
            left, right = _word_start(text, max(0, left - 1), max(0, end)), _next_word(text, right)
        if start >= 0 and left <= end + 1:
            end, reach = right, marked
            continue
        if start >= 0:
            yield start, end
        start, end, reach = left, right, marked
    if start >= 0:
        yield start, end


_BLANK = re.compile(r"[ \n\t]")


def _word_start(text: str, at: int, since: int) -> int:
    return max(since - 1, *(text.rfind(c, since, at) for c in " \n\t")) + 1


def _word_end(text: str, at: int) -> int:
    found = _BLANK.search(text, at)
    return found.start() if found else len(text)


def _next_word(text: str, right: int) -> int:
    return _word_end(text, right + 1) if right + 1 < len(text) else right


def _class(char: str) -> str:
    if not char:
        return "edge"
    if char.isdigit():
        return "digit"
    if char.isalpha():
        return "letter"
    return "blank" if char.isspace() else char


def segment_features(tokens: list[str], kinds: str, i: int, j: int, before: str, after: str, word: str) -> list[str] | None:
    """Features of tokens ``i`` to ``j``; None if the segment can't be personal data. ``kinds`` has one letter
    per token: d(igits), a (letters), s(pace), or p(unctuation)."""
    first, last = tokens[i], tokens[j - 1]
    if kinds[i] == "s" or kinds[j - 1] not in "da" or kinds[i] == "p" and first not in "+([":
        return None
    part, part_kinds = tokens[i:j], kinds[i:j]
    groups = [t for t, k in zip(part, part_kinds) if k == "d"]
    size = sum(map(len, groups))
    text = "".join(part)
    at = "@" if "@" in text else "mark" if MARK.search(text) else ""
    if not at and (size < LEAST_DIGITS and len(groups) != 4 or "a" in part_kinds) or at and kinds[i] == "p":
        return None
    if text.count("@") > 1 or any(k == "s" and t not in (" ", "  ") for t, k in zip(part, part_kinds)):
        return None
    separators = "".join(sorted(set(t for t, k in zip(part, part_kinds) if k in "sp")))
    found = [f"before={before}", f"after={after}", f"separators={separators}", f"first={first if kinds[i] == 'p' else kinds[i]}"]
    if at:
        tail = "a" if kinds[j - 1] == "a" and 2 <= len(last) <= 6 else "other"
        found += [f"at={at}", f"at={at} ends={tail}", f"dots={min(3, text.count('.'))}", f"blanks={min(6, part_kinds.count('s'))}"]
        found.append(f"marks={min(3, len(MARK.findall(text)))} {text.count('@')}")
        domain = re.split(r"@|[\[(]at[\])]", text)[-1].strip()
        whole = re.fullmatch(r"[\w-]+(?:\s?(?:\.|[\[(]dot[\])])\s?[\w-]+)+", domain)
        found += [f"domain={bool(whole)}", f"domain={bool(whole)} at={at} ends={tail} after={after}"]
        return found
    shape = "".join(str(len(t)) if k == "d" else t if k != "s" else "_" for t, k in zip(part, part_kinds))
    found += [f"shape={shape}", f"digits={min(size, 21)}", f"groups={min(len(groups), 7)}", f"digits={min(size, 21)} separators={separators}"]
    found.append(f"word={word}")
    found.append(f"shape={shape} before={before} after={after}")
    if 13 <= size <= 19:
        found.append(f"luhn={luhn(''.join(groups))} digits={size}")
    if len(groups) == 4:
        found.append(f"octets={all(map(octet, groups))} separators={separators}")
    return found


class Lattice(NamedTuple):
    """Candidate segments of one stretch: (start, end, features) by token, and the tokens' places."""

    places: list[int]
    segments: list[tuple[int, int, list[str]]]


def lattice(text: str, before: str = "", after: str = "", word: str = "") -> Lattice:
    """All segments of the stretch that can be personal data. ``before`` and ``after`` are the characters
    around it, ``word`` the word before it."""
    places, tokens, kinds = [0], [], []
    for m in TOKEN.finditer(text):
        token = m.group()
        tokens.append(token)
        places.append(m.end())
        kinds.append("d" if "0" <= token[0] <= "9" else "a" if token[0].isalpha() else "s" if token[0].isspace() else "p")
    line = "".join(kinds)
    at = [t == "@" or t in ("at", "dot") and tokens[max(0, n - 1)] in "[(" for n, t in enumerate(tokens)]
    segments = []
    said = word
    for i in range(len(tokens)):
        if kinds[i] == "a":
            said = tokens[i].lower()
        if kinds[i] == "s" or kinds[i] == "p" and tokens[i] not in "+([":
            continue
        left = _class(tokens[i - 1][-1] if i else before)
        digits = groups = marked = 0
        lettered = False
        for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
            if kinds[j - 1] == "d":
                digits, groups = digits + len(tokens[j - 1]), groups + 1
            marked, lettered = marked + at[j - 1], lettered or kinds[j - 1] == "a"
            if digits > MOST_DIGITS or groups > MOST_GROUPS or marked > MOST_MARKS:
                break
            if kinds[j - 1] not in "da" or not marked and (lettered or digits < LEAST_DIGITS and groups != 4):
                continue
            right = _class(tokens[j][0] if j < len(tokens) else after)
            if right == kinds[j - 1]:
                continue
            found = segment_features(tokens, line, i, j, left, right, said if kinds[i] != "a" else word)
            if found:
                segments.append((i, j, found))
    return Lattice(places, segments)


class Model:
    """Weights of (feature, kind). Order-one transitions are between kinds of neighbouring segments."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.features, self.weights, self.transitions = features, weights, transitions

    def scores(self, grid: Lattice) -> np.ndarray:
        """One row per segment, one column per kind."""
        out = np.zeros((len(grid.segments), len(KINDS)))
        for row, (_, _, found) in enumerate(grid.segments):
            known = [self.features[f] for f in found if f in self.features]
            out[row] = self.weights[known].sum(axis=0) if known else -10.0
        return out

    def best(self, grid: Lattice) -> list[tuple[int, int, int]]:
        """The best cut: (kind, first token, end token) of each segment that is personal data."""
        if not grid.segments:
            return []
        outside = len(KINDS)
        tokens = len(grid.places) - 1
        value = np.full((tokens + 1, outside + 1), -np.inf)
        value[0, outside] = 0.0
        back: list[list] = [[None] * (outside + 1) for _ in range(tokens + 1)]
        scores = self.scores(grid)
        # Segments are listed by start, and a start's values are final once all earlier starts are done.
        by_start: dict[int, list[int]] = {}
        for row, (i, _, _) in enumerate(grid.segments):
            by_start.setdefault(i, []).append(row)
        for i in range(tokens):
            previous = int(value[i].argmax())
            if value[i, previous] > value[i + 1, outside]:
                value[i + 1, outside], back[i + 1][outside] = value[i, previous], (i, previous)
            if i not in by_start:
                continue
            into = value[i][:, None] + self.transitions
            parents = into.argmax(axis=0)
            into = into.max(axis=0)
            for row in by_start[i]:
                j = grid.segments[row][1]
                reached = into + scores[row]
                for kind in (reached > value[j, :outside]).nonzero()[0]:
                    value[j, kind], back[j][kind] = reached[kind], (i, int(parents[kind]))
        found, at, kind = [], tokens, int(np.argmax(value[tokens]))
        while at:
            i, previous = back[at][kind]
            if kind != outside:
                found.append((kind, i, at))
            at, kind = i, previous
        return found[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def likelihood(grid: Lattice, scores: np.ndarray, transitions: np.ndarray, gold: list[tuple[int, int, int]]):
    """(log-likelihood of the ``gold`` segments, its gradient by segment scores, and by transitions)."""
    outside, tokens = len(KINDS), len(grid.places) - 1
    ahead = np.full((tokens + 1, outside + 1), -np.inf)
    ahead[0, outside] = 0.0
    by_start: dict[int, list[int]] = {}
    for row, (i, _, _) in enumerate(grid.segments):
        by_start.setdefault(i, []).append(row)
    for i in range(tokens):
        ahead[i + 1, outside] = np.logaddexp(ahead[i + 1, outside], _log_sum(ahead[i], 0))
        for row in by_start.get(i, ()):
            j = grid.segments[row][1]
            ahead[j, :outside] = np.logaddexp(ahead[j, :outside], _log_sum(ahead[i][:, None] + transitions, 0) + scores[row])
    behind = np.full((tokens + 1, outside + 1), -np.inf)
    behind[tokens] = 0.0
    for i in range(tokens - 1, -1, -1):
        behind[i] = np.logaddexp(behind[i], behind[i + 1, outside])
        for row in by_start.get(i, ()):
            j = grid.segments[row][1]
            behind[i] = np.logaddexp(behind[i], _log_sum(transitions + (scores[row] + behind[j, :outside])[None, :], 1))
    whole = float(_log_sum(ahead[tokens], 0))
    by_score, by_transition = np.zeros_like(scores), np.zeros_like(transitions)
    for row, (i, j, _) in enumerate(grid.segments):
        share = np.exp(ahead[i][:, None] + transitions + (scores[row] + behind[j, :outside])[None, :] - whole)
        by_score[row] -= share.sum(axis=0)
        by_transition -= share
    rows = {(i, j): row for row, (i, j, _) in enumerate(grid.segments)}
    value, previous, done = -whole, outside, 0
    for kind, i, j in gold:
        if i > done:
            previous = outside
        value += scores[rows[i, j], kind] + transitions[previous, kind]
        by_score[rows[i, j], kind] += 1
        by_transition[previous, kind] += 1
        previous, done = kind, j
    return value, by_score, by_transition


# Formats of made sentences: 9 stands for a digit, x for a letter; the spans are what is between braces.
FORMATS = {
    "email": [
        "{xxxx.99@xxxx9.xxxxxxx.xxx}", "{xxxxx@xxxxxx.xxx}", "{xxx_xxx@xxx-xxxx.xx}", "{xxxxx+xxx@xxxx.xx.xx}",
        "{xxxxx [at] xxxxxxx [dot] xxx}", "{xxxx.xxx [at] xxxxxx.xxx}", "{xxxx(at)xxxxxx(dot)xx}",
        "{xxx (at) xxxxxxx (dot) xxx}", "{xxxx99[at]xxxxx.xxx}", "{xxxxx@xxxxxx [dot] xxx}",
    ],
    "phone": [
        "{+1 (999) 999-9999}", "{+99 999 999 9999}", "{+99-99-9999-9999}", "{+999999999999}", "{(999) 999-9999}",
        "{999-999-9999}", "{999.999.9999}", "{(999)999-9999}", "{1-999-999-9999}", "{999 999 9999}", "{+99 9999 999999}",
    ],
    "card": ["{CCCC CCCC CCCC CCCC}", "{CCCC-CCCC-CCCC-CCCC}", "{CCCCCCCCCCCCCCCC}", "{CCCC.CCCC.CCCC.CCCC}", "{CCCC CCCCCC CCCCC}", "{CCCCCCCCCCCCCCC}"],
    "ip": ["{O.O.O.O}", "{O.O.O.O}:9999", "http://{O.O.O.O}/xxx", "{O[.]O[.]O[.]O}", "{O[dot]O[dot]O[dot]O}", "[{O.O.O.O}]"],
    "none": [
        "2099-99-99", "99/99/2099", "99:99:99", "9.9.9", "99.9", "9,999,999", "9999999", "99999999", "9999999999",
        "999999999999", "9999999999999999", "NNNN NNNN NNNN NNNN", "N.N.N.N", "9.9.9.9.9", "999", "99", "@xxxxx", "xx99xx99999999",
        "99-9999999", "9999 9999", "999 999", "$9,999.99", "xxxxxx99@", "2099-99-99 99:99:99", "999-99999999-9999", "99999.99999.99999",
        "99 999 9999 99", "(9999) 9999", "9999999-99", "999-999-9999-9999", "999999-999999", "x (at) 9", "#9999999", "99%",
    ],
}


def make_sentence(draw: random.Random) -> tuple[str, list[Span]]:
    """A made sentence and its spans; a third of the pieces are of no kind."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word() -> str:
        return "".join(draw.choices(letters, k=draw.randint(2, 9)))

    def filled(shape: str) -> str:
        size = shape.count("C") + shape.count("N")
        digits = [draw.randint(0, 9) for _ in range(size)]
        if "C" in shape or "NNNN" in shape:
            digits[0] = draw.randint(3, 6)
            right = next(d for d in range(10) if luhn("".join(map(str, [*digits[:-1], d]))))
            digits[-1] = right if "C" in shape else (right + draw.randint(1, 9)) % 10
        big = draw.randrange(max(1, size))
        out, used = [], 0
        for char in shape:
            if char == "9":
                out.append(str(draw.randint(0, 9)))
            elif char == "x":
                out.append(draw.choice(letters) * 1)
            elif char == "O":
                out.append(str(draw.randint(0, 255)))
            elif char in "CN":
                # N.N.N.N has a part that is no octet.
                out.append(str(draw.randint(256, 999) if used == big else draw.randint(0, 255)) if shape == "N.N.N.N" else str(digits[used]))
                used += 1
            else:
                out.append(char)
        return "".join(out)

    text, spans = "", []
    for _ in range(draw.randint(1, 3)):
        text += "".join(word() + " " for _ in range(draw.randint(0, 3)))
        kind = draw.choice([*KINDS, "none", "none"])
        if kind in ("phone", "card") and draw.random() < 0.3:
            text += draw.choice({"phone": ["call ", "phone: ", "tel "], "card": ["card ", "card: "]}[kind])
        piece = filled(draw.choice(FORMATS[kind]))
        left, brace, rest = piece.partition("{")
        inside, _, right = rest.partition("}")
        if brace:
            start = len(text) + len(left)
            spans.append(Span(KINDS.index(kind), start, start + len(inside)))
        text += left + (inside if brace else "") + right + draw.choice(["", "", ".", ",", ";", ")"]) + draw.choice([" ", "\n"])
        text += word() + " "
    return text, spans


def _grids(text: str) -> Iterator[tuple[int, Lattice]]:
    for start, end in stretches(text):
        yield from _pieces(text, start, end)


def _pieces(text: str, start: int, end: int) -> Iterator[tuple[int, Lattice]]:
    said = re.findall(r"[^\W\d_]+", text[max(0, start - 32) : start])
    word = said[-1].lower() if said else ""
    yield start, lattice(text[start:end], text[start - 1 : start], text[end : end + 1], word)


@functools.lru_cache(maxsize=2)
def fit(sentences: int = 800, epochs: int = 5, rate: float = 0.3, decay: float = 1e-4, seed: int = 13) -> Model:
    """Trains on made sentences; takes some seconds on the driver, at any size of the input."""
    draw = random.Random(seed)
    examples = []
    features: dict[str, int] = {}
    for _ in range(sentences):
        text, spans = make_sentence(draw)
        for offset, grid in _grids(text):
            at = {offset + place: k for k, place in enumerate(grid.places)}
            listed = {(i, j) for i, j, _ in grid.segments}
            gold = [(s.kind, at.get(s.start), at.get(s.end)) for s in spans if offset <= s.start < offset + grid.places[-1]]
            gold = [(kind, i, j) for kind, i, j in gold if (i, j) in listed]
            for _, _, found in grid.segments:
                for f in found:
                    features.setdefault(f, len(features))
            if grid.segments:
                examples.append((grid, gold))
    weights = np.full((len(features), len(KINDS)), -0.3)
    transitions = np.zeros((len(KINDS) + 1, len(KINDS)))
    known = [[np.array([features[f] for f in found]) for _, _, found in grid.segments] for grid, _ in examples]
    seen, seen_transitions = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
    order = list(range(len(examples)))
    for _ in range(epochs):
        draw.shuffle(order)
        for k in order:
            grid, gold = examples[k]
            scores = np.stack([weights[f].sum(axis=0) for f in known[k]])
            _, by_score, by_transition = likelihood(grid, scores, transitions, gold)
            for f, slope in zip(known[k], by_score):
                if np.abs(slope).max() < 1e-4:
                    continue
                slope = slope[None, :] - decay * weights[f]
                seen[f] += slope * slope
                weights[f] += rate * slope / np.sqrt(seen[f])
            seen_transitions += by_transition**2
            transitions += rate * by_transition / np.sqrt(seen_transitions)
    return Model(features, weights, transitions)


class Finder:
    """Spans of one text after the other; short stretches that come back are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[tuple, list[tuple[int, int, int]]] = {}

    def _cut(self, text: str, before: str, after: str, word: str) -> list[tuple[int, int, int]]:
        key = (text, before, after, word)
        if key in self.known:
            return self.known[key]
        found = []
        for start, end in _shares(text):
            # A share begins where no segment can be open, so programs of shares add up to one program.
            grid = lattice(text[start:end], text[start - 1 : start] or before, text[end : end + 1] or after, word)
            found += [(k, start + grid.places[i], start + grid.places[j]) for k, i, j in self.model.best(grid)]
        if len(text) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = found
        return found

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, spans of the model that overlap none of them)."""
        base = base_spans(text)
        taken = sorted((s.start, s.end) for s in base)
        added: list[Span] = []
        cover = 0
        ends: list[tuple[int, int]] = []
        for start, end in taken:  # joined intervals, for one pass beside the model's ordered spans
            if ends and start < ends[-1][1]:
                ends[-1] = (ends[-1][0], max(end, ends[-1][1]))
            else:
                ends.append((start, end))
        for start, end in stretches(text):
            said = re.findall(r"[^\W\d_]+", text[max(0, start - 32) : start])
            word = said[-1].lower() if said else ""
            for kind, left, right in self._cut(text[start:end], text[start - 1 : start], text[end : end + 1], word):
                left, right = start + left, start + right
                while cover < len(ends) and ends[cover][1] <= left:
                    cover += 1
                if cover == len(ends) or ends[cover][0] >= right:
                    added.append(Span(kind, left, right))
        return base, added


def _shares(text: str) -> Iterator[tuple[int, int]]:
    """Cuts a stretch after about ``STRETCH_CHARS`` characters where segments can't pass: at line ends, tabs,
    or three blanks; without any such place, at a blank or, in unbroken text, anywhere."""
    start = 0
    while len(text) - start > 2 * STRETCH_CHARS:
        near = re.compile(r"[\n\t]|   ").search(text, start + STRETCH_CHARS, start + 2 * STRETCH_CHARS)
        near = near or re.compile(r"\s").search(text, start + STRETCH_CHARS, start + 2 * STRETCH_CHARS)
        end = near.end() if near else start + 2 * STRETCH_CHARS
        yield start, end
        start = end
    yield start, len(text)


def find_personal(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", model: Model | None = None) -> DataFrame:
    """One row per document: id, ``base`` and ``added``, each an array of (``kind``: place in :data:`KINDS`,
    ``start``, ``end``) in code points, by kind, then start.

    ``base`` are the fixed patterns, ``added`` what the field finds elsewhere; added spans overlap no base
    span nor each other. A NULL or empty text has none. Repeated rows are scanned each, and a NULL id stays.
    Other columns are ignored; an empty table gives no rows. Texts are scanned whole: a stretch of more than
    8,192 characters without line ends is cut for the field at blanks, and a span across such a cut is found only
    by the patterns.
    """
    trained = model or fit()
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), whole_text(text_column).alias("text"))
    spans = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def work():
        finder = Finder(trained)

        def listed(found: list[Span]) -> list[dict]:
            return [s._asdict() for s in sorted(found)]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [finder.spans(text) for text in batch.column(1).to_pylist()]
            base, added = ([listed(pair[k]) for pair in made] for k in (0, 1))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, spans), pa.array(added, spans)], ["id", "base", "added"]
            )

        return step

    id_type = rows.schema["id"].dataType.simpleString()
    span = "array<struct<kind:int,start:bigint,end:bigint>>"
    found = in_batches(rows, f"id {id_type}, base {span}, added {span}", work, step_rows=64)
    return found.withColumnRenamed("id", id_column)
