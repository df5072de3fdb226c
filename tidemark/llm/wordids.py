"""Ids of whole texts by the tokenizers library, which sees each distinct word once per worker process.

Both kinds of vocabulary cut texts at white space before they merge, so the ids of a text are those of
its words in order. Words seen before are looked up; the rest go to the library in one batch.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Iterator
from itertools import compress, count, repeat
from operator import is_

from tidemark.llm.bpe import CHUNKS, SPACE

#: Longer words are encoded but not kept.
LONGEST_KEPT = 48
#: Texts are taken apart in slices of about so many characters, cut at a space.
SLICE = 1 << 20
#: Where white space meets white space, or an end of the text, words alone don't tell the ids. Such words
#: are never kept, so only words that are not known yet need a look.
_UNEVEN = re.compile(f"\\A\\Z|\\A(?!\n)[{SPACE}]|[{SPACE}][{SPACE}]|[{SPACE}]\\Z")
#: Words of these letters, with the space before them, are one match of the byte-level pattern.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class WordIds:
    """``spaces_kept``: byte-level vocabularies keep white space, others drop it.

    A key of the cache is a word as bytes. With spaces kept it stands for a space and the word, or, if it
    begins with a line feed, for just what it is.
    """

    MOST_KEPT = 1_000_000
    #: Without spaces; a word takes some 180 bytes, and an executor keeps several workers from stage to stage.
    MOST_KEPT_PLAIN = 400_000

    def __init__(self, path: str, spaces_kept: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.spaces_kept = spaces_kept
        # Making a text byte-level takes the library longer than the merges: words that are one match of its
        # pattern go to the model itself.
        byte_level = isinstance(self.model.pre_tokenizer, ByteLevel) and self.model.pre_tokenizer.use_regex
        added = self.model.get_added_tokens_decoder().values()
        self.direct = (
            spaces_kept and byte_level and self.model.normalizer is None
            and not any(_LETTERS(token.content.strip()) for token in added)
        )
        self.merges = self.model.model
        if not spaces_kept:
            self.MOST_KEPT = self.MOST_KEPT_PLAIN
        self.known: dict[bytes, bytes] = {}
        self.missed = 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array("I", x.ids).tobytes() for x in found]

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words as they stand in a text, with the space before them where spaces are kept."""
        found, rest = {}, words
        if self.direct:
            rest = []
            space, tokenize = _BYTE_LETTERS[ord(" ")], self.merges.tokenize
            line = self._encode(["\n"])[0]
            for word in words:
                # Between a line feed and a letter there is a cut.
                new_line = word[:1] == b"\n"
                letters = word[1:] if new_line else word
                if _LETTERS(letters.decode()):
                    shown = letters.decode("latin-1").translate(_BYTE_LETTERS)
                    tokens = tokenize(shown if new_line else space + shown)
                    ids = array.array("I", [token.id for token in tokens]).tobytes()
                    found[word] = line + ids if new_line else ids
                else:
                    rest.append(word)
        found.update(zip(rest, self._encode([self._meaning(word) for word in rest])))
        return found

    def _meaning(self, word: bytes) -> str:
        return word.decode() if not self.spaces_kept or word[:1] == b"\n" else " " + word.decode()

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of new words; a word that ends with one full stop or comma is its stem and the mark."""
        known = self.known
        stems, new = {}, []
        for word in words:
            if len(word) > 2 and word[-1:] in b".," and word[-2:-1].isalpha():
                stems[word] = word[:-1]
            else:
                new.append(word)
        more = {stem for stem in stems.values() if stem not in known and stem not in words}
        new += more
        learnt = self._encode_words(new)
        if stems:
            marks = dict(zip(b".,", self._encode([".", ","])))
            for word, stem in stems.items():
                ids = learnt.get(stem)
                learnt[word] = (known[stem] if ids is None else ids) + marks[word[-1]]
        # A full cache stays as it is, for common words come early, until it no longer serves.
        self.missed += len(learnt)
        if self.missed > 3 * self.MOST_KEPT:
            known.clear()
            self.missed = 0
        if len(known) < self.MOST_KEPT:
            known.update((word, ids) for word, ids in learnt.items() if len(word) <= LONGEST_KEPT)
        return learnt

    def _uneven(self, text: str) -> bytes:
        """Any white space, by the cuts of the pattern; ids of the chunks are not kept."""
        return b"".join(self._encode(CHUNKS.findall(text)))

    def _slices(self, text: str) -> Iterator[tuple[bytes | None, list[bytes]]]:
        """(the word before which there is no space, words) of each slice."""
        start = 0
        while start < len(text):
            end = text.find(" ", start + SLICE) if len(text) - start > SLICE else -1
            piece = text[start : len(text) if end < 0 else end]
            if not self.spaces_kept:
                # ASCII letters are lower-cased by these vocabularies anyway.
                yield None, piece.encode().lower().split()
            else:
                words = piece.replace("\n", " \n").encode().split(b" ")
                if start:
                    yield None, words
                else:
                    yield words[0], words[1:]
            start = len(text) if end < 0 else end + 1

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        get = self.known.get
        done: list[list] = []
        holes: list[tuple[list, list[int], list[bytes]]] = []
        missing: set[bytes] = set()
        firsts: list[tuple[list, str]] = []
        for text in texts:
            out: list = []
            own: list[tuple[list, list[int], list[bytes]]] = []
            even = True
            for first, words in self._slices(text):
                if first is not None:
                    word = first.decode()
                    even = not _UNEVEN.search(word) and word[0] != "\n"
                    firsts.append((out, word))
                    out.append(b"")
                parts = list(map(get, words))
                at = list(compress(count(), map(is_, parts, repeat(None))))
                if at:
                    lost = [words[k] for k in at]
                    if self.spaces_kept and even:
                        even = not any(_UNEVEN.search(word.decode()) for word in lost)
                    own.append((parts, at, lost))
                if not even:
                    break
                out.append(parts)
            if even:
                for hole in own:
                    missing.update(hole[2])
                holes += own
            else:
                out = [self._uneven(text)]
            done.append(out)
        if missing:
            learnt = self._learn(missing)
            for parts, at, lost in holes:
                for k, word in zip(at, lost):
                    parts[k] = learnt[word]
        if firsts:
            for (out, _), ids in zip(firsts, self._encode([word for _, word in firsts])):
                out[0] = ids
        return [b"".join([x if isinstance(x, bytes) else b"".join(x) for x in out]) for out in done]


_LOADED: dict[tuple[str, bool], WordIds] = {}


def word_ids(path: str, spaces_kept: bool) -> WordIds:
    """One per worker process."""
    key = (path, spaces_kept)
    if key not in _LOADED:
        _LOADED[key] = WordIds(path, spaces_kept)
    return _LOADED[key]
