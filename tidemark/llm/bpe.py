"""Byte-level BPE as a finite-state transducer.

A token sequence is the BPE encoding of its bytes exactly when every token is the encoding of its own
bytes and every two neighbours are the encoding of theirs. That makes encoding a non-deterministic
transducer whose configurations are (last token, bytes read of the next one). The transducer is
determinised lazily: a state is the set of configurations still possible, with the tokens they do not
agree on yet; a token is emitted as soon as all configurations agree on it, which takes at most the
bytes of the longest token. States and arcs are made when a text first needs them.

Decoding is incremental: token bytes go through a UTF-8 state machine that holds back an unfinished
character, so text can be given out in pieces of any size.
"""

from __future__ import annotations

import base64
import codecs
import re
import sys
from array import array
from collections.abc import Iterator, Sequence

import regex

#: Unicode White_Space, as the pre-tokenizing pattern's ``\s`` means it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs between which the pre-tokenizing pattern always cuts, so each can be encoded by itself.
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes the bytes of one piece by the merges implied by the ranks.

    A configuration is (tokens not emitted yet, place in the trie of tokens); a state is the last emitted token,
    where it still matters, with the configurations still possible, the longest part first. States are packed
    integers. What is remembered is bounded in bytes: beyond that the transducer is made anew and goes on from
    the configurations it stands at, in the middle of a piece too, which costs time but changes no output.
    """

    #: Bounds on states with their arcs, and on the pairs of tokens that have been tried.
    MOST_BYTES = 320 << 20
    MOST_PAIR_BYTES = 48 << 20
    #: What an entry takes besides its packed integers: objects, table slots.
    STATE_BYTES, ARC_BYTES, PAIR_BYTES = 180, 170, 130

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.children: dict[int, int] = {}
        self.token_at = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self.children.get(node << 8 | byte)
                if below is None:
                    below = self.children[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                node = below
            self.token_at[node] = rank
        self._own: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self._alone = {rank: (rank,) for rank in self.tokens}
        self.numbers: dict[bytes, int] = {}
        self.states: list[bytes] = []
        #: state * 256 + byte -> next state, or its complement if tokens are emitted
        self.arcs: dict[int, int] = {}
        self.emitted: dict[int, tuple[int, ...]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self.restarts = 0
        self._reset()

    def _reset(self) -> None:
        for table in (self.numbers, self.states, self.arcs, self.emitted, self.ends):
            table.clear()
        self.used = 0
        self._number(-1, [([], 0)])

    def _number(self, last: int, configurations: list[tuple[list[int], int]]) -> int:
        # Only a part begun where the last emitted token ends has none pending, and the longest part comes first.
        packed = [-1 if configurations[0][0] else last]
        for pending, node in configurations:
            packed += (node, len(pending))
            packed += pending
        key = array("i", packed).tobytes()
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.used += len(key) + self.STATE_BYTES
        return number

    def _configurations(self, state: int) -> tuple[int, list[tuple[list[int], int]]]:
        packed = array("i")
        packed.frombytes(self.states[state])
        numbers = packed.tolist()
        found, at = [], 1
        while at < len(numbers):
            end = at + 2 + numbers[at + 1]
            found.append((numbers[at + 2 : end], numbers[at]))
            at = end
        return numbers[0], found

    def merged(self, text: bytes) -> list[bytes]:
        """Merging by rank as the definition has it; used on single tokens and pairs of tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        rank, none = self.ranks.get, len(self.ranks) + 1
        costs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs and (best := min(costs)) < none:
            at = costs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            costs[at : at + 1] = []
            if at:
                costs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(costs):
                costs[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def _is_own_encoding(self, token: int) -> bool:
        known = self._own.get(token)
        if known is None:
            text = self.tokens[token]
            known = self._own[token] = self.merged(text) == [text]
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) * self.PAIR_BYTES > self.MOST_PAIR_BYTES:
                self._pairs.clear()
            a, b = self.tokens[left], self.tokens[right]
            known = self._pairs[key] = self.merged(a + b) == [a, b]
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, configurations = self._configurations(state)
        reached = []
        between = None
        children, token_at = self.children.get, self.token_at
        for pending, node in configurations:
            below = children(node << 8 | byte)
            if below is None:
                continue
            reached.append((pending, below))
            token = token_at[below]
            if between is None and token >= 0 and self._is_own_encoding(token):
                before = pending[-1] if pending else last
                if before < 0 or self._may_follow(before, token):
                    # At most one: the encoding of the bytes so far.
                    between = ([*pending, token], 0)
        if between:
            reached.append(between)
        if not reached:
            raise ValueError("the vocabulary lacks some single bytes")
        first = reached[0][0]
        agreed = len(first)
        for pending, _ in reached[1:]:
            # Pending tokens never reach back beyond those of a longer part, so this is cut short at once.
            agreed = min(agreed, len(pending))
            while agreed and pending[:agreed] != first[:agreed]:
                agreed -= 1
            if not agreed:
                break
        if agreed:
            reached = [(pending[agreed:], node) for pending, node in reached]
            last = first[agreed - 1]
        tokens = self._alone[first[0]] if agreed == 1 else tuple(first[:agreed])
        if self.used > self.MOST_BYTES:
            self._reset()
            self.restarts += 1
            return self._number(last, reached), tokens
        following = self._number(last, reached)
        key = state << 8 | byte
        if tokens:
            self.emitted[key] = tokens
            self.used += self.ARC_BYTES // 2
        self.arcs[key] = ~following if tokens else following
        self.used += self.ARC_BYTES
        return following, tokens

    def encode(self, piece: bytes) -> list[int]:
        arcs, emitted, state, out = self.arcs, self.emitted, 0, []
        for byte in piece:
            key = state << 8 | byte
            following = arcs.get(key)
            if following is None:
                state, tokens = self._step(state, byte)
                out += tokens
            elif following < 0:
                out += emitted[key]
                state = ~following
            else:
                state = following
        end = self.ends.get(state)
        if end is None:
            # The configuration that stands between tokens; the encoding is unique, so there is one.
            _, configurations = self._configurations(state)
            end = self.ends[state] = tuple(next(pending for pending, node in configurations if not node))
            self.used += self.ARC_BYTES
        out += end
        return out


class Encoder:
    """Whole texts to ids: chunks between which the pattern cuts are looked up, new ones transduced.

    Chunks seen once and chunks seen again are kept apart, each up to a number of bytes; the former, of which
    there is no end, make room first.
    """

    MOST_NEW_BYTES = 40 << 20
    MOST_KNOWN_BYTES = 64 << 20
    CHUNK_BYTES = 190

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}
        self.known_bytes = self.new_bytes = 0

    def _chunk(self, chunk: str) -> bytes:
        size = 5 * len(chunk) + self.CHUNK_BYTES
        packed = self.new.pop(chunk, None)
        if packed is not None:
            self.new_bytes -= size
            if self.known_bytes > self.MOST_KNOWN_BYTES:
                self.known.clear()
                self.known_bytes = 0
            self.known[chunk] = packed
            self.known_bytes += size
            return packed
        ids = array("I")
        for piece in self.pieces.findall(chunk):
            raw = piece.encode()
            whole = self.transducer.ranks.get(raw)
            if whole is None:
                ids.extend(self.transducer.encode(raw))
            else:
                ids.append(whole)
        if sys.byteorder == "big":
            ids.byteswap()
        packed = ids.tobytes()
        if len(chunk) <= 64:
            if self.new_bytes > self.MOST_NEW_BYTES:
                self.new.clear()
                self.new_bytes = 0
            self.new[chunk] = packed
            self.new_bytes += size
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, chunk = self.known.get, self._chunk
        return b"".join([known(m) or chunk(m) for m in CHUNKS.findall(text)])


def decode_bytes(ids: Sequence[int], tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids))


def stream_decode(
    ids: Sequence[int], tokens: dict[int, bytes], errors: str = "replace", step: int = 256
) -> Iterator[str]:
    """Text in pieces of ``step`` ids; bytes of an unfinished character wait in the machine."""
    machine = codecs.getincrementaldecoder("utf-8")(errors)
    for start in range(0, len(ids), step):
        if text := machine.decode(decode_bytes(ids[start : start + step], tokens)):
            yield text
    if text := machine.decode(b"", final=True):
        yield text
