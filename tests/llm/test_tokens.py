import array
import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, codec, packing, tokenfiles
from tidemark.llm.wordids import WordIds
from tidemark.session import shared_dir

RANKS = P.path("byte_bpe_50k.tiktoken")
ALPHABET = st.text(st.sampled_from(" \n\t\x1c\x85\xa0 .,'!aebtslrABCI019éèß中🙂́ſİΣς"), max_size=30)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def by_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def unpacked(ids):
    return np.frombuffer(ids, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(text=ALPHABET)
def test_transducer_equals_merging(encoder, by_library, text):
    ids = unpacked(encoder.encode(text))
    assert ids == by_library.encode_ordinary(text)
    assert "".join(bpe.stream_decode(ids, encoder.transducer.tokens, step=1)) == text


def test_transducer_on_random_tokens_and_after_reset(encoder, by_library):
    draw = random.Random(4)
    words = list(encoder.transducer.ranks)
    encoder.transducer.MOST_BYTES, encoder.transducer.MOST_PAIR_BYTES = 20_000, 500
    before = encoder.transducer.restarts
    for _ in range(300):
        text = b"".join(draw.choices(words, k=5)).decode("utf-8", "replace")
        assert unpacked(encoder.encode(text)) == by_library.encode_ordinary(text)
    assert encoder.transducer.restarts > before
    del encoder.transducer.MOST_BYTES, encoder.transducer.MOST_PAIR_BYTES


def test_tables_stay_bounded_within_one_long_word(encoder):
    """10 MB of letters without a break: the transducer starts anew amid the word."""
    draw = np.random.default_rng(7)
    word = bytes(draw.integers(97, 123, 400_000, dtype=np.uint8)) + 480 * bytes(draw.integers(97, 123, 20_000, dtype=np.uint8))
    transducer = encoder.transducer
    transducer.MOST_BYTES, most, restarts = 8 << 20, 0, transducer.restarts
    step = transducer._step

    def watched(state, byte):
        nonlocal most
        most = max(most, transducer.used)
        return step(state, byte)

    transducer._step = watched
    ids = transducer.encode(word)
    del transducer._step, transducer.MOST_BYTES
    assert most < (8 << 20) + 10_000 and transducer.restarts > restarts
    assert bpe.decode_bytes(ids, transducer.tokens) == word
    # The encoding is the one in which every token and every two neighbours encode themselves.
    assert all(transducer._is_own_encoding(t) for t in set(ids))
    assert all(transducer._may_follow(a, b) for a, b in set(zip(ids, ids[1:])))


def test_remembered_chunks_make_room(by_library):
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), P.PATTERN)
    encoder.MOST_NEW_BYTES = encoder.MOST_KNOWN_BYTES = 2_000
    draw = random.Random(1)
    for _ in range(300):
        text = " ".join("".join(draw.choices("abé1.", k=draw.randint(1, 3))) for _ in range(20))
        assert unpacked(encoder.encode(text)) == by_library.encode_ordinary(text)
        assert encoder.new_bytes < 3_000 and encoder.known_bytes < 3_000
    assert encoder.known_bytes == sum(5 * len(c) + encoder.CHUNK_BYTES for c in encoder.known)


def test_unfinished_characters_wait(encoder):
    tokens = {0: b"\xf0\x9f", 1: b"\x99\x82", 2: b"a"}
    assert list(bpe.stream_decode([0, 1, 2], tokens, step=1)) == ["🙂", "a"]
    assert "".join(bpe.stream_decode([0, 2], tokens)) == "�a"


@pytest.mark.parametrize(("name", "kept"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_cache_equals_whole_texts(name, kept):
    words = WordIds(P.path(name), kept)

    @settings(max_examples=300, deadline=None)
    @given(texts=st.lists(ALPHABET, max_size=4))
    def run(texts):
        wanted = [words.model.encode(t, add_special_tokens=False).ids for t in texts]
        assert [unpacked(x) for x in words.encode_all(texts)] == wanted

    run()
    words.MOST_KEPT = 3
    run()


def test_codec(spark, odd_docs, odd_rows, no_docs, by_library):
    ids = codec.encode(odd_docs, RANKS, P.PATTERN)
    got = sorted((str(r.doc_id), unpacked(r.ids), r.n_tokens) for r in ids.collect())
    wanted = [(str(i), by_library.encode_ordinary(t or "")) for i, t in odd_rows]
    assert got == sorted((i, x, len(x)) for i, x in wanted)
    back = codec.decode(ids, RANKS).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in odd_rows)
    assert all(bytes(r.raw).decode() == r.text for r in back)
    assert {r.ids_sha256 for r in back} == {hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for _, x in wanted}
    assert codec.decode(codec.encode(no_docs, RANKS, P.PATTERN), RANKS).count() == 0
    both = codec.round_trip(odd_docs, RANKS, P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in both) == sorted(
        (str(i), len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in wanted
    )
    assert sorted(r.decoded_sha256 for r in both) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in odd_rows)
    assert codec.round_trip(no_docs, RANKS, P.PATTERN).count() == 0


def test_token_files(spark, odd_docs, odd_rows, no_docs):
    vocabulary = P.path("byte_bpe_50k.json")
    path = shared_dir(spark, "test-ids")
    tokenfiles.write_ids(odd_docs, path, vocabulary, end_id=2)
    rows = tokenfiles.read_ids(spark, path).collect()
    model = Tokenizer.from_file(vocabulary)
    model.encode_special_tokens = True
    wanted = sorted((str(i), model.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in odd_rows)
    assert sorted((str(r.document), unpacked(r.ids)) for r in rows) == wanted
    rows.sort(key=lambda r: r.start)
    keys = [(r.document is not None, r.document or 0) for r in rows]
    assert keys == sorted(keys)
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    picked = tokenfiles.read_ids(spark, path, documents=[9]).collect()
    assert [(r.document, r.ids) for r in picked] == [(r.document, r.ids) for r in rows if r.document == 9]
    empty = shared_dir(spark, "test-ids")
    tokenfiles.write_ids(no_docs, empty, vocabulary, end_id=2)
    assert tokenfiles.read_ids(spark, empty).count() == 0


def test_segments_refuse_another_dictionary():
    blob = tokenfiles.pack_segment([], [], 2, b"one dictionary")
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfiles.Segment(blob, b"two")


def placed(counts, length):
    plan = packing.make_plan(np.array(counts), length)
    seen = {}
    for size, number in enumerate(counts):
        if number:
            sequence, offset = plan.place(np.full(number, size), np.arange(number))
            for s, o in zip(sequence.tolist(), offset.tolist()):
                seen.setdefault(s, []).append((o, size))
    assert sorted(seen) == list(range(plan.sequences))
    for parts in seen.values():
        end = 0
        for o, size in sorted(parts):
            assert o == end
            end += size
        assert end <= length
    return plan.sequences


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=32, max_size=32))
def test_plans_use_every_piece_once(tail):
    counts = [0, *tail]
    total = sum(n * k for n, k in enumerate(counts))
    # No worse than first-fit's bound.
    assert math.ceil(total / 32) <= placed(counts, 32) <= math.ceil(1.7 * total / 32) + 1


def test_plan_is_close_to_the_bound():
    draw = np.random.default_rng(2)
    lengths = np.clip(draw.gamma(2.0, 350.0, 20_000).astype(int), 1, 2048)
    used = placed(np.bincount(lengths, minlength=2049).tolist(), 2048)
    assert used <= 1.003 * math.ceil(lengths.sum() / 2048)


def test_pack(spark, odd_docs, odd_rows, no_docs):
    vocabulary = P.path("word_bpe_49k.json")
    packed = packing.pack(odd_docs, vocabulary, 256)
    model = Tokenizer.from_file(vocabulary)
    model.encode_special_tokens = True
    wanted = []
    for i, t in odd_rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        wanted += [(str(i), k, at, ids[at : at + 256]) for k, at in enumerate(range(0, len(ids), 256))]
    got = [(str(r.document), r.piece, r.start, unpacked(r.ids)) for r in packed.pieces.collect()]
    assert sorted(got) == sorted(wanted)
    places = packed.placement.collect()
    assert len(places) == len(wanted)
    whole = {r.sequence_id: unpacked(r.ids) for r in packed.packed().collect()}
    assert len(whole) == packed.sequences == len({r.sequence_id for r in places})
    for r in places:
        part = whole[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert packing.pack(no_docs, vocabulary).placement.count() == 0


def test_words_of_letters_go_to_the_model_itself():
    """What the library does per text costs more than the merges; the ids are those of whole texts."""
    path = P.path("byte_bpe_50k.json")
    ids = WordIds(path, True)
    words = ["lettering", "Zuteber", "ci\u00f3nragado", "\nEnausch", "\u0130stanbul", "\u0250x", "don't", "a1", "x\u0301y", "\u01c5", "\u4e2d\u6587", "_a", "\n"]
    text = "Start " + " ".join(words) + " end. Full, stop."
    library = Tokenizer.from_file(path)
    whole = ids.encode_all([text, text.replace(" ", "\n")])
    assert [list(array.array("I", x)) for x in whole] == [
        library.encode(t, add_special_tokens=False).ids for t in (text, text.replace(" ", "\n"))
    ]
    seen = []
    ids._encode = lambda texts, encode=ids._encode: seen.extend(texts) or encode(texts)
    assert list(array.array("I", ids.encode_all(["and unheardof\nlinebegin"])[0])) == library.encode("and unheardof\nlinebegin").ids
    assert not [t for t in seen if "unheardof" in t or "linebegin" in t]
