import hashlib
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zlib
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from cdrloom.llm import bpe, packing, token_counts

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def rows_of(texts):
    ids, offsets = bpe.vocabulary(PATH).encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" 's\n\t1a")), max_size=40), min_size=1, max_size=6))
def test_equals_the_library(texts):
    library = Tokenizer.from_file(PATH)
    assert rows_of(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_special_strings_and_long_words(library):
    texts = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "", "x" * 5000, " " * 700, "ab" * 3000, "it's they'll 'S 's's"]
    assert rows_of(texts + [None]) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)] + [[]]


def test_store_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "STORE_WORDS", 3)
    bpe.vocabulary(PATH).clear()
    texts = ["one two three four five six", "six seven one", "two"]
    assert [rows_of([t])[0] for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_digests(make_docs, corpus, library):
    found = bpe.round_trip(make_docs(corpus), PATH).collect()
    expected = Counter()
    for i, t in corpus:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(map(tuple, found)) == expected
    assert bpe.round_trip(make_docs([]), PATH).count() == 0


def test_encode_then_decode(make_docs, corpus):
    back = bpe.decode(bpe.encode(make_docs(corpus), PATH), PATH).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in corpus)


@pytest.mark.parametrize("length", [1, 8, 1024])
def test_pieces_cover_each_document_once(make_docs, corpus, library, length):
    rows = packing.pack(make_docs(corpus), PATH, length, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and r.length <= length and r.length == 1 << r.bucket == len(r.ids) for r in rows)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    expected = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in corpus)
    found, current = Counter(), []
    for r in sorted(rows, key=lambda r: r.sequence_id):
        if r.start == 0:
            current = []
        assert len(current) == r.start
        current += r.ids
        if len(current) == r.doc_tokens:
            found[r.doc_id, tuple(current)] += 1
    assert found == expected


def test_packing_of_an_empty_table(make_docs):
    assert packing.pack(make_docs([]), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.binary_pieces(np.array([5]), 12)


def longest_match(word, pieces):
    at = count = 0
    while at < len(word):
        size = next((n for n in range(len(word) - at, 0, -1) if word[at:at + n] in pieces), 0)
        if not size:
            return 0
        at, count = at + size, count + 1
    return count


def test_automaton_equals_greedy_cutting():
    rng = random.Random(2)
    for _ in range(300):
        pieces = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9))})
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12))) for _ in range(20)]
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        found = token_counts.Automaton(pieces).counts(np.frombuffer(b"".join(words), np.uint8), offsets[:-1], offsets[1:], None)
        assert found.tolist() == [longest_match(w, set(pieces)) for w in words]


def test_token_counts(make_docs, corpus):
    rows = corpus[:24] + corpus[35:]
    found = token_counts.token_counts(make_docs(rows), PATH).collect()
    pieces = set(token_counts.vocabulary_pieces(PATH))
    expected = Counter()
    for i, t in rows:
        words = (t or "").encode().split()
        counts = [longest_match(b" " + w, pieces) for w in words]
        expected[i, len(words), sum(max(1, c) for c in counts), counts.count(0)] += 1
    assert Counter(map(tuple, found)) == expected
    assert token_counts.token_counts(make_docs([]), PATH).count() == 0


def test_long_words_cost_a_lookup_per_byte():
    rng = random.Random(8)
    pieces = [bytes([b]) for b in b" abc"] + [b" a", b"ab", b"abc", b"bca", b"cab", b"aabb", b"ccc"]
    machine = token_counts.Automaton(pieces)
    words = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (3, 255, 256, 257, 400, 100_000)]
    words.insert(3, b"ab" * 200 + b"x")  # a byte that no piece has: the word is unknown

    def greedy(word):
        at, n = 0, 0
        while at < len(word):
            size = max((len(p) for p in pieces if word.startswith(p, at)), default=0)
            if not size:
                return 0
            at, n = at + size, n + 1
        return n

    offsets = np.cumsum([0] + [len(w) for w in words])
    begun = time.time()
    found = machine.counts(np.frombuffer(b"".join(words), np.uint8), offsets[:-1], offsets[1:], 0x20)
    assert time.time() - begun < 2
    assert found.tolist() == [greedy(b" " + w) for w in words]
