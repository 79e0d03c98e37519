"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The words of a slice are hashed in place; only words not seen before are
merged. Their symbols stand in one flat array. Each round finds the ranks of
all adjacent pairs by binary search over the sorted pair keys, takes the lowest
rank of each word and merges its occurrences from left to right; words without
a known pair leave the array. The vocabulary file is a parameter.

Defined cases: a null text is empty and has no tokens; a text that holds the
string of a special token gets that token's id there; repeated rows give
repeated results; extra columns are dropped before the work.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from .flat import code_points, flat_bytes, in_arrow, keyed, prefix_hash, ragged, span_hash, text_slices

LETTER, DIGIT, BLANK, OTHER = 0, 1, 2, 3
#: Word ends that the public pattern splits off after an apostrophe (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Words kept between slices of one task process; beyond it the store starts anew.
STORE_WORDS = 1_000_000
#: Rank of a pair that no merge has.
ABSENT = np.iinfo(np.int64).max
SLICE = 1 << 20


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(1)
def point_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for block in range(0, 0x110000, 0x800):  # all at once would be a million strings, whose memory stays with the process
        every = "" if block == 0xD800 else "".join(map(chr, range(block, block + 0x800)))
        for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}")):
            kinds[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    # code points that other Unicode versions class differently: as the tokenizers library does
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for point, kind in enumerate(kinds):
        if kind != {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(point))[0], OTHER):
            kinds[point] = next((k for k, mate in ((LETTER, "a"), (DIGIT, "1")) if len(split(mate + chr(point))) == 1), OTHER)
    blanks = [0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x20, *range(0x09, 0x0E), *range(0x2000, 0x200B)]
    kinds[blanks] = BLANK
    return kinds


def _following(flags: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros(len(flags), bool)
    out[step:] = flags[:-step]
    return out


def word_starts(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Flags of the code points that begin a word of the byte-level pattern, per row."""
    n = len(points)
    kinds = point_classes()[points]
    first = np.zeros(n + 1, bool)
    first[rows] = True
    last = first[1:]
    first = first[:-1]
    blank = kinds == BLANK
    after_blank = _following(blank, 1) & ~first
    joined = _following(points == 32, 1) & ~first  # a space belongs to the word behind it
    before_word = np.zeros(n, bool)
    before_word[:-1] = blank[:-1] & ~blank[1:]
    before_word &= ~last
    change = np.ones(n, bool)
    change[1:] = kinds[1:] != kinds[:-1]
    starts = first | np.where(blank, ~after_blank | before_word, np.where(after_blank, ~joined, change))
    quotes = np.flatnonzero((points == 39) & starts)
    if len(quotes):
        ends_of_row = rows[np.searchsorted(rows, quotes, "right")]
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        open_ = np.ones(len(quotes), bool)
        for tail in CONTRACTIONS:
            hit = open_ & (quotes + len(tail) < ends_of_row)
            for k, letter in enumerate(tail, 1):
                hit &= padded[quotes + k] == ord(letter)
            at, open_ = quotes[hit], open_ & ~hit
            starts[at + 1] = False
            behind = at + 1 + len(tail)
            behind = behind[behind < n]
            # a space or a run of blanks behind starts a word by itself; letters are cut off here
            starts[behind] = True
    return starts


class Vocabulary:
    """Merge table of a byte-level tokenizer file with its decoding table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made
        pieces = {i: bytes(letters[c] for c in word) for word, i in ids.items()}
        pieces |= {i: content.encode() for content, i in self.special.items()}
        self.size = max(pieces) + 1
        table = [pieces.get(i, b"") for i in range(self.size)]
        self.bytes, self.starts, self.lengths = _table(table)
        self.digits, self.digit_starts, self.digit_lengths = _table([b"%d," % i for i in range(self.size)])
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_starts = self.known_lengths = np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair at each given place with its right neighbour, by binary search."""
        if not len(at):
            return np.zeros(0, np.int64)
        right = np.minimum(at + 1, len(symbols) - 1)
        pair = symbols[at] << 32 | symbols[right]
        found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        whole = (self.keys[found] == pair) & (owner[at] == owner[right]) & (right > at)
        return np.where(whole, self.ranks[found], ABSENT)

    def merge(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final ids and lengths of words given as one flat array of byte ids and its n + 1 offsets."""
        n = len(words) - 1
        owner = np.repeat(np.arange(n), np.diff(words))
        done_ids, done_owner = [], []
        rank = self._ranks(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            count = np.diff(np.append(begin, len(owner)))
            lowest = np.repeat(np.minimum.reduceat(rank, begin), count)
            idle = lowest == ABSENT
            if idle.any():
                done_ids.append(symbols[idle])
                done_owner.append(owner[idle])
            hit = (rank == lowest) & ~idle
            # occurrences that overlap (a a a) are taken from the left, every second one
            place = np.flatnonzero(hit)
            twin = np.flatnonzero(symbols[place] == symbols[np.minimum(place + 1, len(symbols) - 1)])
            if len(twin):
                at = np.arange(len(place))
                fresh = np.concatenate([[True], np.diff(place) != 1])
                since = at - np.maximum.accumulate(np.where(fresh, at, 0))
                drop = twin[since[twin] % 2 == 1]
                hit[place[drop]] = False
                place = np.delete(place, drop)
            symbols[place] = self.made[rank[place]]
            keep = ~(_following(hit, 1) | idle)
            symbols, owner, rank, hit = symbols[keep], owner[keep], rank[keep], hit[keep]
            stale = np.flatnonzero(hit | np.append(hit[1:], False))
            rank[stale] = self._ranks(symbols, owner, stale)
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=n)

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Merge the words that are not in the store and add them."""
        unique, where = np.unique(hashes, return_index=True)
        at = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        new = np.ones(len(unique), bool) if not len(self.known) else self.known[at] != unique
        if len(self.known) + new.sum() > STORE_WORDS:
            self.clear()
            new[:] = True
        unique, where = unique[new], where[new]
        if not len(unique):
            return
        lengths = ends[where] - starts[where]
        symbols = self.byte_ids[data[ragged(starts[where], lengths)]]
        ids, counts = self.merge(symbols, np.concatenate([[0], np.cumsum(lengths)]))
        begin = len(self.store) + np.concatenate([[0], np.cumsum(counts)[:-1]])
        known = np.concatenate([self.known, unique])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.known_starts = np.concatenate([self.known_starts, begin])[order]
        self.known_lengths = np.concatenate([self.known_lengths, counts])[order]
        self.store = np.concatenate([self.store, ids])

    def encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows without special strings, and their n + 1 offsets."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        points, rows, firsts = code_points(data, offsets)
        begin = np.flatnonzero(word_starts(points, rows))
        end = np.append(begin[1:], len(points))
        hashes = span_hash(prefix_hash(points), begin, end)
        self._learn(data, hashes, firsts[begin], firsts[end])
        at = np.searchsorted(self.known, hashes)
        counts = self.known_lengths[at]
        ids = self.store[ragged(self.known_starts[at], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[np.searchsorted(begin, rows)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string column and their n + 1 row offsets."""
        data, offsets = flat_bytes(texts)
        raw = data.tobytes()
        found = [(m, s) for s in self.special for m in _occurrences(raw, s.encode())]
        if not found:
            return self.encode_plain(data, offsets)
        return self._encode_special(data, offsets, found)

    def _encode_special(self, data, offsets, found) -> tuple[np.ndarray, np.ndarray]:
        """Rows with special strings are cut there; each piece is encoded as a row of its own."""
        starts, ends, owner, fixed = [], [], [], []
        at = 0
        by_start = sorted(found)
        for row in range(len(offsets) - 1):
            begin, stop = int(offsets[row]), int(offsets[row + 1])
            while at < len(by_start) and by_start[at][0] < stop:
                place, content = by_start[at]
                size = len(content.encode())
                at += 1
                if place < begin or place + size > stop:
                    continue
                starts += [begin, place]
                ends += [place, place + size]
                fixed += [-1, self.special[content]]
                owner += [row, row]
                begin = place + size
            starts.append(begin)
            ends.append(stop)
            fixed.append(-1)
            owner.append(row)
        starts, ends, fixed = np.array(starts), np.array(ends), np.array(fixed)
        lengths = np.where(fixed >= 0, 0, ends - starts)
        ids, cuts = self.encode_plain(data[ragged(starts, lengths)], np.concatenate([[0], np.cumsum(lengths)]))
        counts = np.diff(cuts)
        out = np.zeros(len(ids) + int((fixed >= 0).sum()), np.int32)
        sizes = np.where(fixed >= 0, 1, counts)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        out[begin[:-1][fixed >= 0]] = fixed[fixed >= 0]
        out[ragged(begin[:-1][fixed < 0], counts[fixed < 0])] = ids
        rows = np.zeros(len(offsets), np.int64)
        np.add.at(rows, np.array(owner) + 1, sizes)
        return out, np.cumsum(rows)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of rows of ids, and their n + 1 offsets."""
        return _gather(self.bytes, self.starts, self.lengths, ids, offsets)

    def listed(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Rows of ids as decimal numbers, each with a comma behind it."""
        return _gather(self.digits, self.digit_starts, self.digit_lengths, ids, offsets)


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths


def _gather(flat, starts, lengths, ids, offsets) -> tuple[bytes, np.ndarray]:
    sizes = lengths[ids]
    out = flat[ragged(starts[ids], sizes)].tobytes()
    return out, np.concatenate([[0], np.cumsum(sizes)])[offsets]


def _occurrences(raw: bytes, piece: bytes) -> Iterator[int]:
    at = raw.find(piece)
    while at >= 0:
        yield at
        at = raw.find(piece, at + len(piece))


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process."""
    return Vocabulary(path)


def encode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                ids, offsets = words.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "ids"])

    rows = keyed(df, id_column, text_column)
    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode(df: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """One row per input row: id, text (null ids: empty; bytes that are not UTF-8 become replacement signs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            raw, cuts = words.decode(np.concatenate([np.zeros(0, np.int64), *lists]), offsets)
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    from pyspark.sql import functions as F

    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{ids_column}`").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, text string").withColumnRenamed("id", id_column)


def round_trip(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digests of the ids and of the text decoded from them.

    id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (UTF-8).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                ids, offsets = words.encode(part.column("text"))
                listed, marks = words.listed(ids, offsets)
                raw, cuts = words.decode(ids, offsets)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(np.diff(offsets), pa.int64()),
                    pa.array([hashlib.sha256(listed[a:max(a, b - 1)]).hexdigest() for a, b in zip(marks[:-1], marks[1:])], pa.string()),
                    pa.array([hashlib.sha256(_valid(raw[a:b])).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])], pa.string()),
                ], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = keyed(df, id_column, text_column)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return in_arrow(rows, run, schema).withColumnRenamed("id", id_column)


def _valid(raw: bytes) -> bytes:
    return raw.decode("utf-8", "replace").encode()


def default_path() -> str:
    """The public byte-level vocabulary; ``CDRLOOM_BPE_FILE`` names another one."""
    import public_tokenizers

    return os.environ.get("CDRLOOM_BPE_FILE") or public_tokenizers.path("byte_bpe_50k.json")
