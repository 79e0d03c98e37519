"""Suffix-array dedup: repeated byte strings by a difference-cover filter and fingerprints of whole windows.

A byte string of ``length`` bytes that starts at two places makes both suffixes
equal in their first ``length`` bytes. Only that many bytes matter, and only
suffixes with an equal partner:

1. Positions of each text whose offset modulo v lies in a perfect difference
   cover are sampled. Any two positions have a common shift below v after which
   both are sampled. Each sampled suffix gets the triple of names of its next
   three strings of (length - v + 1) / 3 bytes; triples are dealt out by a hash
   and those that stand alone are dropped. A repeated string always leaves a
   sampled pair behind, so nothing is lost. Only the places that are left go on.
2. Every window of ``length`` bytes with a surviving sample less than v bytes
   ahead is hashed from its bytes and dealt out by that fingerprint; every start
   whose fingerprint another start shares is repeated.

This is not the full difference-cover suffix sort: fingerprints of whole windows
replace its recursion and its merge, no names recur and suffixes have no order.
Equality of windows is all that is asked for, a fingerprint over all ``length``
bytes decides it, and neither ranks nor an order have to be handed round. Two of
n windows are confused with a probability of n**2 / 2**65.

Rows of a shuffle are columns of many names (one row per task and name range),
so a range costs what it holds. A text that occurs often is sampled once per
task, and a prefix that repeats within a task is sent once, so copies and common
passages do not pile up. Texts are sent compressed, and placed and sorted by the
least hash of their strings of 32 bytes, so near copies meet in one task.

Defined cases: a null text is empty; texts shorter than ``length`` are never
touched; a text with an exact copy is removed whole if it is long enough;
repeated rows are copies; extra columns are dropped before the work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, shared_folder
from .flat import (
    flat_bytes, in_arrow, join_planes, mix, prefix_hash, ragged, shuffle_tasks, span_hash, split_planes,
    text_key, text_slices, unseen, with_keys,
)

# A perfect difference cover (every residue is a difference of two members in exactly one way).
PERIOD = 183
COVER = (0, 1, 3, 16, 23, 28, 42, 76, 82, 86, 119, 137, 154, 175)
#: Perfect covers by period. A shorter one samples more places and compares more bytes behind each.
COVERS = {57: (0, 1, 3, 13, 32, 36, 43, 52), 91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81), PERIOD: COVER}
#: Names a task gathers before it deals them out.
GATHER = 300_000
#: Text bytes that are hashed at a time.
SLICE = 1 << 18
#: Bytes of a sampled name besides its range; false neighbours only cost work.
SAMPLE_BYTES = 5
#: Bytes of a text's key that stand for it among sampled names.
TAG = 8
#: Bytes whose least hash places a text next to near copies of it.
SHARED = 32
#: Rows of a batch that are turned into Python values at a time.
ROWS = 128
#: Names that are sorted at a time, about; all of a range stay in 16 bytes each.
SORTED = 1 << 17
#: Stands for the place of a name that is known to repeat.
KNOWN = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class DedupConfig:
    """Production parameters."""

    length: int = 400
    #: Period of the difference cover, at most half the length or so.
    period: int = PERIOD

    def triple(self) -> int:
        """Bytes of one of three strings behind a sampled position."""
        return max(1, (self.length - self.period + 1) // 3)


#: Passages of fifty words of four letters and a blank, or longer.
PASSAGE = DedupConfig(length=250, period=91)


@lru_cache(2)
def _cover_positions(n: int, period: int) -> np.ndarray:
    """Sampled positions up to n, ascending."""
    rounds = np.arange(-(-(n + 1) // period))[:, None] * period
    return (rounds + np.array(COVERS[period])[None, :]).ravel()


def sampled(sizes: np.ndarray, reach: int, period: int = PERIOD) -> tuple[np.ndarray, np.ndarray]:
    """Row and position of each sampled suffix of at least ``reach`` bytes."""
    every = _cover_positions(1 << int(max(1, sizes.max(initial=1))).bit_length(), period)
    counts = np.where(sizes >= reach, np.searchsorted(every, sizes - reach, "right"), 0)
    return np.repeat(np.arange(len(sizes)), counts), every[ragged(np.zeros(len(sizes), np.int64), counts)]


def triple_names(prefix: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Name of the triple of strings behind each position."""
    name = np.zeros(len(at), np.uint64)
    for k in range(3):
        name = mix(name + span_hash(prefix, at + k * width, at + (k + 1) * width))
    return name


def _in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``in_arrow`` whose workers give memory back at the end of a task; Spark keeps several of them for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return in_arrow(df, run, schema)


class Dealer:
    """Gathers (name, text, position) of a task and deals them out by name range."""

    SCHEMA = "range int, texts binary, counts binary, steps binary, names binary, known binary, note binary"

    def __init__(self, ranges: int, width: int, tag: int):
        self.ranges, self.width, self.tag = ranges, width, tag
        self.keys: list[bytes] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: list[bytes], names: np.ndarray, row: np.ndarray, place: np.ndarray) -> None:
        self.parts.append((names, row.astype(np.uint32) + np.uint32(len(self.keys)), place.astype(np.uint32)))
        self.keys += [key[:self.tag] for key in keys]
        self.held += len(names)

    def deal(self, share: bool) -> Iterator[pa.RecordBatch]:
        """One row per range. ``share``: names that repeat here go out once, their places as a note per text."""
        names, text, place = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32))
        self.parts = []
        known, notes = np.zeros(0, np.uint64), []
        if share and len(names):
            order = np.argsort(names, kind="stable")
            same = names[order][1:] == names[order][:-1]
            twin = np.zeros(len(names), bool)
            twin[order[1:][same]] = True
            twin[order[:-1][same]] = True
            known = np.unique(names[twin])
            notes = [(self.keys[t], p) for t, p in by_text(text[twin], place[twin])]
            names, text, place = names[~twin], text[~twin], place[~twin]
        n = np.uint64(self.ranges)
        order = np.argsort((names % n).astype(np.uint32), kind="stable")
        names, text, place = names[order], text[order], place[order]
        cuts = np.searchsorted((names % n).astype(np.int64), np.arange(self.ranges + 1))
        known = known[np.argsort((known % n).astype(np.uint32), kind="stable")]
        known_cuts = np.searchsorted((known % n).astype(np.int64), np.arange(self.ranges + 1))
        rows = []
        for r in range(self.ranges):
            a, b, c, d = cuts[r], cuts[r + 1], known_cuts[r], known_cuts[r + 1]
            if a == b and c == d:
                continue
            used, own = np.unique(text[a:b], return_inverse=True)
            rows.append((r, b"".join(self.keys[t] for t in used), *pack_places(own, place[a:b]), self._pack(names[a:b]), self._pack(known[c:d]), None))
        rows += [(int.from_bytes(key[:4], "little") % self.ranges, None, None, None, None, None, key + _runs(p).tobytes()) for key, p in notes]
        kinds = [pa.int32(), *[pa.binary()] * 6]
        names_of = [c.split()[0] for c in self.SCHEMA.split(", ")]
        for at in range(0, len(rows), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at:at + 512]), kinds)], names_of)
        self.keys, self.parts, self.held = [], [], 0

    def _pack(self, names: np.ndarray) -> bytes:
        rest = names // np.uint64(self.ranges) if self.width < 8 else names
        return rest.view(np.uint8).reshape(-1, 8)[:, :self.width].T.tobytes()


def pack_places(text: np.ndarray, place: np.ndarray) -> tuple[bytes, bytes]:
    """Places of ascending texts: names per text, and steps within a text, both compressed."""
    counts = np.bincount(text, minlength=int(text[-1]) + 1 if len(text) else 0).astype(np.uint32)
    step = np.diff(place, prepend=np.uint32(0)).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
    step[first] = place[first]
    return zstandard.compress(split_planes(counts), 1), zstandard.compress(split_planes(step), 1)


def unpack_places(counts: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Texts and places that ``pack_places`` packed."""
    count = join_planes(zstandard.decompress(counts), np.uint32).astype(np.int64)
    total = np.cumsum(join_planes(zstandard.decompress(steps), np.uint32).astype(np.int64))
    first = np.cumsum(count) - count
    before = np.where(first > 0, total[np.maximum(first - 1, 0)], 0) if len(total) else first
    return np.repeat(np.arange(len(count)), count), (total - np.repeat(before, count)).astype(np.uint32)


def _unpack(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view(np.uint64).ravel()


def by_text(text: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Texts and their places, ascending."""
    order = np.lexsort((place, text))
    text, place = text[order], place[order]
    cuts = np.flatnonzero(np.diff(text, prepend=np.int64(-1)))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(text)).tolist()):
        yield int(text[a]), place[a:b]


def _runs(place: np.ndarray) -> np.ndarray:
    """First and last of each run of consecutive places, int32 pairs."""
    place = place.astype(np.int64)
    begin = np.flatnonzero(np.diff(place, prepend=-2) != 1)
    end = np.append(begin[1:], len(place)) - 1
    return np.stack([place[begin], place[end]], 1).astype(np.int32)


def _repeated(slots: int, width: int, tag: int):
    """Runs of the places whose name another place of the range has, dealt out by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[bytes, int] = {}
        seen, names, spots = set(), [], []
        note_text, note_runs = [], []
        for row in _rows(batches):
            if row[6] is not None:
                pairs = np.frombuffer(row[6][tag:], np.int32).reshape(-1, 2)
                note_text.append(np.full(len(pairs), keys.setdefault(row[6][:tag], len(keys)), np.int32))
                note_runs.append(pairs)
                continue
            own = np.array([keys.setdefault(row[1][k:k + tag], len(keys)) for k in range(0, len(row[1]), tag)], np.uint64)
            seen.add(row[0])
            text, place = unpack_places(row[2], row[3])
            known = _unpack(row[5], width)
            names += [_unpack(row[4], width), known]
            spots += [own[text] << np.uint64(32) | place, np.full(len(known), KNOWN)]
        if width < 8 and len(seen) > 1:
            raise ValueError("names are only comparable within one range")
        if not keys:
            return
        spot = _matching(names, spots, width)
        fresh = np.diff(spot, prepend=np.uint64(0)) != 1
        fresh[:1] = True
        begin = np.flatnonzero(fresh)
        pairs = np.stack([spot[begin], spot[np.append(begin[1:], len(spot)) - 1]], 1) if len(begin) else np.zeros((0, 2), np.uint64)
        text = (pairs[:, 0] >> np.uint64(32)).astype(np.int32)
        yield from _by_slot(list(keys), np.concatenate([text, *note_text]), np.concatenate([pairs.astype(np.uint32).view(np.int32), *note_runs]), slots)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as tuples, a few turned into Python values at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from zip(*(column.to_pylist() for column in batch.slice(at, ROWS).columns))


def _matching(names: list[np.ndarray], spots: list[np.ndarray], width: int) -> np.ndarray:
    """Spots (text above 32 bits of place), ascending, whose name is known to repeat or stands at two spots.

    Empties the lists. Names with the same highest bits are sorted together,
    one such share after the other.
    """
    bits = (sum(map(len, names)) // SORTED).bit_length()
    name = np.concatenate(names or [np.zeros(0, np.uint64)])
    names.clear()
    spot = np.concatenate(spots or [np.zeros(0, np.uint64)])
    spots.clear()
    share = (name >> np.uint64(8 * width - bits)).astype(np.uint16) if bits else np.zeros(len(name), np.uint16)
    found = [_repeating(name[own], spot[own]) for own in (np.flatnonzero(share == k) for k in range(1 << bits))]
    del name, spot, share
    out = np.concatenate(found)
    out.sort()
    return out[np.diff(out, prepend=KNOWN) != 0]


def _repeating(name: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Sort names and compare neighbours: spots of those that are known to repeat or stand at two spots."""
    order = np.argsort(name, kind="stable")
    name, spot = name[order], spot[order]
    begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
    if not len(begin):
        return spot
    size = np.diff(np.append(begin, len(name)))
    other = (spot != np.repeat(spot[begin], size)) | (spot == KNOWN)
    return spot[np.repeat(np.logical_or.reduceat(other, begin), size) & (spot != KNOWN)]


SLOTS = "slot int, keys binary, counts binary, runs binary"


def _by_slot(keys: list[bytes], text: np.ndarray, pairs: np.ndarray, slots: int) -> Iterator[pa.RecordBatch]:
    """One row per slot of texts: their keys, runs per text, and the runs."""
    slot_of = np.array([int.from_bytes(k[:4], "little") % slots for k in keys], np.int64)
    order = np.lexsort((text, slot_of[text]))
    text, pairs = text[order], pairs[order]
    cuts = np.searchsorted(slot_of[text], np.arange(slots + 1))
    rows = []
    for slot in np.flatnonzero(np.diff(cuts)).tolist():
        own, counts = np.unique(text[cuts[slot]:cuts[slot + 1]], return_counts=True)
        rows.append((slot, b"".join(keys[t] for t in own), counts.astype(np.uint32).tobytes(), pairs[cuts[slot]:cuts[slot + 1]].tobytes()))
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    for at in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at:at + 256]), kinds)], ["slot", "keys", "counts", "runs"])


def _gathered(tag: int):
    """All runs of each text of a slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[bytes, int] = {}
        texts, pairs = [], []
        for batch in batches:
            for own, counts, found in zip(*(batch.column(k).to_pylist() for k in ("keys", "counts", "runs"))):
                index = np.array([keys.setdefault(own[k:k + tag], len(keys)) for k in range(0, len(own), tag)], np.int32)
                texts.append(np.repeat(index, np.frombuffer(counts, np.uint32)))
                pairs.append(np.frombuffer(found, np.int32).reshape(-1, 2))
        if not keys:
            return
        text, pair = np.concatenate(texts), np.concatenate(pairs)
        order = np.argsort(text, kind="stable")
        pair, cuts = pair[order], np.searchsorted(text[order], np.arange(len(keys) + 1))
        label = list(keys)
        for at in range(0, len(label), 4096):
            stop = min(len(label), at + 4096)
            yield pa.RecordBatch.from_arrays([
                pa.array(label[at:stop], pa.binary()), pa.array([[pair[cuts[k]:cuts[k + 1]].tobytes()] for k in range(at, stop)], pa.list_(pa.binary())),
            ], ["key", "runs"])

    return run


def _compare(dealt: DataFrame, ranges: int, slots: int, width: int, tag: int) -> DataFrame:
    """Sort each range of names and compare neighbours; per text: key, runs (of places).

    A range gives a row to each slot of texts at most, so more ranges go with fewer slots.
    """
    found = _in_arrow(dealt.repartitionById(ranges, F.col("range")), _repeated(slots, width, tag), SLOTS)
    return _in_arrow(found.repartitionById(slots, F.col("slot")), _gathered(tag), "key binary, runs array<binary>")


def _unseen_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of texts that the task has not met before; only a slice is ever copied."""
    return (part for part in unseen(s for batch in batches for s in text_slices(batch, "text", SLICE)) if part.num_rows)


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, tag, packed (compressed text) and low (least hash of its strings of SHARED bytes), once per task."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for part in _unseen_slices(batches):
        data, offsets = flat_bytes(part.column("text"))
        prefix, at = prefix_hash(data), np.arange(max(0, len(data) - SHARED + 1))
        hashes, raw = span_hash(prefix, at, at + SHARED), data.tobytes()
        lows = [int(hashes[a:max(a + 1, b - SHARED + 1)].min()) if a < len(hashes) else 0 for a, b in zip(offsets[:-1], offsets[1:])]
        keys = part.column("key").to_pylist()
        yield pa.RecordBatch.from_arrays([
            part.column("key"), pa.array([k[:TAG] for k in keys], pa.binary()),
            pa.array([pack(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
            pa.array(np.array(lows, np.uint64).view(np.int64)),
        ], ["key", "tag", "packed", "low"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Row ranges of about SLICE bytes of text, with their texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    begin, held, texts = 0, 0, []
    for k, blob in enumerate(batch.column("packed")):
        texts.append(unpack(blob.as_buffer()) if blob.is_valid and len(blob.as_buffer()) else b"")
        held += len(texts[-1])
        if held >= SLICE:
            yield batch.slice(begin, k + 1 - begin), texts
            begin, held, texts = k + 1, 0, []
    if texts:
        yield batch.slice(begin), texts


def _places(runs: list[bytes]) -> np.ndarray:
    pairs = np.frombuffer(b"".join(runs), np.int32).reshape(-1, 2).astype(np.int64)
    return np.unique(ragged(pairs[:, 0], pairs[:, 1] - pairs[:, 0] + 1))


def candidate_starts(places: np.ndarray, last: int, period: int = PERIOD) -> np.ndarray:
    """Starts up to ``last`` that have one of the sampled ``places`` less than a period ahead."""
    begin, end = np.maximum(0, places - period + 1), np.minimum(places, last)
    ok = end >= begin
    begin, end = begin[ok], end[ok]
    mark = np.zeros(last + 2, np.int32)
    np.add.at(mark, begin, 1)
    np.add.at(mark, end + 1, -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def lasting(starts: np.ndarray, n: int) -> np.ndarray:
    """Those of the ascending starts whose next ``n`` places are starts too."""
    last = max(0, len(starts) - n)
    return starts[:last][starts[len(starts) - last:] - starts[:last] == n]


def shared_texts(texts: DataFrame, config: DedupConfig) -> DataFrame:
    """key, packed text and surviving sampled places (runs) of the texts that share a sampled triple with another place."""
    tasks, more, width = shuffle_tasks(texts), max(1, PERIOD // config.period), config.triple()
    ranges = tasks * more

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(ranges, SAMPLE_BYTES, TAG)
        for part in _unseen_slices(batches):
            data, offsets = flat_bytes(part.column("text"))
            row, place = sampled(np.diff(offsets), max(config.length - config.period + 1, 3 * width), config.period)
            names = triple_names(prefix_hash(data), offsets[row] + place, width)
            dealer.add(part.column("key").to_pylist(), names, row, place)
            if dealer.held >= GATHER:
                yield from dealer.deal(share=False)
        yield from dealer.deal(share=False)

    spots = _compare(_in_arrow(texts, sample, Dealer.SCHEMA), ranges, -(-tasks // more), SAMPLE_BYTES, TAG).withColumnRenamed("key", "tag")
    once = _in_arrow(texts, _pack_texts, "key binary, tag binary, packed binary, low bigint")
    return once.join(spots, "tag").hint("rebalance", "low").sortWithinPartitions("low", "key").select("key", "packed", "runs")


def repeated_starts(shared: DataFrame, config: DedupConfig, *longer: DedupConfig) -> DataFrame:
    """key, length and runs of the starts of strings that also start elsewhere.

    ``shared`` holds the texts of ``config``, the shortest length. A longer
    string repeats only where all shorter ones that start inside it do.
    """
    lengths = [config.length, *(c.length for c in longer)]
    tasks = shuffle_tasks(shared)
    ranges = tasks * len(lengths)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, seen = Dealer(ranges, 8, 17), set()
        for batch in batches:
            for part, texts in _unpacked(batch):
                data, offsets = flat_bytes(pa.array(texts, pa.binary()))
                prefix = prefix_hash(data)
                keys = part.column("key").to_pylist()
                found = []
                for k, runs in enumerate(part.column("runs").to_pylist()):
                    size = int(offsets[k + 1] - offsets[k])
                    if size >= config.length and keys[k] not in seen:
                        seen.add(keys[k])
                        found.append((k, candidate_starts(_places(runs), size - config.length, config.period)))
                for n, length in enumerate(lengths):
                    place = [lasting(starts, length - config.length) for _, starts in found]
                    row = np.repeat(np.array([k for k, _ in found], np.int64), [len(p) for p in place])
                    place = np.concatenate([np.zeros(0, np.int64), *place])
                    at = offsets[row] + place
                    # a text counts as one of its own for each length; hashes of strings depend on their lengths
                    dealer.add([key + bytes([n]) for key in keys], span_hash(prefix, at, at + length), row, place)
                    if dealer.held >= GATHER:
                        yield from dealer.deal(share=True)
        yield from dealer.deal(share=True)

    length = F.element_at(F.array(*map(F.lit, lengths)), F.conv(F.hex(F.substring("key", 17, 1)), 16, 10).cast("int") + 1)
    found = _compare(_in_arrow(shared, windows, Dealer.SCHEMA), ranges, -(-tasks // len(lengths)), 8, 17)
    return found.select(F.substring("key", 1, 16).alias("key"), length.alias("length"), "runs")


def covered(runs: list[bytes], length: int) -> np.ndarray:
    """Maximal byte spans (first, end) that strings at these starts cover."""
    pairs = np.frombuffer(b"".join(runs), np.int32).reshape(-1, 2).astype(np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    end = np.maximum.accumulate(pairs[:, 1] + length)
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = pairs[1:, 0] > end[:-1]
    begin = np.flatnonzero(fresh)
    return np.stack([pairs[begin, 0], end[np.append(begin[1:], len(pairs)) - 1]], 1)


def whole_points(data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Spans shrunk to whole code points; empty ones are dropped."""
    begin, end = spans[:, 0].copy(), spans[:, 1].copy()
    tail = (data & 0xC0) == 0x80
    for k in range(len(begin)):
        while begin[k] < end[k] and tail[begin[k]]:
            begin[k] += 1
        while end[k] > begin[k] and end[k] < len(data) and tail[end[k]]:
            end[k] -= 1
    return np.stack([begin, end], 1)[end > begin]


def without(data: bytes, spans: np.ndarray) -> bytes:
    """The bytes outside the spans."""
    edges = [0, *spans.ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def copies(keys: DataFrame, config: DedupConfig) -> DataFrame:
    """Keys of texts that occur twice or more and are long enough to be removed whole."""
    return keys.where(F.col("n_bytes") >= config.length).groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("copied"))


def removals(
    documents: DataFrame, config: DedupConfig = DedupConfig(), id_column: str = "doc_id", text_column: str = "text", passages: DedupConfig | None = None,
) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256.

    ``passages``, a shorter length, adds passage_removed, passage_spans and
    passage_kept_sha256: the same of strings of that length.
    """
    asked = {"": config} if passages is None else {"": config, "passage_": passages}
    short = passages or config
    if short.length > config.length:
        raise ValueError("passages must not be longer than the strings")
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    keys = documents.select(
        F.col(f"`{id_column}`").alias("id"), text_key(text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("digest")
    )
    folder = shared_folder(documents.sparkSession, "shared-texts")
    texts = with_keys(documents, text_column).where(F.octet_length("text") >= short.length)
    shared_texts(texts, short).write.parquet(folder)
    shared = documents.sparkSession.read.parquet(folder)
    starts = repeated_starts(shared, short, *(c for c in asked.values() if c.length > short.length)).withColumnRenamed("runs", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in (x for batch in batches for x in _unpacked(batch)):
            out = []
            for key, data, length, runs in zip(part.column("key").to_pylist(), texts, part.column("length").to_pylist(), part.column("starts").to_pylist()):
                spans = covered(runs, length)
                out.append((key, length, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(without(data, spans)).hexdigest()))
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], ["key", "length", "removed", "spans", "kept"])

    found = _in_arrow(shared.select("key", "packed").join(starts, "key"), cut, "key binary, length int, removed long, spans long, kept string")
    # written on their own, so that the joins can split the partition of a text with many copies
    changed = cut_lineage(found.dropDuplicates(["key", "length"]))
    out, columns = keys.join(cut_lineage(copies(keys, short)), "key", "left"), []
    for name, c in asked.items():
        part = changed.where(F.col("length") == c.length).select("key", *(F.col(x).alias(f"{name}{x}") for x in ("removed", "spans", "kept")))
        out = out.join(part, "key", "left")
        whole, nothing = F.col("copied").isNotNull() & (F.col("n_bytes") >= c.length), hashlib.sha256(b"").hexdigest()
        columns += [
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce(f"{name}removed", F.lit(0))).alias(f"{name or 'n_'}removed"),
            F.when(whole, 1).otherwise(F.coalesce(f"{name}spans", F.lit(0))).cast("long").alias(f"{name or 'n_'}spans"),
            F.when(whole, nothing).otherwise(F.coalesce(f"{name}kept", "digest")).alias(f"{name}kept_sha256"),
        ]
    return out.select(F.col("id").alias(id_column), "n_bytes", *columns)


def remove_repeats(documents: DataFrame, config: DedupConfig = DedupConfig(), text_column: str = "text", size_column: str | None = None) -> DataFrame:
    """Documents without the repeated strings, all columns as they were.

    Cuts are made between code points; ``size_column`` gets the new number of
    code points. A document of which nothing is left keeps its row.
    """
    texts = with_keys(documents, text_column).where(F.octet_length("text") >= config.length)
    folder = shared_folder(documents.sparkSession, "shared-texts")
    shared_texts(texts, config).write.parquet(folder)
    starts = repeated_starts(documents.sparkSession.read.parquet(folder), config).select(F.col("key").alias("__key"), F.col("runs").alias("__starts"))
    rows = documents.withColumn("__key", text_key(F.col(f"`{text_column}`").cast("string")))
    keys = rows.select(F.col("__key").alias("key"), F.octet_length(F.col(f"`{text_column}`")).alias("n_bytes"))
    rows = rows.join(starts, "__key", "left").join(cut_lineage(copies(keys, config)).withColumnsRenamed({"key": "__key", "copied": "__copied"}), "__key", "left")
    rows = rows.select(*[F.col(f"`{c}`") for c in documents.columns], "__starts", "__copied")
    names = documents.columns
    place = names.index(text_column)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_column):
                texts = part.column(place).cast(pa.binary()).to_pylist()
                out = []
                for data, runs, copied in zip(texts, part.column("__starts").to_pylist(), part.column("__copied").to_pylist()):
                    if copied:
                        data = b""
                    elif runs and data:
                        data = without(data, whole_points(np.frombuffer(data, np.uint8), covered(runs, config.length)))
                    out.append(data)
                columns = [part.column(k) for k in range(len(names))]
                columns[place] = pa.array(out, pa.binary()).cast(columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    out = _in_arrow(rows, cut, documents.schema)
    if size_column is not None:
        out = out.withColumn(size_column, F.char_length(f"`{text_column}`").cast(documents.schema[size_column].dataType))
    return out
