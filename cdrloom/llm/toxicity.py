"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks for word begin and end)
and of itself, each hashed to a row of the embedding table; its vector is their
mean. The word vectors of a segment of a few dozen words (a word that follows
itself counts once) are averaged over the full width of a segment and go
through a linear softmax; a document is as toxic as its most toxic segment, so
a single insult in a long text is not averaged away. Scoring and calibration
read segments that overlap by half, training reads them side by side. Embeddings and softmax are
trained together on a bounded sample of labelled rows: first each segment takes
the label of its document, then only the highest segment of a toxic document
counts. Misspellings and inflections share most n-grams, hence vectors, with
words that were seen.

Defined cases: a null text is empty; an empty text has one segment without
words, whose score is that of the bias alone; repeated rows get equal scores;
without labels of both classes every score is 0; labelled rows of both classes
of which the sample has none of one are an error; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import DIGIT, LETTER, point_classes
from .flat import code_points, flat_bytes, in_arrow, keyed, prefix_hash, span_hash, text_slices
from .quality import platt, sigmoid
from .sample import held_back, labelled_sample


#: Text bytes that are cut into subwords at a time, and in the driver, where the sample lies beside them.
SLICE = 1 << 19
FIT_SLICE = 1 << 16

#: N-grams that are hashed, and entries that are summed, at a time.
STEP = 1 << 16


@dataclass(frozen=True)
class ToxicityConfig:
    """Production parameters."""

    bits: int = 22  # features are hashed to 2**bits keys; those of the sample have a vector
    dims: int = 3
    grams: tuple[int, ...] = (3, 4, 5)  # characters, word marks included
    segment: int = 32  # words
    rows: int = 2500  # labelled rows per class in the sample, at most
    row_bytes: int = 6000  # longer texts first get half of the text in the sample, then what is left
    text_bytes: tuple[int, int] = (4 << 20, 2 << 20)  # text of class 0 and of class 1 in the sample, at most
    min_share: float = 0.005  # features in a smaller share of the sample's rows (3 rows at least) have no vector
    penalty: float = 1e-5
    rate: float = 0.3  # first step size, falling to 0
    gain: float = 40.0  # scale of the first softmax weights: one word has to move the mean of a segment
    rounds: int = 60
    check: int = 10  # rounds between two looks at the held-out rows
    own_rounds: int = 20  # of these, rounds in which every segment takes its document's label
    threshold: float = 0.5
    seed: int = 7


@lru_cache(1)
def _lower() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x3000):
        small = chr(c).lower()
        if len(small) == 1:
            table[c] = ord(small)
    return table


def subwords(texts: pa.Array, config: ToxicityConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature keys, the word of each, a hash per word and the first word of each row (n + 1 values)."""
    data, offsets = flat_bytes(texts)
    points, rows, _ = code_points(data, offsets) if len(data) else (np.zeros(0, np.uint32), offsets, None)
    # one mark before each row and one at the end
    n = len(offsets) - 1
    place = np.arange(len(points)) + 1 + np.repeat(np.arange(n), np.diff(rows))
    stream = np.zeros(len(points) + n + 1, np.uint32)
    kinds = point_classes()[points]
    inside = np.zeros(len(stream) + max(config.grams), bool)
    inside[place] = (kinds == LETTER) | (kinds == DIGIT)
    stream[place] = np.where(inside[place], _lower()[points], 0)
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    opens = np.zeros(len(inside), bool)
    opens[starts] = True
    word_of = np.cumsum(opens, dtype=np.int32) - np.int32(1)
    prefix = prefix_hash(stream)
    hashes = span_hash(prefix, starts, ends)
    first = np.searchsorted(starts, rows + np.arange(n + 1))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[first[:-1][first[:-1] < len(fresh)]] = True
    shift = np.uint64(64 - config.bits)
    keys, owner = [(hashes >> shift).astype(np.int32)], [np.arange(len(starts), dtype=np.int32)]
    letters = np.zeros(len(inside) + 1, np.int32)
    np.cumsum(inside, out=letters[1:])
    for size in config.grams:
        n_begin = max(0, len(stream) - size + 1)
        begin = np.flatnonzero(letters[size - 1:size - 1 + n_begin] - letters[1:1 + n_begin] == size - 2)
        for at in range(0, len(begin), STEP):
            some = begin[at:at + STEP]
            keys.append(((span_hash(prefix, some, some + size) ^ np.uint64(size)) >> shift).astype(np.int32))
            owner.append(word_of[some + 1])
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    if not fresh.all():
        renamed = np.zeros(len(fresh) + 1, np.int32)
        np.cumsum(fresh, out=renamed[1:])
        stay = fresh[owner]
        keys, owner = keys[stay], renamed[owner[stay]]
        hashes, first = hashes[fresh], renamed[first].astype(np.int64)
    return keys, owner, hashes, first


def segments(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each segment (and the end), and the row of each segment; a row without words has one segment."""
    words = np.diff(first)
    counts = np.maximum(1, -(-words // size))
    row = np.repeat(np.arange(len(words)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.append(first[:-1][row] + number * size, first[-1]), row


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and row of segments that begin every half segment, so that no border parts neighbouring words in all of them."""
    words, step = np.diff(first), max(1, size // 2)
    counts = 1 + np.maximum(0, -(-(words - size) // step))
    row = np.repeat(np.arange(len(words)), counts)
    starts = first[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    return starts, np.minimum(starts + size, first[1:][row]), row


@dataclass(frozen=True)
class ToxicityModel:
    """Embeddings projected on the softmax: a value per feature that has a vector, and the bias."""

    keys: np.ndarray
    values: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def table(self, bits: int) -> np.ndarray:
        """Value of every hashed key; 0 without a vector."""
        if "dense" not in self.__dict__:
            dense = np.zeros(1 << bits, np.float32)
            dense[self.keys] = self.values
            self.__dict__["dense"] = dense
        return self.__dict__["dense"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "dense"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def score(self, texts: pa.Array, config: ToxicityConfig) -> np.ndarray:
        """Probability of each text."""
        return sigmoid(self.slope * self.margins(texts, config) + self.shift)

    def margins(self, texts: pa.Array, config: ToxicityConfig) -> np.ndarray:
        """Margin of the most toxic segment of each text."""
        keys, owner, hashes, first = subwords(texts, config)
        n_words = len(hashes)
        sums = np.bincount(owner, weights=self.table(config.bits)[keys], minlength=n_words)
        word = np.concatenate([[0], np.cumsum(sums / np.maximum(1, np.bincount(owner, minlength=n_words)))])
        starts, ends, row = windows(first, config.segment)
        mean = (word[ends] - word[starts]) / config.segment
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, row, mean)
        return top + self.bias


def fit_model(texts: list[str], labels: np.ndarray, config: ToxicityConfig, prior: float = 0.5) -> ToxicityModel | None:
    """Train embeddings and softmax on four fifths of the sample; None without both classes.

    The rest calibrates the model as it stands after every few rounds and picks
    the one of least loss, for a table in which a share ``prior`` is toxic.
    """
    labels = np.asarray(labels, np.int64)
    held = held_back(labels)
    if not len(labels) or labels[~held].min() == labels[~held].max():
        return None
    held_texts = [t for t, h in zip(texts, held) if h]
    marks, best = labels[held].astype(np.float64), (np.inf, None)
    for model in _train([t for t, h in zip(texts, held) if not h], labels[~held], config):
        margin = np.concatenate([np.zeros(0), *(
            model.margins(part.column("text"), config)
            for part in text_slices(pa.record_batch([pa.array(held_texts, pa.string())], ["text"]), "text", SLICE)
        )])
        slope, shift = platt(margin, marks, prior)
        p = np.clip(sigmoid(slope * margin + shift), 1e-6, 1 - 1e-6)
        weight = np.where(marks == 1, prior / max(1, marks.sum()), (1 - prior) / max(1, (1 - marks).sum()))
        loss = -float((weight * (marks * np.log(p) + (1 - marks) * np.log(1 - p))).sum())
        if loss < best[0]:
            best = loss, replace(model, slope=slope, shift=shift)
        del model  # its dense table would stay through the next rounds
    return best[1]


def _changes(values: np.ndarray) -> np.ndarray:
    """Places where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])[:len(values)])


def _groups(cuts: np.ndarray, n: int) -> tuple[list[slice], list[slice]]:
    """Ranges of whole groups, about ``STEP`` of the n entries each: places in ``cuts`` (where groups begin) and entries."""
    places, entries, first = [], [], 0
    while first < len(cuts):
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + STEP)))
        places.append(slice(first, last))
        entries.append(slice(int(cuts[first]), int(cuts[last]) if last < len(cuts) else n))
        first = last
    return places, entries


class Summing:
    """Weighted sums of rows of a table into rows of another, and the gradient's way back."""

    def __init__(self, into: np.ndarray, of: np.ndarray, weight: np.ndarray, n: int):
        self.n = n
        self.ahead = self._sorted(into, of, weight)
        self.back = self._sorted(of, into, weight)

    @staticmethod
    def _sorted(by: np.ndarray, other: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(by, kind="stable")
        by = by[order]
        cuts = _changes(by)
        return by[cuts], cuts, other[order].astype(np.int32, copy=False), weight[order].astype(np.float32, copy=False)[:, None]

    @staticmethod
    def _sum(parts, table: np.ndarray, n: int) -> np.ndarray:
        rows, cuts, other, weight = parts
        out, table = np.zeros((n, table.shape[1])), table.astype(np.float32)
        for place, some in zip(*_groups(cuts, len(other))):
            out[rows[place]] = np.add.reduceat(table[other[some]] * weight[some], cuts[place] - some.start, axis=0)
        return out

    def forward(self, table: np.ndarray) -> np.ndarray:
        return self._sum(self.ahead, table, self.n)

    def backward(self, gradient: np.ndarray, n: int) -> np.ndarray:
        return self._sum(self.back, gradient, n)


def _distinct_words(part: pa.RecordBatch, known: np.ndarray, config: ToxicityConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all rows, first word of each row (n + 1 values), the new words in order, and feature keys and new word of each entry.

    Features of a word are kept once, so what a slice of the text needs beside them goes with the slice.
    """
    hashes, first, new, keys, owner, seen, n_new = [], [np.zeros(1, np.int64)], [], [], [], known, 0
    for piece in text_slices(part, "text", FIT_SLICE):
        k, of, h, cuts = subwords(piece.column("text"), config)
        distinct, where = np.unique(h, return_index=True)
        fresh = seen[np.minimum(np.searchsorted(seen, distinct), len(seen) - 1)] != distinct if len(seen) else np.ones(len(distinct), bool)
        number = np.full(len(h), -1, np.int32)
        number[where[fresh]] = n_new + np.arange(fresh.sum())
        mine = number[of]
        keys.append(k[mine >= 0])
        owner.append(mine[mine >= 0])
        new.append(distinct[fresh])
        seen, n_new = np.sort(np.concatenate([seen, distinct[fresh]])), n_new + int(fresh.sum())
        first.append(cuts[1:] + first[-1][-1])
        hashes.append(h)
    new, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *new]), return_inverse=True)
    pair = np.unique(place[np.concatenate([np.zeros(0, np.int32), *owner])] << 32 | np.concatenate([np.zeros(0, np.int32), *keys]))
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate(first), new, (pair & 0xFFFFFFFF).astype(np.int32), (pair >> 32).astype(np.int32)


def _sums(texts: list[str], config: ToxicityConfig) -> tuple[np.ndarray, np.ndarray, Summing, Summing]:
    """Features that get a vector, row of each segment, and the ways from vectors to words and from words to segments."""
    keys, owners, new_words, words, seg_start, seg_row, at, rows, n_known = [], [], [], [], [], [], 0, 0, 0
    known = np.zeros(0, np.uint64)
    for part in text_slices(pa.record_batch([pa.array(texts, pa.string())], ["text"]), "text", SLICE):
        hashes, first, new, k, owner = _distinct_words(part, known, config)
        cuts, row = segments(first, config.segment)
        # features of each distinct word once
        keys.append(k)
        owners.append(owner + np.int32(n_known))
        new_words.append(new)
        known, n_known = np.sort(np.concatenate([known, new])), n_known + len(new)
        words.append(hashes)
        seg_start.append(cuts[:-1] + at)
        seg_row.append(row + rows)
        at, rows = at + len(hashes), rows + part.num_rows
    seg_row = np.concatenate(seg_row)
    seg_size = np.diff(np.append(np.concatenate(seg_start), at))
    distinct, place = np.unique(np.concatenate(new_words), return_inverse=True)
    word = np.concatenate([np.searchsorted(distinct, x).astype(np.int32) for x in words])
    del hashes, words, new_words, known
    keys, owner = np.concatenate(keys), place[np.concatenate(owners)].astype(np.int32)
    del owners, place
    width = np.bincount(owner, minlength=len(distinct))
    pair = np.repeat(np.arange(len(seg_row)) << 32, seg_size)
    pair |= word
    pair, count = np.unique(pair, return_counts=True)
    seg, word = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
    del pair
    to_segment = Summing(seg, word, (count / config.segment).astype(np.float32), len(seg_row))
    del count
    kept, keys, owner = _frequent(keys, owner, word, seg_row[seg].astype(np.int32), len(distinct), max(3, round(config.min_share * len(texts))))
    del seg, word
    part_of = (1 / width).astype(np.float32)[owner]
    return kept, seg_row, Summing(owner, keys, part_of, len(distinct)), to_segment


def _train(texts: list[str], labels: np.ndarray, config: ToxicityConfig) -> Iterator[ToxicityModel]:
    """The model after every ``check`` rounds beyond the first ones."""
    kept, seg_row, to_word, to_segment = _sums(texts, config)
    size = len(kept)
    rng = np.random.default_rng(config.seed)
    table = rng.normal(0, 0.1, (size, config.dims))
    out, bias = rng.normal(0, config.gain, (config.dims, 2)), np.zeros(2)
    params = [table, out, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    y = labels[seg_row]
    toxic_rows = np.flatnonzero(labels == 1)
    for k in range(1, config.rounds + 1):
        mean = to_segment.forward(to_word.forward(table))
        z = mean @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weight = np.where(y == 0, 0.5 / (y == 0).sum(), 0.0)
        if k <= config.own_rounds:
            weight[y == 1] = 0.5 / (y == 1).sum()
        else:
            order = np.lexsort((p[:, 1], seg_row))
            top = order[np.append(seg_row[order][1:] != seg_row[order][:-1], True)]
            weight[top[y[top] == 1]] = 0.5 / len(toxic_rows)
            clean = top[y[top] == 0]
            weight[clean] += 0.5 / max(1, len(clean))
        g = (p - np.stack([1 - y, y], 1)) * weight[:, None]
        g_table = to_word.backward(to_segment.backward(g @ out.T, to_word.n), size)
        grads = [g_table + config.penalty / max(1, size) * table, mean.T @ g, g.sum(0)]
        for x, gx, (a, b) in zip(params, grads, moments):
            a[...] = 0.9 * a + 0.1 * gx
            b[...] = 0.99 * b + 0.01 * gx * gx
            x -= config.rate * (1 - (k - 1) / config.rounds) * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-7)
        if k >= config.own_rounds and k % config.check == 0:
            yield ToxicityModel(kept, table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def _frequent(keys, owner, word, row, n_words: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with at least ``least`` pairs of word and row, and the entries that use them, renumbered; ``row`` rises."""
    rows_of_word = np.zeros(n_words, np.int32)
    for some in _groups(_changes(row), len(row))[1]:
        pair = np.unique(word[some].astype(np.int64) << 32 | row[some])
        np.add.at(rows_of_word, pair >> 32, 1)
    counts = np.zeros(int(keys.max(initial=-1)) + 1, np.int32)
    for at in range(0, len(keys), STEP):
        np.add.at(counts, keys[at:at + STEP], rows_of_word[owner[at:at + STEP]])
    enough = counts >= least
    del counts
    stay = enough[keys]
    kept = np.flatnonzero(enough).astype(np.int32)
    return kept, np.searchsorted(kept, keys[stay]).astype(np.int32), owner[stay]


def held_out(id_column: Column) -> Column:
    """Ids whose labels are never learned: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel | None:
    """Model of column ``toxic`` of ``labels`` from rows that are not held out, bounded by ``rows`` and ``text_bytes``."""
    sample = labelled_sample(documents, labels, "toxic", config.rows, config.text_bytes, where=~held_out(F.col("id")), long_bytes=config.row_bytes)
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).agg(F.avg("toxic").alias("share")).first()["share"]
    prior = min(0.99, max(0.01, known if known is not None else 0.5))
    return fit_model(sample["text"].tolist(), sample["label"].to_numpy(), config, prior)


def probabilities(texts: pa.Array, model: ToxicityModel | None, config: ToxicityConfig) -> np.ndarray:
    return np.zeros(len(texts)) if model is None else model.score(texts, config)


def score(
    documents: DataFrame, model: ToxicityModel | None, config: ToxicityConfig = ToxicityConfig(),
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: id, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                p = probabilities(part.column("text"), model, config)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p), pa.array((p >= config.threshold).astype(np.int32))], ["id", "score", "predicted"])

    rows = keyed(documents, id_column, text_column)
    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_column)


def drop_toxic(documents: DataFrame, model: ToxicityModel | None, config: ToxicityConfig = ToxicityConfig(), text_column: str = "text") -> DataFrame:
    """Documents below the threshold, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_column, SLICE):
                yield part.filter(pa.array(probabilities(part.column(text_column).cast(pa.string()), model, config) < config.threshold))

    return in_arrow(documents, run, documents.schema)
