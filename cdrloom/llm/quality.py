"""Quality rules: base rules on words, then a hashed n-gram logistic regression with fixed thresholds.

Features are the shares of hashed words and hashed character n-grams (case and
punctuation count). A logistic regression on them is fitted on a bounded sample
of labelled rows; its margins are calibrated to probabilities on a part of the
sample that the fit has not seen (Platt scaling). Documents are scored in Arrow
batches.

Defined cases: a null or empty text has no words and fails the base rules;
repeated rows get equal results; without labelled rows of both classes there is
no model and the base rules decide alone; labelled rows of both classes of which
none of one class fits the sample are an error; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .flat import flat_bytes, in_arrow, keyed, mix, prefix_hash, span_hash, text_slices, word_spans
from .sample import held_back, labelled_sample

#: Text bytes whose features are counted at a time in the driver, and entries that are summed at a time there.
FIT_SLICE = 1 << 17
STEP = 1 << 16

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class QualityConfig:
    """Production parameters."""

    bits: int = 16  # hashed features: 2**bits
    grams: tuple[int, ...] = (3,)  # bytes of a character n-gram
    rows: int = 1000  # labelled rows per class in the sample, at most
    text_bytes: int = 4 << 20  # their text per class, at most
    rounds: int = 100  # steps of the fit
    penalty: float = 1e-4
    min_words: int = 50
    max_repeat_percent: int = 50
    threshold: float = 0.5  # least probability of good quality


def features(data: np.ndarray, offsets: np.ndarray, config: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all rows in one array, and the row of each."""
    prefix = prefix_hash(data)
    starts, ends, _ = word_spans(data, offsets)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keys, rows = [span_hash(prefix, starts, ends)], [row_of[starts]]
    for size in config.grams:
        begin = np.arange(max(0, len(data) - size + 1))
        begin = begin[row_of[begin] == row_of[begin + size - 1]]
        keys.append(span_hash(prefix, begin, begin + size) ^ np.uint64(size))
        rows.append(row_of[begin])
    return (np.concatenate(keys) >> np.uint64(64 - config.bits)).astype(np.int64), np.concatenate(rows)


def margins(texts: pa.Array, weights: np.ndarray, bias: float, config: QualityConfig) -> np.ndarray:
    """Margin of each text: the mean weight of its features, plus the bias."""
    keys, rows = features(*flat_bytes(texts), config)
    n = len(texts)
    total = np.bincount(rows, weights=weights[keys], minlength=n)
    return total / np.maximum(1, np.bincount(rows, minlength=n)) + bias


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, texts: pa.Array, config: QualityConfig) -> np.ndarray:
        return sigmoid(self.slope * margins(texts, self.weights, self.bias, config) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_model(texts: list[str], labels: np.ndarray, config: QualityConfig) -> QualityModel | None:
    """Fit on four fifths of the sample, calibrate on the rest; None without both classes."""
    labels = np.asarray(labels, np.float64)
    held = held_back(labels)
    if min((labels[~held] == 0).sum(), (labels[~held] == 1).sum()) == 0:
        return None
    size = 1 << config.bits
    column, row, share = [], [], []
    at = 0
    for part in text_slices(pa.record_batch([pa.array(texts, pa.string())], ["text"]), "text", FIT_SLICE):
        keys, rows = features(*flat_bytes(part.column("text")), config)
        pairs, counts = np.unique(rows << config.bits | keys, return_counts=True)
        r = pairs >> config.bits
        total = np.bincount(rows, minlength=part.num_rows)
        column.append((pairs & (size - 1)).astype(np.int32))
        row.append((at + r).astype(np.int32))
        share.append((counts / total[r]).astype(np.float32))
        at += part.num_rows
    column, row, share = np.concatenate(column), np.concatenate(row), np.concatenate(share)
    # shares are small: each feature is scaled by the root of its mean share, weights are scaled back below
    scale = 1 / np.sqrt(np.bincount(column, weights=share, minlength=size) / len(labels) + 1e-7)
    value = share * scale[column]
    weight = np.where(labels == 1, 0.5 / labels[~held].sum(), 0.5 / (1 - labels[~held]).sum()) * ~held
    w, b = np.zeros(size), 0.0
    first, second, steps = np.zeros(size + 1), np.zeros(size + 1), 0.05
    for k in range(1, config.rounds + 1):
        z = _weighted(row, value, w, column, len(labels)) + b
        g = (sigmoid(z) - labels) * weight
        grad = np.append(_weighted(column, value, g, row, size) + config.penalty * w, g.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        move = steps * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    z = _weighted(row, value, w, column, len(labels)) + b
    slope, shift = platt(z[held], labels[held])
    return QualityModel(w * scale, float(b), slope, shift)


def _weighted(into: np.ndarray, value: np.ndarray, table: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``value * table[of]`` by ``into``, added one after the other, without a product as long as the sample."""
    out = np.zeros(n)
    for at in range(0, len(into), STEP):
        some = slice(at, at + STEP)
        np.add.at(out, into[some], value[some] * table[of[some]])
    return out


def platt(z: np.ndarray, y: np.ndarray, prior: float = 0.5) -> tuple[float, float]:
    """Slope and shift of calibrated probabilities, with smoothed targets; ``prior`` is the share of class 1 they are meant for."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    weight = np.where(y == 1, prior / good, (1 - prior) / bad)
    a, c = 1.0, 0.0
    for _ in range(50):  # Newton steps on two parameters
        p = sigmoid(a * z + c)
        g = np.array([(weight * (p - target) * z).sum() + 1e-3 * (a - 1), (weight * (p - target)).sum()])
        d = weight * p * (1 - p)
        h = np.array([[(d * z * z).sum() + 1e-3, (d * z).sum()], [(d * z).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, c = a - np.clip(step[0], -2, 2), c - np.clip(step[1], -2, 2)
    return float(a), float(c)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of the base rules, one value per row."""
    data, offsets = flat_bytes(texts)
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    row_of_word = np.repeat(np.arange(n), np.diff(first))
    prefix = prefix_hash(data)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    words = np.diff(first)
    chars = np.bincount(row_of_word, weights=points[ends] - points[starts], minlength=n).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    # lines: they end at a newline or at the end of the row
    breaks = np.flatnonzero(data == 10)
    line_starts = np.concatenate([offsets[:-1], breaks + 1])
    line_rows = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((line_starts, line_rows))
    line_starts, line_rows = line_starts[order], line_rows[order]
    line_ends = offsets[line_rows + 1].copy()
    inner = np.flatnonzero(line_rows[:-1] == line_rows[1:])
    line_ends[inner] = line_starts[inner + 1] - 1
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_rows = line_starts[with_word], line_ends[with_word], line_rows[with_word]
    dup_lines = np.bincount(line_rows[_again(span_hash(prefix, line_starts, line_ends), line_rows, keep_first=True)], minlength=n)
    # words in 3-word windows that stand twice or more in the row
    hashes = span_hash(prefix, starts, ends)
    window = np.arange(max(0, len(hashes) - 2))
    window = window[row_of_word[window] == row_of_word[window + 2]]
    three = mix(hashes[window]) + mix(hashes[window + 1] ^ np.uint64(0x51)) * np.uint64(3) + mix(hashes[window + 2] ^ np.uint64(0xA7)) * np.uint64(5)
    twice = window[_again(three, row_of_word[window], keep_first=False)]
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[twice + k] = True
    repeats = np.bincount(row_of_word[covered], minlength=n)
    return {
        "n_words": words, "word_chars": chars, "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": dup_lines, "n_repeat_words": repeats,
    }


def _again(hashes: np.ndarray, rows: np.ndarray, keep_first: bool) -> np.ndarray:
    """Flags of values that stand elsewhere in their row (``keep_first``: earlier in their row)."""
    key = hashes ^ mix(rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    flags = np.zeros(len(key), bool)
    flags[order[1:][same]] = True
    if not keep_first:
        flags[order[:-1][same]] = True
    return flags


def fit(documents: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> QualityModel | None:
    """Model of column ``quality`` of ``labels``, from a sample bounded by ``rows`` and ``text_bytes``."""
    sample = labelled_sample(documents, labels, "quality", config.rows, config.text_bytes)
    return fit_model(sample["text"].tolist(), sample["label"].to_numpy(), config)


def judge(texts: pa.Array, model: QualityModel | None, config: QualityConfig) -> dict[str, np.ndarray]:
    """Counts, base verdict, probability and final verdict of each text."""
    out = base_counts(texts)
    out["base_failed"] = (out["n_words"] < config.min_words) | (100 * out["n_repeat_words"] > config.max_repeat_percent * out["n_words"])
    out["probability"] = np.ones(len(texts)) if model is None else model.probability(texts, config)
    out["kept"] = ~out["base_failed"] & (out["probability"] >= config.threshold)
    return out


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def score(
    documents: DataFrame, model: QualityModel | None, config: QualityConfig = QualityConfig(),
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: id, the counts, ``base_failed``, ``kept`` and ``probability`` of good quality."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = judge(part.column("text"), model, config)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(found[c]) for c in names)], ["id", *names])

    rows = keyed(documents, id_column, text_column)
    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_column)


def keep_good(documents: DataFrame, model: QualityModel | None, config: QualityConfig = QualityConfig(), text_column: str = "text") -> DataFrame:
    """Documents that are kept, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_column):
                yield part.filter(pa.array(judge(part.column(text_column).cast(pa.string()), model, config)["kept"]))

    return in_arrow(documents, run, documents.schema)
