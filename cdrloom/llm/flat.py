"""Arrow text columns as flat numpy arrays, and helpers for ragged pieces of them.

The operators of this subpackage read text inside ``mapInArrow`` tasks. A batch
is cut into slices of a bounded number of bytes, so memory follows the slice
(or one document, if that is longer), never the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

SLICE_BYTES = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that end a word: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of ``batch`` with at most ``limit`` text bytes, one row at least."""
    sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
    start = 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    texts = pa.concat_arrays([texts])  # a slice gets buffers of its own
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] values), then the same for the next ones."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.asarray(starts, np.int64) - np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.repeat(shift, lengths) + np.arange(total)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (a bijection)."""
    h = np.asarray(h, np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n + 1 powers of the multiplier and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        size = max(n + 1, SLICE_BYTES + 2)
        up, down = np.full(size, MULTIPLIER, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[0] = np.cumprod(up, out=up), np.cumprod(down, out=down)
    return _POWERS[0]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of integer values, for ``span_hash``."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal spans have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and the first word of each row (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows, their n + 1 row offsets and their byte starts."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    if len(first) != len(points):
        raise ValueError("text is not UTF-8")
    return points, np.searchsorted(first, offsets), np.append(first, len(data))


def split_planes(values: np.ndarray) -> bytes:
    """Little-endian bytes of unsigned integers, plane by plane (high planes compress well)."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def join_planes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow``; a name of its own so that plans are easy to search."""
    return df.mapInArrow(fn, schema)


def keyed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only id and text, under fixed names that extra columns cannot clash with."""
    return df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))


def text_key(text: Column) -> Column:
    """Content key of a text (null: empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of consecutive rows with equal keys, also across batches; holds one group at a time."""
    current, held = None, []
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        begin = 0
        for at in [k for k in range(1, len(values)) if values[k] != values[k - 1]] + [len(values)]:
            if at == begin:
                continue
            if current is not None and values[begin] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = values[begin]
            held.append(batch.slice(begin, at - begin))
            begin = at
    if held:
        yield current, pa.Table.from_batches(held)



def with_keys(df: DataFrame, text_column: str = "text") -> DataFrame:
    """key (content digest) and text of each row; a null text is empty."""
    rows = df.select(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    return rows.select(text_key(F.col("text")).alias("key"), "text")


def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose ``key`` the task has not met before, so copies of one text leave a task once."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for key in batch.column("key").to_pylist():
            keep.append(key not in seen)
            seen.add(key)
        yield batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))
