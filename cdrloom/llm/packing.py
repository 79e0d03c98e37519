"""Packing by power-of-two decomposition.

A document of n tokens (its ids, then an end id) is cut into pieces whose
lengths are powers of two: as many of the full length as fit, then the binary
digits of the rest, longest first. Pieces of equal length share a bucket and
each piece is a sequence of its own, so no sequence crosses documents and none
needs padding.

Defined cases: a null or empty text is one piece that holds the end id;
repeated rows (also of one id) are packed row by row under sequence ids of
their own; extra columns are dropped before the work; an empty table gives an
empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import SLICE, vocabulary
from .flat import in_arrow, keyed, ragged, text_slices

#: Rows that one task may number; sequence ids are task * 2**TASK_BITS + row.
TASK_BITS = 38
COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def binary_pieces(tokens: np.ndarray, full: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and length of the pieces of documents with these token counts, in order."""
    if full < 1 or full & (full - 1):
        raise ValueError("the sequence length has to be a power of two")
    bits = full.bit_length() - 1
    whole, rest = tokens // full, tokens % full
    sizes = full >> 1 >> np.arange(bits)
    has = (rest[:, None] & sizes[None, :]) > 0
    counts = whole + has.sum(1)
    owner = np.repeat(np.arange(len(tokens)), counts)
    number = ragged(np.zeros(len(tokens), np.int64), counts)
    length = np.full(len(owner), full, np.int64)
    length[number >= whole[owner]] = np.broadcast_to(sizes, has.shape)[has]
    total = np.concatenate([[0], np.cumsum(length)])
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return owner, total[:-1] - total[first][owner], length


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to each row."""
    counts = np.diff(offsets)
    cuts = offsets + np.arange(len(offsets))
    out = np.full(len(ids) + len(counts), end, np.uint32)
    out[ragged(cuts[:-1], counts)] = ids
    return out, cuts


def pack(
    df: DataFrame, path: str, length: int = 1024, end: int = 0, id_column: str = "doc_id", text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length).

    ``with_ids`` adds the token ids of the piece. No shuffle is needed: numbers
    of sequences are unique by task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        number = TaskContext.get().partitionId() << TASK_BITS
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                ids, offsets = with_end(*words.encode(part.column("text")), end)
                tokens = np.diff(offsets)
                owner, start, size = binary_pieces(tokens, length)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = 4 * (offsets[owner] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * size).tolist())]
                columns = [
                    part.column("id").take(pa.array(owner)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()),
                    pa.array(tokens[owner]), pa.array(number + np.arange(len(owner))),
                    pa.array(np.zeros(len(owner), np.int64)), pa.array(np.log2(size).astype(np.int32)),
                ]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
                if with_ids:
                    cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                number += len(owner)
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = keyed(df, id_column, text_column)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {COLUMNS}" + ", ids array<int>" * with_ids
    return in_arrow(rows, run, schema).withColumnRenamed("id", id_column)
