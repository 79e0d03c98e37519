"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of hashed word n-grams. Documents with equal sets form a
class; one member stands for it. Classes meet in MinHash bands; within a band
bucket the MinHash values of two classes are compared some at a time, and a
pair is dropped once the posterior probability that its similarity reaches the
threshold falls below the tolerance. What is left links classes to candidate
groups. Within a group every pair is pruned the same way and the rest is
verified exactly on the n-gram sets.

Results are per document: its group and its number of links. Pairs are counted
inside tasks and never written out, so a group of many near copies costs rows
in proportion to its size. Buckets and groups of any size are cut into blocks
of bounded size which meet pairwise; no bucket, partner or candidate is capped.

With 30 bands of four values a pair at the threshold of 0.8 meets in no band
with a probability of 1.3e-7, and pruning drops it with less than the tolerance
per step; more similar pairs are lost less often still.

Defined cases: a document of fewer words than an n-gram has is one n-gram of
all its words; documents without words (null, empty) have no links and form
groups of their own; repeated rows are copies of each other; null ids are
allowed; extra columns are dropped before the work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .components import connected, roots
from .flat import (
    flat_bytes, in_arrow, mix, prefix_hash, ragged, runs, shuffle_tasks, span_hash, text_key, text_slices, unseen, with_keys,
    word_spans,
)


@dataclass(frozen=True)
class JoinConfig:
    """Production parameters."""

    words: int = 5
    threshold: float = 0.8
    hashes: int = 120
    band: int = 4
    step: int = 8  # MinHash values compared between two prunings
    tolerance: float = 1e-9
    block: int = 512  # classes of a block
    block_grams: int = 1_000_000  # n-grams of a block
    seed: int = 5


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word n-grams of each text, ascending, and their n + 1 offsets."""
    data, offsets = flat_bytes(texts)
    starts, ends, first = word_spans(data, offsets)
    n = len(offsets) - 1
    word = mix(span_hash(prefix_hash(data), starts, ends))
    counts = np.diff(first)
    windows = np.where(counts >= words, counts - words + 1, 0)
    begin = ragged(first[:-1], windows)
    key = np.zeros(len(begin), np.uint64)
    for k in range(words):
        key = mix(key + word[begin + k])
    row = np.repeat(np.arange(n), windows)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = counts[short] > k
            own[has] = mix(own[has] + word[first[short[has]] + k])
        key, row = np.concatenate([key, mix(own + np.uint64(1))]), np.concatenate([row, short])
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[fresh], np.searchsorted(row[fresh], np.arange(n + 1))


@lru_cache(4)
def _factors(hashes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(grams: np.ndarray, offsets: np.ndarray, config: JoinConfig) -> np.ndarray:
    """MinHash values (32 bits) of each non-empty set, rows x hashes."""
    out = np.empty((len(offsets) - 1, config.hashes), np.uint32)
    for k, factor in enumerate(_factors(config.hashes, config.seed)):
        out[:, k] = np.minimum.reduceat((grams * factor) >> np.uint64(32), offsets[:-1]) if len(grams) else 0
    return out


@lru_cache(16)
def least_matches(hashes: int, step: int, threshold: float, tolerance: float) -> tuple[int, ...]:
    """Matches a pair needs after step, 2 * step, ... values to stay in.

    With a uniform prior, m matches among n values leave the posterior
    Beta(m + 1, n - m + 1); its mass above the threshold t equals the
    probability of at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(step, hashes + 1, step):
        mass, m = 0.0, 0
        while True:
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def surviving_pairs(left: np.ndarray, right: np.ndarray | None, config: JoinConfig) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two MinHash tables (None: pairs within the first) that pruning leaves."""
    other = left if right is None else right
    a, b = [], []
    needs = least_matches(config.hashes, config.step, config.threshold, config.tolerance)
    for begin in range(0, len(left), 256):
        part = left[begin:begin + 256]
        matches = np.zeros((len(part), len(other)), np.int16)
        for k in range(config.step):
            matches += part[:, k, None] == other[None, :, k]
        i, j = np.nonzero(matches >= needs[0])
        if right is None:
            i, j = i[j > i + begin], j[j > i + begin]
        count = matches[i, j].astype(np.int64)
        for r, need in enumerate(needs[1:], 1):
            at = slice(r * config.step, (r + 1) * config.step)
            count += (part[i, at] == other[j, at]).sum(1)
            stay = count >= need
            i, j, count = i[stay], j[stay], count[stay]
        a.append(i + begin)
        b.append(j)
    return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])


def exact_links(a: np.ndarray, b: np.ndarray, grams: np.ndarray, offsets: np.ndarray, threshold: float) -> np.ndarray:
    """Flags of the pairs whose exact Jaccard similarity reaches the threshold."""
    if not len(a):
        return np.zeros(0, bool)
    sizes = np.diff(offsets)
    _, ids = np.unique(grams, return_inverse=True)
    order = np.argsort(a, kind="stable")
    out = np.zeros(len(a), bool)
    marks = np.zeros(int(ids.max()) + 1, bool)
    cuts = np.flatnonzero(np.diff(a[order], prepend=-1))
    for begin, end in zip(cuts, np.append(cuts[1:], len(a))):
        pairs = order[begin:end]
        own = ids[offsets[a[pairs[0]]]:offsets[a[pairs[0]] + 1]]
        marks[own] = True
        partner = b[pairs]
        hits = marks[ids[ragged(offsets[partner], sizes[partner])]]
        both = np.add.reduceat(hits.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[partner])[:-1]]))
        marks[own] = False
        out[pairs] = both >= threshold * (sizes[a[pairs]] + sizes[partner] - both) - 1e-9
    return out


def _sketches(docs: DataFrame, config: JoinConfig) -> DataFrame:
    """text key, class key, size, MinHash values and band keys of each text, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unseen(batches):
            for part in text_slices(batch, "text"):
                grams, offsets = shingles(part.column("text"), config.words)
                full = np.flatnonzero(np.diff(offsets))
                cuts = np.append(offsets[full], offsets[-1])
                values = minhash(grams, cuts, config)
                raw = grams.tobytes()
                classes = [hashlib.md5(raw[8 * x:8 * y]).digest() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                bands = np.zeros((len(full), config.hashes // config.band), np.uint64)
                for k in range(config.band):
                    bands = mix(bands + values[:, k::config.band].astype(np.uint64) + np.arange(bands.shape[1], dtype=np.uint64) * np.uint64(1 << 33))
                yield pa.RecordBatch.from_arrays([
                    part.column("key").take(pa.array(full)), pa.array(classes, pa.binary()), pa.array(np.diff(cuts)),
                    pa.array([v.tobytes() for v in values.astype(np.uint16)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel().view(np.int64))),
                ], ["key", "c", "n", "values", "bands"])

    return in_arrow(with_keys(docs), run, "key binary, c binary, n long, values binary, bands array<bigint>")


def _in_blocks(rows: DataFrame, group: str, parts: str) -> DataFrame:
    """Each row once for every pair of blocks it takes part in: columns x <= y, and own (its block)."""
    own = F.pmod(F.xxhash64("c"), F.col(parts))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    out = rows.withColumn("own", own).withColumn("other", other)
    out = out.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other", parts)
    return out.repartition(shuffle_tasks(rows), group, "x", "y").sortWithinPartitions(group, "x", "y", "c")


def _two_sides(found: pa.Table, x: int, y: int) -> tuple[pa.Table, np.ndarray]:
    """Rows without repeated classes, and the flag of the first block."""
    keys = found.column("c").to_pylist()
    keep = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
    found = found.take(pa.array(keep))
    return found, found.column("own").to_numpy() == x


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _pairs(values: np.ndarray, first: np.ndarray, x: int, y: int, config: JoinConfig) -> tuple[np.ndarray, np.ndarray]:
    if x == y:
        return surviving_pairs(values, None, config)
    left, right = np.flatnonzero(first), np.flatnonzero(~first)
    a, b = surviving_pairs(values[left], values[right], config)
    return left[a], right[b]


def candidate_groups(sketches: DataFrame, config: JoinConfig) -> DataFrame:
    """node (class key) and root of classes that pruning leaves linked to another."""
    bands = sketches.select("c", F.explode("bands").alias("band"))
    sign = F.xxhash64("c")
    buckets = bands.groupBy("band").agg(F.count("*").alias("size"), F.min(sign).alias("low"), F.max(sign).alias("high"), F.sum(F.shiftright(sign, 32)).alias("sum_high"), F.sum(sign.bitwiseAND(0xFFFFFFFF)).alias("sum_low"))
    # buckets of the same members are worked on once
    chosen = buckets.where("low <> high").groupBy("size", "low", "high", "sum_high", "sum_low").agg(F.min("band").alias("band"))
    members = bands.join(chosen.select("band", "size"), "band").withColumn("parts", F.ceil(F.col("size") / config.block))
    values = sketches.select("c", "values").dropDuplicates(["c"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, x, y), found in runs(batches, ["band", "x", "y"]):
            found, first = _two_sides(found, x, y)
            a, b = _pairs(_matrix(found.column("values"), np.uint16), first, x, y, config)
            root = roots(found.num_rows, a, b)
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                keys = found.column("c").combine_chunks()
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(moved)), keys.take(pa.array(root[moved]))], ["a", "b"])

    blocks = _in_blocks(members.join(values, "c").select("band", "c", "values", "parts"), "band", "parts")
    return connected(in_arrow(blocks, link, "a binary, b binary"))


def _verified(docs: DataFrame, sketches: DataFrame, classes: DataFrame, groups: DataFrame, config: JoinConfig) -> DataFrame:
    """Per class and block pair: linked documents counted, and a linked class of least key (b) as an edge."""
    picked = groups.withColumnRenamed("node", "c").join(classes, "c")
    totals = picked.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("grams"))
    parts = F.greatest(F.ceil(F.col("size") / config.block), F.ceil(F.col("grams") / config.block_grams))
    picked = picked.join(totals, "root").select("key", "c", "root", "members", parts.alias("parts"))
    once = in_arrow(with_keys(docs), unseen, "key binary, text string")
    texts = once.join(picked, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                grams, offsets = shingles(part.column("text"), config.words)
                raw = grams.tobytes()
                sets = [raw[8 * x:8 * y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("root", "c", "members", "parts")), pa.array(sets, pa.binary())], ["root", "c", "members", "parts", "grams"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, x, y), found in runs(batches, ["root", "x", "y"]):
            found, first = _two_sides(found, x, y)
            sets = found.column("grams").to_pylist()
            grams = np.frombuffer(b"".join(sets), np.uint64)
            offsets = np.concatenate([[0], np.cumsum([len(s) // 8 for s in sets])])
            a, b = _pairs(minhash(grams, offsets, config), first, x, y, config)
            linked = exact_links(a, b, grams, offsets, config.threshold)
            a, b = a[linked], b[linked]
            if not len(a):
                continue
            members = found.column("members").to_numpy()
            links = np.bincount(a, weights=members[b], minlength=len(sets)) + np.bincount(b, weights=members[a], minlength=len(sets))
            root, own = roots(len(sets), a, b), np.flatnonzero(links)
            keys = found.column("c").combine_chunks()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(own)), keys.take(pa.array(root[own])), pa.array(links[own].astype(np.int64))], ["a", "b", "links"])

    cut_texts = in_arrow(texts.select("text", "root", "c", "members", "parts"), cut, "root binary, c binary, members long, parts long, grams binary")
    return in_arrow(_in_blocks(cut_texts, "root", "parts"), verify, "a binary, b binary, links long")


def similar_documents(documents: DataFrame, config: JoinConfig = JoinConfig(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, class_id, n_links, copy_id, text_key, group_key.

    ``class_id`` is the least id of the group of documents that links connect,
    ``n_links`` the number of other documents at or above the threshold,
    ``copy_id`` the least id among documents with the same n-gram set. The keys
    are digests of the text and of a text of the group, also where ids are null.
    """
    docs = documents.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    sketches = cut_lineage(_sketches(docs, config))
    keys = docs.select("id", text_key(F.col("text")).alias("key"))
    # written on its own, so that the join below can split the partition of a text with many copies
    class_of_text = cut_lineage(sketches.select("key", "c", "n").dropDuplicates(["key"]))
    rows = cut_lineage(keys.join(class_of_text.select("key", "c"), "key", "left"))
    text_of_class = class_of_text.groupBy("c", "n").agg(F.min("key").alias("key"))
    classes = rows.where("c is not null").groupBy("c").agg(F.count("*").alias("members"), F.min("id").alias("least"))
    classes = cut_lineage(classes.join(text_of_class, "c"))
    groups = candidate_groups(sketches, config)
    found = cut_lineage(_verified(docs, sketches, classes, groups, config))
    links = found.groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    group = connected(found.select("a", "b"))
    of_class = classes.join(links, "c", "left").join(group.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = of_class.groupBy("root").agg(F.min("least").alias("class_id"))
    of_class = of_class.join(least, "root").select("c", "root", "class_id", F.col("least").alias("copy_id"), (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.join(of_class, "c", "left")
    return out.select(
        F.col("id").alias(id_column), F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"), F.col("key").alias("text_key"), F.coalesce("root", "key").alias("group_key"),
    )


def keep_one(documents: DataFrame, config: JoinConfig = JoinConfig(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group, all columns as they were: the one of least id; of repeated rows one stays.

    Documents without words stay unless they are repeated rows. In a group
    without any id the text of least digest stays.
    """
    found = similar_documents(documents, config, id_column, text_column)
    mine = F.col(id_column).eqNullSafe(F.col("class_id"))
    winners = found.where(mine).groupBy("group_key", F.col("class_id").alias("__winner")).agg(F.min("text_key").alias("__key")).drop("group_key")
    rows = documents.withColumn("__key", text_key(F.col(f"`{text_column}`").cast("string"))).withColumn("__id", F.col(f"`{id_column}`"))
    joined = rows.join(winners, "__key").where(F.col("__id").eqNullSafe(F.col("__winner")))
    return joined.dropDuplicates(["__key", "__winner"]).select(*[F.col(f"`{c}`") for c in documents.columns])
