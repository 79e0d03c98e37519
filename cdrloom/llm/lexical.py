"""Ranked lexical search with pair-bound MaxScore.

Documents are cut into shards inside the tasks that read them, so postings are
never shuffled: a shard holds, for each term of the items that occurs in it, the
documents and occurrence counts, as packed columns of one row. Totals and document
frequencies are summed over all shards; then every task searches its shards for
all items and carries its best documents from shard to shard, and a window
function merges the best of all tasks.

In a shard the terms of an item stand in pairs. The intersection list of a pair
(precomputed per shard, shared by all items with that pair) gives the largest
joint impact of a document that holds both terms, per block of documents. With
the maxima of either term alone this bounds what the pair can add, and it is less
than the sum of two independent maxima wherever those are reached by different
documents. At query time pair bounds are combined: pairs are sorted by bound, and
those whose bounds sum up below the kth score so far are not essential. Only
documents in lists of essential pairs are candidates; a candidate is dropped as
soon as its partial score and the block bounds of the pairs that are left stay
below the kth score. Equal sums are kept, as ties go to smaller ids.

All scores are 64-bit integers. Words are compared by a 64-bit hash over all their
bytes; two of n words and m item terms are confused with probability n * m / 2**64.
Items are handled in groups of about ``group`` bytes, each with an index of its
terms, so any number of items works.

Defined cases: null and empty texts have no terms; an item without terms, or whose
terms no document holds, has no rows; rows of one item_id form one item, whose
terms are those of all its rows; each row of the documents is a document, also if
ids repeat; documents without id rank behind equal scores (the id 2**63 - 1 stands
for them inside); an empty table gives an empty result; extra columns are dropped
before the work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import shared_folder
from .flat import flat_bytes, in_arrow, join_planes, prefix_hash, span_hash, split_planes, text_slices

#: Bytes of a term: digits, letters and all of longer code points.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower case of the letters A to Z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

NO_ID = (1 << 63) - 1
#: Shards that give the first thresholds, about.
SEED_SHARDS = 16

INDEX = "shard long, n_docs long, n_terms long, ids binary, sizes binary, terms binary, counts binary, docs binary, tfs binary"


@dataclass(frozen=True)
class SearchConfig:
    """Production parameters."""

    k: int = 50
    shard: int = 8 << 20  # text bytes of a shard
    block: int = 128  # documents of a block
    group: int = 4 << 20  # item bytes that are searched at a time
    # weight of a term: floor(scale * ln((2 N + 2) / (2 df + 1)))
    scale: int = 1000
    # impact: weight * (unit * tf div (1000 * tf + slope * m)), m = 100 - length + length * n * N div L
    unit: int = 1_000_000_000
    slope: int = 20
    length: int = 50


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term of the rows, and the number of terms of each row."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return span_hash(prefix_hash(LOWER[data]), starts, ends), np.diff(np.searchsorted(starts, offsets))


# --- index ----------------------------------------------------------------

class ShardBuilder:
    """Gathers the postings of a task's documents and cuts them into shards."""

    def __init__(self, vocabulary: np.ndarray, part: int):
        self.vocabulary, self.part, self.made = vocabulary, part, 0
        self.clear()

    def clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs = self.bytes = 0

    def add(self, ids: np.ndarray, texts: pa.Array) -> None:
        data, offsets = flat_bytes(texts)
        hashes, sizes = term_hashes(data, offsets)
        place = np.searchsorted(self.vocabulary, hashes)
        place[place == len(self.vocabulary)] = 0
        known = self.vocabulary[place] == hashes
        doc = np.repeat(np.arange(len(sizes)), sizes)[known]
        keys, tfs = np.unique(place[known] * len(sizes) + doc, return_counts=True)
        self.postings.append((keys // len(sizes), keys % len(sizes) + self.docs, tfs))
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.docs += len(sizes)
        self.bytes += len(data)

    def row(self) -> pa.RecordBatch:
        term, doc, tf = (np.concatenate(x) for x in zip(*self.postings))
        order = np.argsort(term, kind="stable")
        terms, counts = np.unique(term, return_counts=True)
        ids, sizes = np.concatenate(self.ids), np.concatenate(self.sizes)
        packed = lambda x, kind=np.uint32: split_planes(np.ascontiguousarray(x, kind))
        values = [
            self.part << 32 | self.made, int((sizes > 0).sum()), int(sizes.sum()), packed(ids.view(np.uint64), np.uint64), packed(sizes),
            packed(terms), packed(counts), packed(doc[order]), packed(tf[order]),
        ]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 6
        self.made += 1
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in INDEX.split(", ")])


def build_index(documents: DataFrame, vocabulary: np.ndarray, config: SearchConfig, id_column: str, text_column: str) -> DataFrame:
    """Shards of all documents with the postings of the vocabulary (sorted term hashes), written and read again."""
    rows = documents.select(
        F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"), F.spark_partition_id().alias("part")
    )

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = None
        for batch in batches:
            for part in text_slices(batch, "text"):
                if builder is None:
                    builder = ShardBuilder(vocabulary, part.column("part")[0].as_py())
                builder.add(part.column("id").to_numpy(), part.column("text"))
                if builder.bytes >= config.shard:
                    yield builder.row()
        if builder is not None and builder.docs:
            yield builder.row()

    folder = shared_folder(documents.sparkSession, "lexical-index")
    in_arrow(rows, shards, INDEX).write.parquet(folder)
    return documents.sparkSession.read.parquet(folder)


def document_frequencies(index: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary, summed inside the tasks first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for present, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                total[join_planes(present, np.uint32)] += join_planes(counts, np.uint32)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["term", "df"])

    found = in_arrow(index.select("terms", "counts"), add, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(terms, np.int64)
    out[found["term"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    return out


# --- search ---------------------------------------------------------------

def term_pairs(item: np.ndarray, weights: np.ndarray) -> list[tuple[int, int]]:
    """Terms of an item two by two, light ones together: long lists with loose independent maxima."""
    order = sorted((int(t) for t in item if weights[t] > 0), key=lambda t: (weights[t], t))
    pairs = [(min(x), max(x)) for x in zip(order[::2], order[1::2])]
    return pairs + ([(order[-1], order[-1])] if len(order) % 2 else [])


class Shard:
    """Postings with impacts, and the bounds of all pairs that the items use."""

    def __init__(self, row: dict[str, bytes], weights: np.ndarray, pairs: list[tuple[int, int]], n_docs: int, n_terms: int, config: SearchConfig):
        ids, sizes = join_planes(row["ids"], np.uint64).view(np.int64), join_planes(row["sizes"], np.uint32).astype(np.int64)
        terms, counts = (join_planes(row[c], np.uint32).astype(np.int64) for c in ("terms", "counts"))
        self.ids, self.block = ids, config.block
        self.docs, tfs = (join_planes(row[c], np.uint32).astype(np.int64) for c in ("docs", "tfs"))
        norm = 100 - config.length + (config.length * sizes * n_docs) // max(1, n_terms)
        rates = (config.unit * tfs) // (1000 * tfs + config.slope * norm[self.docs])
        self.impacts = rates * np.repeat(weights[terms], counts)
        ends = np.cumsum(counts)
        self.spans = dict(zip(terms.tolist(), zip((ends - counts).tolist(), ends.tolist())))
        self.blocks = max(1, -(-len(ids) // config.block))
        self.bounds: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        scratch = np.zeros(len(ids), np.int64)
        for pair in pairs:
            bound = self._pair(pair, scratch)
            if bound is not None:
                self.bounds[pair] = int(bound.max()), bound

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        begin, end = self.spans.get(term, (0, 0))
        return self.docs[begin:end], self.impacts[begin:end]

    def _block_max(self, docs: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.blocks, np.int64)
        if len(docs):
            block = docs // self.block
            first = np.flatnonzero(np.diff(block, prepend=-1))
            out[block[first]] = np.maximum.reduceat(impacts, first)
        return out

    def _pair(self, pair: tuple[int, int], scratch: np.ndarray) -> np.ndarray | None:
        """Most that the two terms together add to a document, per block; None where neither occurs."""
        (docs, impacts), (other_docs, other) = self.postings(pair[0]), self.postings(pair[1])
        if not len(docs) and not len(other_docs):
            return None
        alone = np.maximum(self._block_max(docs, impacts), self._block_max(other_docs, other))
        if pair[0] == pair[1] or not len(docs) or not len(other_docs):
            return alone
        scratch[docs] = impacts
        joint = scratch[other_docs]
        both = joint > 0
        out = np.maximum(alone, self._block_max(other_docs[both], (joint + other)[both]))
        scratch[docs] = 0
        return out

    def search(self, pairs: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents (places) that score ``least`` or more (1 at least), their scores, and the number of candidates."""
        least = max(1, least)
        here = sorted((p for p in pairs if p in self.bounds), key=lambda p: self.bounds[p][0])
        below = np.cumsum([self.bounds[p][0] for p in here])
        light = int(np.searchsorted(below, least, "left"))  # pairs that cannot reach ``least`` even together
        if light == len(here):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        score = np.zeros(len(self.ids), np.int64)
        for pair in here[light:]:
            for term in set(pair):
                docs, impacts = self.postings(term)
                score[docs] += impacts
        rest = sum((self.bounds[p][1] for p in here[:light]), np.zeros(self.blocks, np.int64))
        found = np.flatnonzero(score)
        seen = len(found)
        found = found[score[found] + rest[found // self.block] >= least]
        for pair in reversed(here[:light]):
            if not len(found):
                break
            rest = rest - self.bounds[pair][1]
            for term in set(pair):
                docs, impacts = self.postings(term)
                if len(docs):
                    at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                    score[found] += np.where(docs[at] == found, impacts[at], 0)
            found = found[score[found] + rest[found // self.block] >= least]
        return found, score[found], seen


class Best:
    """The best k documents of each item that a task has met."""

    def __init__(self, thresholds: np.ndarray, k: int):
        self.thresholds, self.k = thresholds.copy(), k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in thresholds]

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(ids):
            return
        ids, scores = np.concatenate([self.found[item][0], ids]), np.concatenate([self.found[item][1], scores])
        order = np.lexsort((ids, -scores))[:self.k]
        self.found[item] = ids[order], scores[order]
        if len(order) == self.k:
            self.thresholds[item] = max(self.thresholds[item], scores[order[-1]])


def _search_index(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, thresholds: np.ndarray, n_docs: int, n_terms: int, config: SearchConfig) -> DataFrame:
    """item (place), doc_id, score: the best k of each item in each task."""
    paired = [term_pairs(item, weights) for item in items]
    pairs = sorted({p for item in paired for p in item})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(thresholds, config.k)
        for batch in batches:
            for row in range(batch.num_rows):
                packed = {c: batch.column(c)[row].as_py() for c in ("ids", "sizes", "terms", "counts", "docs", "tfs")}
                shard = Shard(packed, weights, pairs, n_docs, n_terms, config)
                for item, own in enumerate(paired):
                    found, scores, _ = shard.search(own, int(best.thresholds[item]))
                    best.add(item, shard.ids[found], scores)
        counts = [len(ids) for ids, _ in best.found]
        ids, scores = (np.concatenate(x) for x in zip(*best.found))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64()), pa.array(ids), pa.array(scores)], ["item", "doc_id", "score"])

    return in_arrow(index.select("ids", "sizes", "terms", "counts", "docs", "tfs"), look, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _first_thresholds(index: DataFrame, shards: int, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, config: SearchConfig) -> np.ndarray:
    """A score that the kth best document of each item has at least: the kth best of some shards."""
    none = np.zeros(len(items), np.int64)
    if shards <= 4 * SEED_SHARDS:
        return none
    some = index.where(F.pmod(F.xxhash64("shard"), F.lit(shards // SEED_SHARDS)) == 0)
    ranked = _ranked(_search_index(some, items, weights, none, n_docs, n_terms, config), config.k)
    for row in ranked.where(F.col("rank") == config.k).collect():  # one row per item of the group
        none[row["item"]] = row["score"]
    return none


def rank(documents: DataFrame, items: DataFrame, config: SearchConfig = SearchConfig(), id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", query_column: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score."""
    spark = documents.sparkSession
    asked = items.select(F.col(f"`{item_column}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{query_column}`").cast("string"), F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = max(1, -(-size // config.group))
    asked = asked.groupBy("item_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("text"))).alias("text"))
    out = []
    for group in range(groups):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).orderBy("item_id").toPandas()
        hashes, sizes = term_hashes(*flat_bytes(pa.array(own["text"], pa.string())))
        if not len(hashes):
            continue
        vocabulary, places = np.unique(hashes, return_inverse=True)
        terms = [np.unique(x) for x in np.split(places, np.cumsum(sizes)[:-1])]
        index = build_index(documents, vocabulary, config, id_column, text_column)
        total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l"), F.count("*").alias("shards")).first()
        if not total["n"]:
            continue
        frequency = document_frequencies(index, len(vocabulary))
        weights = np.array([math.floor(config.scale * math.log((2 * total["n"] + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
        known = [x[frequency[x] > 0] for x in terms]
        thresholds = _first_thresholds(index, total["shards"], known, weights, total["n"], total["l"], config)
        found = _ranked(_search_index(index, known, weights, thresholds, total["n"], total["l"], config), config.k)
        names = F.array(*[F.lit(None if x != x else int(x)).cast("long") for x in own["item_id"]])
        out.append(found.select(F.get(names, F.col("item").cast("int")).alias("item_id"), "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
