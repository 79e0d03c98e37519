"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample of unit vectors and sent to all tasks
(its size is bounded by the sample). Every vector of the table is assigned to a
leaf. A query walks the tree best bin first: a priority queue of nodes, nearest
centre first. How many leaves a query visits is calibrated: on sample queries
with known neighbours the visits are widened until the wanted recall is
reached. Leaves are cut into blocks of bounded size, queries meet the blocks of
their leaves, and each block returns its best few per query.

Copies of one vector are reduced to the k + 1 smallest ids before the search:
more of them can never be in a result, as ties go to the smaller id.

Defined cases: vectors that are null, zero, hold null or non-finite components,
or have another length than most take no part, nor do rows without id; with
fewer than k candidates all are returned; a query leaves out rows of its own
id; extra columns are dropped before the work.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .flat import in_arrow, shuffle_tasks


@dataclass(frozen=True)
class TreeConfig:
    """Production parameters."""

    k: int = 5
    sample: int = 16_384  # rows that fit the tree, at most
    branching: int = 8
    leaf: int = 64  # sample rows of a leaf, at most
    rounds: int = 8  # k-means steps per node
    queries: int = 256  # sample queries of the calibration
    recall: float = 0.98  # wanted on them
    block: int = 4096  # vectors of a block
    seed: int = 11


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays: centres, first child and number of children (0: a leaf), leaf number."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray
    leaves: int

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector: the nearest child at every node."""
        node = np.zeros(len(vectors), np.int64)
        while True:
            inner = np.flatnonzero(self.count[node] > 0)
            if not len(inner):
                return self.leaf[node]
            for n in np.unique(node[inner]):
                own = inner[node[inner] == n]
                begin, size = self.first[n], self.count[n]
                node[own] = begin + np.argmax(vectors[own] @ self.centres[begin:begin + size].T, 1)

    def visit(self, vector: np.ndarray, visits: int, sizes: np.ndarray, least: int) -> list[int]:
        """Leaves in best-bin-first order, until ``visits`` of them with ``least`` candidates are found."""
        queue, out, found = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or found < least):
            _, node = heapq.heappop(queue)
            if self.count[node] == 0:
                out.append(int(self.leaf[node]))
                found += int(sizes[self.leaf[node]])
                continue
            begin = self.first[node]
            near = self.centres[begin:begin + self.count[node]] @ vector
            for j, x in enumerate(near.tolist()):
                heapq.heappush(queue, (-x, int(begin) + j))
        return out


def _split(vectors: np.ndarray, branching: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means: the group of each vector."""
    centres = vectors[rng.choice(len(vectors), branching, replace=False)]
    group = np.zeros(len(vectors), np.int64)
    for _ in range(rounds):
        group = np.argmax(vectors @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, group, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return group


def fit_tree(vectors: np.ndarray, config: TreeConfig) -> Tree:
    """Hierarchical k-means over unit vectors."""
    rng = np.random.default_rng(config.seed)
    dims = vectors.shape[1]
    centres, first, count, leaf, leaves = [np.zeros(dims)], [0], [0], [-1], 0
    todo = [(0, np.arange(len(vectors)))]
    for node, rows in todo:
        groups = np.zeros(0, np.int64)
        if len(rows) > config.leaf:
            groups = _split(vectors[rows], config.branching, config.rounds, rng)
        parts = [rows[groups == g] for g in range(config.branching) if (groups == g).any()] if len(groups) else []
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        first[node], count[node] = len(centres), len(parts)
        for part in parts:
            mean = vectors[part].sum(0)
            norm = np.linalg.norm(mean)
            todo.append((len(centres), part))
            centres.append(mean / norm if norm > 0 else vectors[part[0]])
            first.append(0)
            count.append(0)
            leaf.append(-1)
    return Tree(np.array(centres), np.array(first), np.array(count), np.array(leaf), leaves)


def calibrate(tree: Tree, vectors: np.ndarray, config: TreeConfig) -> int:
    """Leaves a query has to visit until the wanted share of its k nearest is found, on sample queries."""
    n = len(vectors)
    if n <= config.k or tree.leaves == 1:
        return tree.leaves
    leaf_of = tree.assign(vectors)
    rng = np.random.default_rng(config.seed + 1)
    chosen = rng.choice(n, min(n, config.queries), replace=False)
    ones = np.ones(tree.leaves, np.int64)
    needed = []
    for q in chosen:
        near = vectors @ vectors[q]
        near[q] = -np.inf
        best = np.argpartition(-near, config.k)[:config.k]
        place = {leaf: k + 1 for k, leaf in enumerate(tree.visit(vectors[q], tree.leaves, ones, 0))}
        needed += [place[x] for x in leaf_of[best].tolist()]
    return int(np.quantile(np.array(needed), config.recall, method="higher"))


def usable(vector: Column) -> Column:
    """True for vectors that take part in a search."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)  # no overflow or underflow in squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(queries: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, v_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query place, id and cosine of the k best of a block per query; ties go to smaller ids."""
    q_norm, v_norm = np.sqrt((queries * queries).sum(1)), np.sqrt((vectors * vectors).sum(1))
    near = (queries / q_norm[:, None]) @ (vectors / v_norm[:, None]).T
    near[q_ids[:, None] == v_ids[None, :]] = -np.inf
    floor = np.partition(near, max(0, near.shape[1] - k), 1)[:, max(0, near.shape[1] - k)] - 1e-9
    row, col = np.nonzero((near >= floor[:, None]) & (near > -np.inf))
    # the cosine itself, summed in one order wherever the pair stands
    exact = (queries[row] * vectors[col]).sum(1) / (q_norm[row] * v_norm[col])
    order = np.lexsort((v_ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], v_ids[col[rank < k]], exact[rank < k]


def search(vectors: DataFrame, queries: Column, config: TreeConfig = TreeConfig(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """k nearest rows of each row for which ``queries`` (a condition on column ``id``) holds.

    query_id, rank (from 1), vec_id, score (cosine in double precision).
    """
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return rows.sparkSession.createDataFrame([], schema)
    dims, k = common["dims"], config.k
    rows = rows.where(F.size("v") == dims)
    copies = Window.partitionBy("v").orderBy("id")
    # ids, not rows, fill the k + 1 places of a vector
    candidates = rows.withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= k + 1).drop("copy").dropDuplicates(["id", "v"])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(config.sample).select("v").toPandas()
    unit = _unit(np.stack(sample["v"].to_numpy()).astype(np.float64))
    tree = fit_tree(unit, config)
    visits = calibrate(tree, unit, config)

    def to_leaf(batches):
        for batch in batches:
            leaf = tree.assign(_unit(_matrix(batch.column("v"), dims))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(leaf.astype(np.int32))], ["id", "v", "leaf"])

    kind = rows.schema["v"].dataType.simpleString()
    placed = in_arrow(candidates, to_leaf, f"id long, v {kind}, leaf int")
    # one row per leaf: bounded by the sample
    sizes = np.zeros(tree.leaves, np.int64)
    for leaf, n in placed.groupBy("leaf").count().toPandas().itertuples(index=False):
        sizes[leaf] = n
    blocks = np.maximum(1, -(-sizes // config.block))

    def to_visits(batches):
        for batch in batches:
            unit = _unit(_matrix(batch.column("v"), dims)) if batch.num_rows else np.zeros((0, dims))
            seen = [tree.visit(u, visits, sizes, k + 1) for u in unit]
            leaf = np.array([x for s in seen for x in s], np.int64)
            row = np.repeat(np.arange(len(seen)), [len(s) for s in seen])
            part = np.concatenate([np.zeros(0, np.int64), *(np.arange(b) for b in blocks[leaf])])
            leaf, row = np.repeat(leaf, blocks[leaf]), np.repeat(row, blocks[leaf])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(leaf.astype(np.int32)), pa.array(part.astype(np.int32))],
                ["id", "v", "leaf", "part"],
            )

    asked = in_arrow(rows.where(queries).distinct(), to_visits, f"id long, v {kind}, leaf int, part int")
    n_parts = F.element_at(F.array(*(F.lit(int(b)) for b in blocks)), F.col("leaf") + 1)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), n_parts).cast("int"))

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        """Best candidates (right) of the queries (left) of one block, some queries at a time."""
        out = []
        if left.num_rows and right.num_rows:
            v, v_ids = _matrix(right.column("v"), dims), right.column("id").to_numpy()
            for at in range(0, left.num_rows, 512):
                some = left.slice(at, 512)
                q_ids = some.column("id").to_numpy()
                row, ids, score = _best(_matrix(some.column("v"), dims), q_ids, v, v_ids, k)
                out.append(pa.table({"query_id": q_ids[row], "vec_id": ids, "score": score}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    n = shuffle_tasks(rows)
    found = asked.repartition(n, "leaf", "part").groupBy("leaf", "part").cogroup(placed.repartition(n, "leaf", "part").groupBy("leaf", "part"))
    found = found.applyInArrow(match, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: pd.DataFrame, truth: pd.DataFrame) -> float:
    """Share of the true neighbours that were found."""
    pairs = set(zip(truth["query_id"], truth["vec_id"]))
    return len(pairs & set(zip(found["query_id"], found["vec_id"]))) / max(1, len(pairs))
