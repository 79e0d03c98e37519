"""Hard-negative mining with STR-packed R-trees over integer vectors.

Sort-tile-recursion begins on the cluster: rows are range-partitioned by label,
first coordinate and id (so neither a hot label nor a hot vector fills a task)
and cut into blocks of a bounded number of rows. Inside a block rows are sorted
by the widest coordinate and cut into slabs, slabs by the next coordinate, until
a slab fills a leaf; runs of ``fan`` neighbouring boxes make the next level. A
minimum bounding box gives an interval for every product of one coordinate, so
the sum of those intervals bounds the inner products of all rows below it. Boxes
hold an interval of labels too.

An anchor searches a block best first: a priority queue holds boxes by their
upper bound. A box is dropped if its interval lies outside all score windows of
the anchor, or if its upper bound lies strictly below the kth score found in
every window it still meets (equal bounds stay, as ties go to smaller ids).

Two searches run: first the positives (rows of the anchor's label, one window
without limits), then the negatives (rows of other labels, one window per
positive). Neighbouring blocks share a directory node (at most ``NODES`` of them,
which every task gets); anchors leave out the nodes whose box rules them out and
travel, many in a row, to the blocks of the nodes that are left. Anchors meet a
block in chunks of a bounded number. Each block returns its best few per anchor
and window, and a window function merges them.

Scores are exact: products are summed in double precision while all partial sums
stay below 2**53, and in 64-bit integers beyond.

Defined cases: rows with a null id, null label, null vector, or any null or
non-finite component take no part, nor do vectors of another length than most
(the longer, if two lengths are equally common), nor those whose scaled vector
has a squared length of 2**61 or more, as their products need not fit 64 bits;
repeated rows (same id, label and vector) count once; rows of the anchor's own id
are no candidates; an anchor without positives or without rows in a window has no
result rows; an empty table has none; extra columns are dropped before the work.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, shared_folder
from .flat import in_arrow, shuffle_tasks

#: Upper and lower end of a window without limits.
OPEN = 1 << 62
#: Directory nodes, at most.
NODES = 1024
#: Anchors that travel in one row.
GROUP = 128
#: Anchors that meet a block at a time.
CHUNK = 8192
#: Blocks that one packing task makes, at most.
TASK_BLOCKS = 64

INDEX = "part int, block long, label_low long, label_high long, low array<double>, high array<double>, ids binary, labels binary, vectors binary"
VISITS = "node int, chunk int, ids binary, keys binary, labels binary, vectors binary, lows binary, highs binary"
FOUND = "id long, key long, place int, other long, score long"


@dataclass(frozen=True)
class MiningConfig:
    """Production parameters."""

    positives: int = 5
    negatives: int = 3
    low: int = 50  # least negative score, percent of the positive score
    high: int = 95  # largest one
    scale: int = 256
    block: int = 8192  # rows of a block, at most
    leaf: int = 64  # rows of a leaf
    fan: int = 8  # boxes of an inner node


# --- the tree of one block ------------------------------------------------

def pack_order(vectors: np.ndarray, leaf: int) -> np.ndarray:
    """Row order of a sort-tile-recursive packing: consecutive runs of ``leaf`` rows are the leaves."""
    widest = np.argsort(-vectors.astype(np.float64).var(0), kind="stable")
    out: list[np.ndarray] = [np.zeros(0, np.int64)]
    todo = [(np.arange(len(vectors)), 0)]
    while todo:
        rows, level = todo.pop()
        leaves = -(-len(rows) // leaf)
        if leaves <= 1:
            out.append(rows)
            continue
        rows = rows[np.argsort(vectors[rows, widest[level % len(widest)]], kind="stable")]
        # slabs as the coordinates that are left share them, two at least
        slabs = max(2, int(np.ceil(leaves ** (1 / max(1, len(widest) - level)))))
        size = -(-leaves // slabs) * leaf
        todo += [(rows[at:at + size], level + 1) for at in range(0, len(rows), size)][::-1]
    return np.concatenate(out)


class RTree:
    """Packed rows and, from the leaves up, the boxes (low, high, least and largest label) of each level."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int, fan: int):
        runs = np.split(np.arange(len(labels)), np.flatnonzero(np.diff(labels)) + 1)
        order = np.concatenate([run[pack_order(vectors[run], leaf)] for run in runs])
        self.ids, self.labels, self.vectors, self.leaf, self.fan = ids[order], labels[order], vectors[order], leaf, fan
        box, width = (self.vectors, self.vectors, self.labels, self.labels), leaf
        self.levels = []
        while not self.levels or len(box[0]) > fan:
            begin = np.arange(0, len(box[0]), width)
            box = tuple(f.reduceat(x, begin, axis=0) for f, x in zip((np.minimum, np.maximum) * 2, box))
            self.levels.append(box)
            width = fan


def intervals(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor with the points of each box."""
    anchors, low, high = (x.astype(np.float64) for x in (anchors, low, high))
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    slack = np.zeros(1)
    largest = np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T
    if largest.max(initial=0) >= 2 ** 53:
        slack = largest * 1e-9  # doubles round there
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


class Windows:
    """The best k (score, id) of each score window of one anchor."""

    def __init__(self, low: list[int], high: list[int], k: int):
        self.low, self.high, self.k = low, high, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in low]

    def needs(self) -> list[tuple[int, int]]:
        """Scores that can still change each window."""
        kth = [max(a, found[-1][0]) if len(found) == self.k else a for a, found in zip(self.low, self.best)]
        return list(zip(kth, self.high))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for w, (low, high) in enumerate(self.needs()):
            hit = np.flatnonzero((scores >= low) & (scores <= high))
            if len(hit):
                found = self.best[w] + [(int(s), i) for s, i in zip(scores[hit].tolist(), ids[hit].tolist())]
                self.best[w] = sorted(found, key=lambda x: (-x[0], x[1]))[:self.k]


def search(tree: RTree, anchor: np.ndarray, own: int, label: int, same: bool, windows: Windows, least: list[list[float]], most: list[list[float]]) -> int:
    """Best-first search of one anchor among the rows of its label (``same``) or of all others.

    ``least`` and ``most`` hold the bounds of the boxes by level. Returns the
    number of leaves it looked into.
    """
    top = len(tree.levels) - 1
    queue = [(-upper, top, node) for node, upper in enumerate(most[top])]
    heapq.heapify(queue)
    needs, leaves = windows.needs(), 0
    floor = min(low for low, _ in needs)
    while queue:
        upper, level, node = heapq.heappop(queue)
        upper = -upper
        if upper < floor:
            break  # all that are left lie strictly below the kth of each window
        lower = least[level][node]
        if not any(upper >= low and lower <= high for low, high in needs):
            continue
        first, last = tree.levels[level][2][node], tree.levels[level][3][node]
        if not first <= label <= last if same else first == last == label:
            continue
        if level:
            below = most[level - 1]
            for child in range(node * tree.fan, min((node + 1) * tree.fan, len(below))):
                heapq.heappush(queue, (-below[child], level - 1, child))
            continue
        leaves += 1
        rows = slice(node * tree.leaf, (node + 1) * tree.leaf)
        scores = tree.vectors[rows] @ anchor
        if scores.max() < floor:
            continue
        fit = ((tree.labels[rows] == label) == same) & (tree.ids[rows] != own)
        windows.add(scores[fit], tree.ids[rows][fit])
        needs = windows.needs()
        floor = min(low for low, _ in needs)
    return leaves


def search_block(tree: RTree, anchors: dict[str, np.ndarray], same: bool, k: int) -> list[tuple[int, int, int, int, int]]:
    """(id, key, window, other id, score) of the best k rows of the block per anchor and window."""
    vectors = anchors["vectors"]
    largest = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    exact = largest(vectors) * largest(tree.vectors) * vectors.shape[1] < 2 ** 53
    kind = np.float64 if exact else np.int64
    if tree.vectors.dtype != kind:
        tree.vectors = tree.vectors.astype(kind)
    bounds = [intervals(vectors, low, high) for low, high, _, _ in tree.levels]
    out = []
    for a in range(len(vectors)):
        own, key = int(anchors["ids"][a]), int(anchors["keys"][a])
        windows = Windows(anchors["lows"][a].tolist(), anchors["highs"][a].tolist(), k)
        search(tree, vectors[a].astype(kind), own, int(anchors["labels"][a]), same, windows, [x[a].tolist() for x, _ in bounds], [y[a].tolist() for _, y in bounds])
        out += [(own, key, w, other, score) for w, found in enumerate(windows.best) for score, other in found]
    return out


# --- rows, index, directory -----------------------------------------------

def usable_rows(vectors: DataFrame, label: Column | None = None, config: MiningConfig = MiningConfig(), id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """id, label, v (integer components), key of the rows that take part; ``label`` relabels them from columns id and label."""
    rows = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("long").alias("label"),
        F.col(f"`{vector_column}`").cast("array<double>").alias("x"),
    ).where("id is not null and label is not null and x is not null")
    rows = rows.where(F.coalesce(F.forall("x", lambda x: F.abs(x) < float("inf")), F.lit(False)))
    if label is not None:
        rows = rows.withColumn("label", label.cast("long"))
    common = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    scaled = F.transform("x", lambda x: F.floor(x * F.lit(float(config.scale))))
    length = F.aggregate("x", F.lit(0.0), lambda s, x: s + F.pow(x * F.lit(float(config.scale)), F.lit(2.0)))
    rows = rows.where((F.size("x") == (common["dims"] if common else -1)) & (F.size("x") > 0) & (length < 2.0 ** 61))
    return rows.select("id", "label", scaled.alias("v")).distinct().withColumn("key", F.xxhash64("id", "label", "v"))


def _raw(x: np.ndarray) -> bytes:
    """Integers in four bytes each where all fit, in eight elsewhere."""
    return x.astype("<i4" if np.abs(x).max(initial=0) < 1 << 31 else "<i8").tobytes()


def _cells(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(rows, -1)


def _unpacked(row: dict[str, bytes], dims: int) -> dict[str, np.ndarray]:
    """Arrays of a packed row."""
    n = len(row["ids"]) // 8
    out = {name: np.frombuffer(row[name], "<i8") for name in ("ids", "labels")}
    out["vectors"] = np.frombuffer(row["vectors"], f"<i{len(row['vectors']) // (n * dims)}").astype(np.int64).reshape(n, dims)
    return out


def build_index(rows: DataFrame, dims: int, config: MiningConfig = MiningConfig()) -> DataFrame:
    """Blocks of all rows, one row each with its box: written to the shared folder and read again."""
    spark = rows.sparkSession
    blocks = -(-rows.count() // config.block)
    tasks = max(1, min(blocks, shuffle_tasks(rows)), -(-blocks // TASK_BLOCKS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size = 0, [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
            parts = [c.flatten().to_numpy(zero_copy_only=False) for c in table.column("v").chunks]
            vectors = np.concatenate(parts).reshape(-1, dims)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            part = table.column("part")[0].as_py()
            values = [
                part, part << 24 | made, int(labels.min()), int(labels.max()), vectors.min(0).astype(np.float64), vectors.max(0).astype(np.float64),
                ids.tobytes(), labels.tobytes(), _raw(vectors),
            ]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], [c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= config.block:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, config.block))
                made += 1
                held, size = table.slice(config.block).to_batches(), size - config.block
        if size:
            yield block(pa.Table.from_batches(held))

    order = ["label", F.col("v")[0], "id"]
    dealt = rows.repartitionByRange(tasks, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    folder = shared_folder(spark, "rtree")
    in_arrow(dealt.select("part", "id", "label", "v"), pack, INDEX).write.parquet(folder)
    return spark.read.parquet(folder).withColumn("node", F.expr(f"part div {-(-tasks // NODES)}").cast("int"))


def directory(index: DataFrame, dims: int) -> dict[str, np.ndarray]:
    """node, label_low, label_high, low, high of the directory nodes (``NODES`` at most)."""
    labels = index.groupBy("node").agg(F.min("label_low").alias("a"), F.max("label_high").alias("b")).orderBy("node").toPandas()
    cells = index.select("node", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x"))
    cells = cells.groupBy("node", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).orderBy("node", "at").toPandas()
    box = {side: cells[side].to_numpy(np.float64).reshape(-1, dims) for side in ("low", "high")}
    return {"node": labels["node"].to_numpy(), "label_low": labels["a"].to_numpy(), "label_high": labels["b"].to_numpy(), **box}


def best_rows(index: DataFrame, anchors: DataFrame, nodes: dict[str, np.ndarray], dims: int, same: bool, k: int, config: MiningConfig = MiningConfig()) -> DataFrame:
    """id, key, place (of the window), rank, other, score: the best k rows of each anchor and score window.

    ``anchors``: id, key, label, v, lows, highs (arrays of equal length over all rows).
    """
    chunks = -(-anchors.count() // CHUNK)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                n = part.num_rows
                ids, keys, labels = (part.column(c).to_numpy() for c in ("id", "key", "label"))
                vectors, lows, highs = (part.column(c).flatten().to_numpy().reshape(n, -1) for c in ("v", "lows", "highs"))
                least, most = intervals(vectors, nodes["low"], nodes["high"])
                inside = (nodes["label_low"] <= labels[:, None]) & (labels[:, None] <= nodes["label_high"])
                alone = (nodes["label_low"] == labels[:, None]) & (labels[:, None] == nodes["label_high"])
                meets = ((most[:, :, None] >= lows[:, None, :]) & (least[:, :, None] <= highs[:, None, :])).any(2)
                go = meets & (inside if same else ~alone)
                out = []
                for node in np.flatnonzero(go.any(0)):
                    take = np.flatnonzero(go[:, node])
                    cells = [x[take].tobytes() for x in (ids, keys, labels)] + [_raw(vectors[take])] + [x[take].tobytes() for x in (lows, highs)]
                    out.append((int(nodes["node"][node]), int(keys[0] % max(1, chunks)), *cells))
                if out:
                    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [c.split()[0] for c in VISITS.split(", ")])

    def match(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            tree = RTree(**_unpacked({c: right.column(c)[0].as_py() for c in ("ids", "labels", "vectors")}, dims), leaf=config.leaf, fan=config.fan)
            for at in range(left.num_rows):
                row = {c: left.column(c)[at].as_py() for c in ("ids", "keys", "labels", "vectors", "lows", "highs")}
                some = _unpacked(row, dims) | {"keys": np.frombuffer(row["keys"], "<i8")}
                some |= {c: _cells(row[c], len(some["ids"])) for c in ("lows", "highs")}
                out += search_block(tree, some, same, k)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], [c.split()[0] for c in FOUND.split(", ")])

    visits = in_arrow(anchors.select("id", "key", "label", "v", "lows", "highs"), visit, VISITS)
    asked = visits.join(index.select("node", "block"), "node").drop("node")
    blocks = index.select(F.col("block").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(max(0, chunks - 1)))).alias("part"), "ids", "labels", "vectors")
    n = shuffle_tasks(index)
    met = asked.repartition(n, "block", "chunk").groupBy("block", "chunk").cogroup(blocks.repartition(n, "own", "part").groupBy("own", "part"))
    found = met.applyInArrow(match, FOUND)
    order = Window.partitionBy("id", "key", "place").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, label: Column | None = None, config: MiningConfig = MiningConfig(), id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Hard negatives of the rows for which ``anchors`` (a condition on column ``id``) holds.

    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark, "mining-rows")
    usable_rows(vectors, label, config, id_column, vector_column, label_column).write.parquet(folder)
    rows = spark.read.parquet(folder)
    first = rows.select(F.size("v").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dims = first["n"]
    index = build_index(rows, dims, config)
    nodes = directory(index, dims)
    asked = rows.where(anchors)
    limits = lambda x: F.array(F.lit(x).cast("long"))
    open_ended = asked.withColumn("lows", limits(-OPEN)).withColumn("highs", limits(OPEN))
    positives = cut_lineage(best_rows(index, open_ended, nodes, dims, True, config.positives, config))

    percent = lambda c, p: F.col(c).cast("decimal(20,0)") * F.lit(p).cast("decimal(10,0)") / F.lit(100).cast("decimal(3,0)")
    low, high = F.ceil(percent("score", config.low)).cast("long"), F.floor(percent("score", config.high)).cast("long")
    windows = positives.select("id", "key", F.struct("rank", low.alias("low"), high.alias("high")).alias("w")).groupBy("id", "key").agg(F.sort_array(F.collect_list("w")).alias("w"))
    filled = lambda side, empty: F.transform(F.sequence(F.lit(1), F.lit(config.positives)), lambda k: F.coalesce(F.try_element_at("w", k)[side], F.lit(empty).cast("long")))
    bounded = asked.join(windows, ["id", "key"]).withColumn("lows", filled("low", OPEN)).withColumn("highs", filled("high", -OPEN))
    found = best_rows(index, cut_lineage(bounded), nodes, dims, False, config.negatives, config)
    pairs = positives.select("id", "key", (F.col("rank") - 1).alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.withColumnsRenamed({"other": "negative_id", "score": "negative_score"}).join(pairs, ["id", "key", "place"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
