"""Isolation forest: trees grown in parallel on small samples, scored in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..operators.ordered import join_small

SAMPLE = 256


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow(points: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    """Append a subtree to ``nodes`` as (feature, split, left, right, path) rows."""
    here = len(nodes)
    nodes.append(None)
    spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
    usable = np.flatnonzero(spread > 0)
    if depth >= limit or len(points) <= 1 or len(usable) == 0:
        nodes[here] = (-1, 0.0, -1, -1, depth + average_path(len(points)))
        return here
    feature = int(rng.choice(usable))
    low, high = points[:, feature].min(), points[:, feature].max()
    split = float(rng.uniform(low, high))
    goes_left = points[:, feature] <= split
    left = grow(points[goes_left], rng, depth + 1, limit, nodes)
    right = grow(points[~goes_left], rng, depth + 1, limit, nodes)
    nodes[here] = (feature, split, left, right, 0.0)
    return here


def fit_isolation_forest(df: DataFrame, vec: str, key: str, trees: int = 100, seed: int = 42) -> list[list[tuple]]:
    """Trees grown from at most 256 rows each.

    Every row draws a random number per tree and the 256 smallest make that
    tree's sample; rows that cannot be among them are dropped before the
    shuffle, so it carries about ``trees x 256`` rows whatever the table size.
    """
    n = df.count()
    if n == 0:
        raise ValueError("no rows to fit")
    draw = lambda t: (F.xxhash64(F.col(key), F.lit(seed), t).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    # a generous share; a tree gets fewer than 256 rows only if the table has fewer
    share = min(1.0, 2.0 * SAMPLE / n + 64.0 / n)
    offers = df.select(key, vec, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    offers = offers.withColumn("_u", draw(F.col("tree"))).where(F.col("_u") < share)
    dense = offers.select("tree", "_u", vector_to_array(vec, "float32").alias("v"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        points = np.stack(group.sort_values("_u")["v"].iloc[:SAMPLE].to_numpy())
        nodes: list = []
        limit = math.ceil(math.log2(max(2, len(points))))
        grow(points, np.random.default_rng(seed + tree), 0, limit, nodes)
        rows = [(tree, len(points), i, *node) for i, node in enumerate(nodes)]
        return pd.DataFrame(rows, columns=["tree", "size", "node", "feature", "split", "left", "right", "path"])

    schema = "tree long, size long, node long, feature long, split double, left long, right long, path double"
    grown = dense.groupBy("tree").applyInPandas(build, schema).toPandas()  # trees x 511 rows at most
    return [
        {"size": int(g["size"].iloc[0]), "nodes": g.sort_values("node")[["feature", "split", "left", "right", "path"]].to_numpy()}
        for _, g in grown.groupby("tree")
    ]


def isolation_score(df: DataFrame, vec: str, forest: list, name: str = "anomaly") -> DataFrame:
    """Share-of-path anomaly score in (0, 1]; higher is more unusual.

    Only the dimensions that some node splits on leave the vector.
    """
    used = sorted({int(f) for tree in forest for f in tree["nodes"][:, 0] if f >= 0})
    slot = np.zeros(max(used, default=0) + 1)
    slot[used] = np.arange(len(used))
    narrow = []
    for tree in forest:
        nodes = tree["nodes"].copy()
        split = nodes[:, 0] >= 0
        nodes[split, 0] = slot[nodes[split, 0].astype(np.int64)]
        narrow.append({"size": tree["size"], "nodes": nodes})
    shared = df.sparkSession.sparkContext.broadcast(narrow)  # trees x 511 nodes at most

    @pandas_udf(DoubleType())
    def score(vectors: pd.Series) -> pd.Series:
        points = np.stack(vectors.to_numpy())
        total = np.zeros(len(points))
        for tree in shared.value:
            nodes = tree["nodes"]
            at = np.zeros(len(points), dtype=np.int64)
            while True:
                feature = nodes[at, 0].astype(np.int64)
                open_ = feature >= 0
                if not open_.any():
                    break
                value = points[np.arange(len(points)), np.where(open_, feature, 0)]
                step = np.where(value <= nodes[at, 1], nodes[at, 2], nodes[at, 3]).astype(np.int64)
                at = np.where(open_, step, at)
            total += nodes[at, 4]
        norm = average_path(shared.value[0]["size"]) or 1.0
        return pd.Series(np.power(2.0, -total / len(shared.value) / norm))

    kept = VectorSlicer(inputCol=vec, outputCol="_used", indices=used or [0]).transform(df)
    return kept.withColumn(name, score(vector_to_array("_used", "float32"))).drop("_used")


def one_class_score(df: DataFrame, vec: str, key: str, positive: str, train: str, contamination: float = 0.1,
                    trees: int = 100, seed: int = 42, name: str = "score") -> DataFrame:
    """Anomaly relative to the positives: 0 at their ``1 - contamination`` quantile.

    Higher is farther from the positives, as the negated decision function of
    a forest fitted on them.
    """
    known = df.where(F.col(train) & (F.col(positive) == 1))
    forest = fit_isolation_forest(known, vec, key, trees, seed)
    offset = isolation_score(known, vec, forest, "_a").agg(
        F.percentile_approx("_a", 1 - contamination, 10000).alias("_offset")
    )
    out = join_small(isolation_score(df, vec, forest, "_a"), offset, [])
    return out.withColumn(name, F.col("_a") - F.col("_offset")).drop("_a", "_offset")
