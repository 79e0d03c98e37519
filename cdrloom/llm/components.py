"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of ``edges`` (columns a and b).

    Each round takes the least label among the neighbours, then the label of
    that label, so paths shrink by half; rounds end when no label changes.
    Partial aggregation before the shuffle keeps a node of many edges cheap.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        better = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        better = cut_lineage(better.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")))
        if better.where("root <> old").isEmpty():
            return better.select("node", "root")
        labels = better.select("node", "root")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of n nodes, for edges a-b in memory."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root
