"""Path-dependent Shapley values of Spark ML tree ensembles.

The trees are read from the saved model and flattened into leaves.  A leaf is a
value, an interval per feature on its path, and per feature the share of training
weight that follows the path at the splits on it.  As a game over the features of
its path a leaf is a product: a known feature counts 1 if the row's value lies in
the interval and 0 if not, an unknown one counts its share.  So the Shapley value of
a feature is the leaf's value times (known - share) times a weighted sum of the
coefficients of a small polynomial, and rows that lie inside the same intervals of a
leaf share all of it: the patterns of a path are solved once, rows look theirs up;
those of a path of many features are solved as they occur.

Only features that some node splits on leave the vector, and they do so in the JVM.
Zeros need no special care: they are values like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder


LONGEST_PATH = 8  # features; all 2 ** 8 patterns of such a path are solved at once


@dataclass(frozen=True)
class Leaf:
    """Value of a leaf and, per feature on its path, interval (low, high] and share of training weight."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def tree_nodes(model: Model, spark: SparkSession) -> pd.DataFrame:
    """Nodes of all trees of a fitted ensemble: 2 ** (depth + 1) rows per tree at most."""
    folder = shared_folder(spark, "trees")
    model.write().save(folder)
    nodes = spark.read.parquet(f"{folder}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    return nodes.select(
        "tree", "id", "prediction", "impurityStats", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("threshold"),
        F.col("split.numCategories").alias("categories"),
    ).orderBy("tree", "id").toPandas()


def _kind(model: Model) -> str:
    name = type(model).__name__
    if name not in ("RandomForestClassificationModel", "RandomForestRegressionModel", "GBTClassificationModel", "GBTRegressionModel"):
        raise ValueError(f"no tree ensemble: {name}")
    return name


def leaves_of(model: Model, spark: SparkSession) -> list[Leaf]:
    """All leaves; their values add up to the margin of ``margin``."""
    name, weights = _kind(model), list(model.treeWeights)
    votes = name == "RandomForestClassificationModel"
    out: list[Leaf] = []
    for tree, nodes in tree_nodes(model, spark).groupby("tree"):
        rows = {int(r.id): r for r in nodes.itertuples(index=False)}
        scale = weights[tree] / (len(weights) if name.startswith("RandomForest") else 1)
        # training weight of a node: the sum over classes, or the first of the sums kept for a variance
        weight = {i: float(np.sum(r.impurityStats)) if votes else float(r.impurityStats[0]) for i, r in rows.items()}
        todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while todo:
            at, path = todo.pop()
            node = rows[at]
            if node.left < 0:
                value = float(node.impurityStats[1]) / weight[at] if votes else float(node.prediction)
                cells = [path[f] for f in sorted(path)]
                low, high, share = (np.array([c[k] for c in cells]) for k in range(3))
                out.append(Leaf(scale * value, np.array(sorted(path), np.int64), low, high, share))
                continue
            if node.categories >= 0:
                raise ValueError("categorical splits are not supported")
            cut = float(node.threshold[0])
            low, high, share = path.get(int(node.feature), (-np.inf, np.inf, 1.0))
            todo.append((int(node.left), path | {int(node.feature): (low, min(high, cut), share * weight[node.left] / weight[at])}))
            todo.append((int(node.right), path | {int(node.feature): (max(low, cut), high, share * weight[node.right] / weight[at])}))
    return out


def expected(leaves: list[Leaf]) -> float:
    """Margin when no feature is known."""
    return float(sum(leaf.value * leaf.share.prod() for leaf in leaves))


def shapley(leaf: Leaf, known: np.ndarray) -> np.ndarray:
    """Shapley values (patterns x path features) of one leaf; ``known`` tells which intervals hold the row."""
    n, d = known.shape
    out = np.zeros((n, d))
    weights = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
    for i in range(d):
        poly = np.ones((n, 1))
        for j in range(d):
            if j != i:
                grown = np.zeros((n, poly.shape[1] + 1))
                grown[:, :-1] += poly * leaf.share[j]
                grown[:, 1:] += poly * known[:, j:j + 1]
                poly = grown
        out[:, i] = leaf.value * (known[:, i] - leaf.share[i]) * (poly @ weights)
    return out


def contributions(leaves: list[Leaf], points: np.ndarray, slot: dict[int, int]) -> np.ndarray:
    """Shapley values of all rows of ``points``, whose columns hold the features of ``slot``."""
    out = np.zeros(points.shape)
    for leaf in leaves:
        columns = np.array([slot[int(f)] for f in leaf.features], np.int64)
        if not len(columns):
            continue
        values = points[:, columns]
        known = (values > leaf.low) & (values <= leaf.high)
        packed = known @ (1 << np.arange(len(columns)))  # a path holds few features
        _, first, which = np.unique(packed, return_index=True, return_inverse=True)
        out[:, columns] += shapley(leaf, known[first].astype(np.float64))[which]
    return out


def solved_patterns(leaves: list[Leaf]) -> list[np.ndarray]:
    """Per leaf the Shapley values of every pattern (path features x 2 ** path features), leaves of equal size solved together."""
    out: list[np.ndarray] = [np.zeros((0, 1))] * len(leaves)
    for d in sorted({len(leaf.features) for leaf in leaves if len(leaf.features)}):
        some = [k for k, leaf in enumerate(leaves) if len(leaf.features) == d]
        known = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(np.float64)
        weights = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
        for at in range(0, len(some), 256):
            part = some[at:at + 256]
            value = np.array([leaves[k].value for k in part])[:, None]
            share = np.array([leaves[k].share for k in part])
            solved = np.empty((len(part), d, 1 << d))
            for i in range(d):
                poly = np.ones((len(part), 1 << d, 1))
                for j in range(d):
                    if j != i:
                        grown = np.zeros((len(part), 1 << d, poly.shape[2] + 1))
                        grown[:, :, :-1] += poly * share[:, j, None, None]
                        grown[:, :, 1:] += poly * known[None, :, j, None]
                        poly = grown
                solved[:, i] = value * (known[None, :, i] - share[:, i, None]) * (poly @ weights)
            for k, one in zip(part, solved):
                out[k] = one
    return out


class Explainer:
    """Shapley values of many rows: every pattern of a short path is solved once, rows only look theirs up.

    A row's value becomes the number of the cell between two cuts of its feature,
    so that whether an interval holds it is a comparison of small whole numbers.
    """

    def __init__(self, leaves: list[Leaf], slot: dict[int, int]):
        self.cuts: list[np.ndarray] = [np.zeros(0)] * len(slot)
        for f, k in slot.items():
            ends = [x for leaf in leaves for j in np.flatnonzero(leaf.features == f) for x in (leaf.low[j], leaf.high[j])]
            self.cuts[k] = np.unique([x for x in ends if np.isfinite(x)])
        small = [leaf for leaf in leaves if 0 < len(leaf.features) <= LONGEST_PATH]
        self.rest = [leaf for leaf in leaves if len(leaf.features) > LONGEST_PATH]
        self.slot, self.paths = slot, []
        for leaf, solved in zip(small, solved_patterns(small)):
            columns = [slot[int(f)] for f in leaf.features]
            cells = []
            for c, low, high in zip(columns, leaf.low, leaf.high):
                first = 0 if low == -np.inf else int(np.searchsorted(self.cuts[c], low)) + 1
                last = len(self.cuts[c]) if high == np.inf else int(np.searchsorted(self.cuts[c], high))
                cells.append((c, first, last))
            self.paths.append((cells, solved))

    def __call__(self, points: np.ndarray) -> np.ndarray:
        """Shapley values of all rows of ``points``, whose columns hold the features of the slots."""
        n = len(points)
        size = max((len(c) for c in self.cuts), default=0) + 2
        kind = np.uint8 if size <= 255 else np.int32
        cells = []
        for k, cuts in enumerate(self.cuts):
            x = points[:, k]
            # a value that is no number lies in no interval
            cells.append(np.where(np.isnan(x), size, np.searchsorted(cuts, x)).astype(kind))
        out, found = np.zeros((points.shape[1], n)), np.empty(n)
        for path, solved in self.paths:
            packed = np.zeros(n, np.uint16)
            for j, (c, first, last) in enumerate(path):
                inside = cells[c] <= last if first == 0 else (cells[c] >= first) & (cells[c] <= last)
                packed |= inside.astype(np.uint16) << np.uint16(j)
            at = packed.astype(np.intp)
            for (c, _, _), values in zip(path, solved):
                np.take(values, at, out=found, mode="clip")
                out[c] += found
        return np.ascontiguousarray(out.T) + (contributions(self.rest, points, self.slot) if self.rest else 0.0)


def margin(model: Model, df: DataFrame, name: str = "margin") -> DataFrame:
    """What the contributions add up to: probability of class 1 of a forest, log-odds half of boosting, or the predicted value."""
    kind = _kind(model)
    vector = {"RandomForestClassificationModel": "probability", "GBTClassificationModel": "rawPrediction"}.get(kind)
    value = vector_to_array(vector)[1] if vector else F.col("prediction")
    return model.transform(df).select(*df.columns, value.alias(name))


def tree_contributions(df: DataFrame, model: Model, names: list[str], key: str, vec: str = "features") -> DataFrame:
    """key, base, parts (feature, value) of each row: base plus all values is the margin.

    ``parts`` holds the features that some node splits on; all others add nothing.
    """
    leaves = leaves_of(model, df.sparkSession)
    used = sorted({int(f) for leaf in leaves for f in leaf.features})
    base = expected(leaves)
    slot = {f: k for k, f in enumerate(used)}
    labels = [names[f] for f in used]
    if not used:
        empty = F.array().cast("array<struct<feature:string,value:double>>")
        return df.select(key, F.lit(base).alias("base"), empty.alias("parts"))
    narrow = VectorSlicer(inputCol=vec, outputCol="_used", indices=used).transform(df.select(key, vec))
    rows = narrow.select(key, vector_to_array("_used").alias("x"))
    kind = rows.schema[key].dataType.simpleString()

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values_of = None
        for batch in batches:
            values_of = values_of or Explainer(leaves, slot)
            points = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(used))
            values = values_of(points)
            ends = pa.array(np.arange(0, values.size + 1, len(used), dtype=np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "values"])

    found = rows.mapInArrow(explain, f"`{key}` {kind}, `values` array<double>")
    parts = F.transform("values", lambda v, k: F.struct(F.get(F.array(*[F.lit(x) for x in labels]), k).alias("feature"), v.alias("value")))
    return found.select(key, F.lit(base).alias("base"), parts.alias("parts"))


def tree_attributions(df: DataFrame, model: Model, names: list[str], key: str) -> DataFrame:
    """Long (key, feature, value) of ``tree_contributions``."""
    return tree_contributions(df, model, names, key).select(key, F.explode("parts").alias("p")).select(key, "p.feature", "p.value")
