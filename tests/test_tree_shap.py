import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

from cdrloom.models import tree_shap as T

NAMES = ["a", "b", "c", "d", "e", "unused"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        x = [rng.choice([0.0, rng.random()]) for _ in range(5)] + [1.0]
        y = x[0] + x[1] * x[2] - x[3] + rng.gauss(0, 0.1)
        rows.append((f"r{k}", Vectors.sparse(6, [(i, v) for i, v in enumerate(x) if v]) if k % 2 else Vectors.dense(x), y, float(y > 0.2), 1.0 + k % 3))
    return spark.createDataFrame(rows, ["barcode", "features", "y", "label", "w"])


def models(table):
    yield RandomForestClassifier(numTrees=4, maxDepth=4, weightCol="w", seed=1).fit(table)
    yield GBTClassifier(maxIter=4, maxDepth=3, weightCol="w", seed=1).fit(table)
    yield RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=4, seed=1).fit(table)
    yield GBTRegressor(labelCol="y", maxIter=3, maxDepth=3, stepSize=0.3, seed=1).fit(table)


def worth(leaves, point, known):
    """Margin when only the features of ``known`` are known."""
    total = 0.0
    for leaf in leaves:
        part = leaf.value
        for f, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
            part *= float(low < point[f] <= high) if f in known else share
        total += part
    return total


def brute(leaves, point, features):
    out = {}
    n = len(features)
    for f in features:
        rest = [g for g in features if g != f]
        out[f] = sum(
            factorial(k) * factorial(n - 1 - k) / factorial(n) * (worth(leaves, point, {*s, f}) - worth(leaves, point, set(s)))
            for k in range(n) for s in combinations(rest, k)
        )
    return out


def test_contributions_equal_all_subsets_and_add_up(spark, table):
    for model in models(table):
        leaves = T.leaves_of(model, spark)
        used = sorted({int(f) for leaf in leaves for f in leaf.features})
        found = T.tree_contributions(table, model, NAMES, "barcode").join(T.margin(model, table).select("barcode", "features", "margin"), "barcode").collect()
        assert len(found) == 300
        for k, r in enumerate(found):
            values = {p["feature"]: p["value"] for p in r["parts"]}
            assert r["base"] + sum(values.values()) == pytest.approx(r["margin"], abs=1e-9)
            if k % 25 == 0:
                point = r["features"].toArray()
                assert worth(leaves, point, set(used)) == pytest.approx(r["margin"], abs=1e-9)
                assert values == pytest.approx({NAMES[f]: v for f, v in brute(leaves, point, used).items()}, abs=1e-9)


def test_shares_of_a_tree_add_up_to_one(spark, table):
    model = RandomForestClassifier(numTrees=1, maxDepth=5, weightCol="w", seed=1).fit(table)
    assert sum(leaf.share.prod() for leaf in T.leaves_of(model, spark)) == pytest.approx(1.0)


def test_a_model_without_splits_has_no_parts(spark, table):
    model = RandomForestClassifier(numTrees=2, maxDepth=0, seed=1).fit(table)
    rows = T.tree_contributions(table, model, NAMES, "barcode").collect()
    assert all(r["parts"] == [] for r in rows) and len({r["base"] for r in rows}) == 1
    assert np.isfinite(rows[0]["base"])


def test_only_ensembles_of_trees(spark, table):
    from pyspark.ml.classification import LogisticRegression

    with pytest.raises(ValueError):
        T.leaves_of(LogisticRegression(maxIter=1).fit(table), spark)
