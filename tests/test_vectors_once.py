import random

import numpy as np
from pyspark.sql import functions as F

from cdrloom.functions.sequence import biophysical_feature
from cdrloom.models import training as M, tree_shap as T
from cdrloom.operators.features import FeatureBuilder, FeatureConfig

CONFIG = FeatureConfig(features=("length", "charge", "R", "vh_charge"))


def table(spark):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        loop = "".join(rng.choice("ACDRKW") for _ in range(rng.randint(0, 9)))
        rows.append((f"b{k}", loop if k % 7 else None, "EV-" + loop.lower() if k % 5 else None, int(loop.count("R") > 1), k % 24))
    return spark.createDataFrame(rows, "barcode string, cdr3 string, hseq string, good int, cluster int")


def test_cross_validation_builds_vectors_once_and_holds_each_row_out_once(spark, monkeypatch):
    built = []
    transform = FeatureBuilder.transform
    monkeypatch.setattr(FeatureBuilder, "transform", lambda self, df, *a: built.append(1) or transform(self, df, *a))
    out = M.cross_validate(table(spark), "good", CONFIG, M.ModelConfig(trees=3, depth=2), k=3)["predictions"]
    rows = out.select("barcode", "fold", "prob").collect()
    assert len(built) == 1
    assert sorted(r["barcode"] for r in rows) == sorted(f"b{k}" for k in range(120)) and all(0 <= r["prob"] <= 1 for r in rows)


def test_builder_cleans_texts_once_with_the_same_values(spark):
    df = table(spark)
    builder = FeatureBuilder(CONFIG).fit(df)
    out = builder.transform(df)
    assert out.columns == [*df.columns, "features"]
    want = [biophysical_feature(f, F.col("cdr3"), F.col("hseq")).alias(f) for f in CONFIG.features]
    for r in out.select("features", *want).collect():
        assert list(r["features"].toArray()) == [r[f] for f in CONFIG.features]


def test_patterns_looked_up_equal_patterns_solved_per_batch(monkeypatch):
    rng = np.random.default_rng(0)
    cuts, leaves = np.sort(rng.normal(size=(5, 6)), axis=1), []
    for d in [0, 1, 2, 3, 5, 5, 4, 2]:
        f = np.sort(rng.choice(5, d, replace=False)).astype(np.int64)
        low = np.array([rng.choice([-np.inf, cuts[x][1]]) for x in f])
        high = np.array([rng.choice([np.inf, cuts[x][4]]) for x in f])
        leaves.append(T.Leaf(float(rng.normal()), f, low, high, rng.random(d)))
    points = rng.normal(size=(400, 5))
    points[::3, 2], points[5, 1], points[6, 0] = cuts[2][4], np.nan, np.inf
    slot = {k: k for k in range(5)}
    for longest in (8, 2):  # longer paths are solved as they occur
        monkeypatch.setattr(T, "LONGEST_PATH", longest)
        assert np.allclose(T.Explainer(leaves, slot)(points), T.contributions(leaves, points, slot), atol=1e-12)
    assert T.Explainer(leaves, slot)(points[:0]).shape == (0, 5)
