import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cdrloom.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, id string, key double, v int"


def brute(rows, config=N.MiningConfig()):
    """Result rows by scoring all pairs with Python integers."""
    found = {}
    for i, x, label in rows:
        if i is not None and x is not None and label is not None and len(x) == 6 and all(c is not None and math.isfinite(c) for c in x):
            label = (label + 1) % 10 if i % 7 == 0 else label
            found[i, label, tuple(math.floor(256 * float(np.float32(c))) for c in x)] = None
    out = Counter()
    for i, label, v in found:
        if i % 5:
            continue
        near = sorted(((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in found if j != i))
        for s, j, _ in [x for x in near if x[2] == label][:config.positives]:
            fit = [x for x in near if x[2] != label and config.low * -s <= 100 * -x[0] <= config.high * -s][:config.negatives]
            out.update((i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(fit, 1))
    return out


def mined(spark, rows, config):
    table = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], SCHEMA)
    relabelled = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return Counter(map(tuple, N.mine(table, F.col("id") % 5 == 0, relabelled, config).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    made = [(k, [float(x) for x in rng.normal(0, 0.4, 6)], int(rng.integers(0, 3))) for k in range(150)]
    centre = [0.5, 0.25, 0.0, 0.0, 0.0, 1.0]
    made += [(k, centre, k % 2) for k in range(150, 190)]  # ties, one hot vector
    made += [(k, [1.0] * 6, 9) for k in range(190, 200)]
    made += [(200, None, 1), (201, [1.0] * 6, None), (None, [1.0] * 6, 1), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (203, [float("nan")] * 6, 1)]
    made += [(204, [float("inf")] * 6, 1), (205, [1.0] * 5, 1), (206, [], 1), (210, [0.0] * 6, 0), (215, [-0.001] * 6, 5), (220, [3.0] * 6, 8)]
    return made + [made[0], made[5], made[160], (10, [0.3] * 6, 1), (10, [0.3] * 6, 2)]


@pytest.mark.parametrize("config", [N.MiningConfig(), N.MiningConfig(block=16, leaf=4, fan=2), N.MiningConfig(positives=2, negatives=4, low=0, high=100, block=40, leaf=3)])
def test_equals_brute_force(spark, rows, config, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 20)
    assert mined(spark, rows, config) == brute(rows, config)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(0, 1, 6) * 2.0 ** 20], k % 2) for k in range(60)]
    rows.append((500, [2.0 ** 60] * 6, 1))  # products would not fit 64 bits
    assert mined(spark, rows, N.MiningConfig(block=16, leaf=4)) == brute(rows[:-1])


def test_few_or_no_rows(spark):
    assert not mined(spark, [], N.MiningConfig())
    assert not mined(spark, [(5, [1.0] * 6, 1)], N.MiningConfig())
    assert not mined(spark, [(5, None, 1), (6, None, None)], N.MiningConfig())


def test_boxes_hold_their_rows_and_bounds_hold_their_products():
    rng = np.random.default_rng(1)
    vectors, labels = rng.integers(-300, 300, (500, 8)), np.sort(rng.integers(0, 4, 500))
    tree = N.RTree(np.arange(500), labels, vectors, 16, 4)
    assert sorted(tree.ids.tolist()) == list(range(500)) and (vectors[tree.ids] == tree.vectors).all() and len(tree.levels[-1][0]) <= 4
    anchors = rng.integers(-300, 300, (7, 8))
    scores, width = anchors @ tree.vectors.T, tree.leaf
    for low, high, first, last in tree.levels:
        least, most = N.intervals(anchors, low, high)
        for b in range(len(low)):
            own = slice(b * width, (b + 1) * width)
            assert (least[:, b] <= scores[:, own].min(1)).all() and (scores[:, own].max(1) <= most[:, b]).all()
            assert first[b] == tree.labels[own].min() and last[b] == tree.labels[own].max()
        width *= tree.fan


def test_best_first_search_leaves_out_far_boxes():
    rng = np.random.default_rng(2)
    centres = np.repeat(np.eye(4, dtype=int) * 1000, 256, 0)
    vectors = centres + rng.integers(-20, 20, centres.shape)
    tree = N.RTree(np.arange(1024), np.zeros(1024, int), vectors, 16, 4)
    anchor = np.array([1000, 0, 0, 0])
    bounds = [N.intervals(anchor[None], low, high) for low, high, _, _ in tree.levels]
    windows = N.Windows([-N.OPEN], [N.OPEN], 5)
    looked = N.search(tree, anchor, -1, 0, True, windows, [x[0].tolist() for x, _ in bounds], [y[0].tolist() for _, y in bounds])
    scores = vectors @ anchor
    assert windows.best[0] == [(int(scores[j]), int(j)) for j in np.lexsort((np.arange(1024), -scores))[:5]]
    assert looked <= 16  # of 64 leaves
