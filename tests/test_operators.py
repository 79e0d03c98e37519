import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cdrloom.functions import alignment as A
from cdrloom.models import training as M
from cdrloom.operators import (
    cleaning as C, clustering as G, joins as J, nearest as N, ordered as O, sampling as P, similarity as S, splits as X,
    statistics as T, thresholds as H,
)
from cdrloom.operators.features import FeatureBuilder, FeatureConfig
from cdrloom.plans import load_catalog
from cdrloom.session import cut_lineage
from cdrloom.sources import tables

SF = "/root/testdata/sf0.001"


def strings(n, seed, alphabet="ACDW", low=4, high=12):
    """Families of near copies, one of them holding a third of the rows."""
    rng = random.Random(seed)
    bases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(n // 6 + 1)]
    out = []
    for i in range(n):
        seq = list(bases[0] if i % 3 == 0 else rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            seq[rng.randrange(len(seq))] = rng.choice(alphabet)
        out.append("".join(seq))
    return out


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")


def greedy(seqs, cutoff):
    label, k = [0] * len(seqs), 0
    for i, a in enumerate(seqs):
        if label[i]:
            continue
        k += 1
        label[i] = k
        for j in range(i + 1, len(seqs)):
            total = len(a) + len(seqs[j])
            ratio = 1.0 if total == 0 else 1 - A.indel(a, seqs[j]) / total
            if not label[j] and ratio > cutoff:
                label[j] = k
    return label


@pytest.mark.parametrize("cutoff,block", [(0.8, 10**6), (0.6, 25)])
def test_greedy_cluster_equals_the_sequential_pass(spark, cutoff, block):
    seqs = strings(90, 3) + ["", ""]
    out = G.greedy_cluster(frame(spark, seqs), "seq", "id", cutoff, first_block=block).orderBy("id").collect()
    assert [r["cluster"] for r in out] == greedy(seqs, cutoff)


def test_close_pairs_are_complete(spark):
    seqs = sorted(set(strings(120, 7)))
    found = {(r["a"], r["b"]): r["distance"] for r in S.levenshtein_pairs(frame(spark, seqs), 3).collect()}
    want = {(i, j): d for i in range(len(seqs)) for j in range(i + 1, len(seqs)) if (d := lev(seqs[i], seqs[j])) <= 3}
    assert found == want


def test_nearest_previous(spark):
    mine, old = strings(40, 1), strings(30, 2)
    out = N.nearest_previous(frame(spark, mine), frame(spark, old), "seq").collect()
    assert len(out) == len(mine)
    for r in out:
        assert r["nearest"] == min(lev(r["seq"], p) for p in old)
    empty = N.nearest_previous(frame(spark, mine), frame(spark, old).limit(0), "seq")
    assert {r["nearest"] for r in empty.collect()} == {999}


def brute_linkage(d, method, limit, strict):
    parts = [[i] for i in range(len(d))]
    measure = {"complete": np.max, "average": np.mean}[method]
    while len(parts) > 1:
        best = min((measure(d[np.ix_(a, b)]), min(a), min(b), i, j)
                   for i, a in enumerate(parts) for j, b in enumerate(parts) if min(a) < min(b))
        if best[0] >= limit if strict else best[0] > limit:
            break
        parts[best[3]] = parts[best[3]] + parts[best[4]]
        del parts[best[4]]
    return {frozenset(p) for p in parts}


def partition(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["cluster"], set()).add(r["id"])
    return {frozenset(g) for g in groups.values()}


def test_complete_linkage_equals_brute_force(spark):
    seqs = sorted(set(strings(60, 5, "ACDEFGHIKLW", 10, 14)))
    texts = [s[2:-2] for s in seqs]
    i, j = np.triu_indices(len(seqs), 1)
    d = np.zeros((len(seqs), len(seqs)))
    d[i, j] = d[j, i] = -A.global_scores([texts[x] for x in i], [texts[y] for y in j], A.PAM30_ARRAY, -9, -1)
    cut = A.score_cutoff(1e-4)
    out = G.complete_linkage(frame(spark, seqs), "seq", "id", 1e-4).collect()
    labels = partition(out)
    # no cluster holds a pair beyond the cutoff, and no two clusters could still merge
    for part in labels:
        for a in part:
            for b in part:
                assert a == b or texts[a] == texts[b] or -d[a, b] >= cut
    whole = [sorted(p) for p in labels]
    for a in range(len(whole)):
        for b in range(a + 1, len(whole)):
            assert d[np.ix_(whole[a], whole[b])].max() > -cut
    if len(set(texts)) == len(texts):
        assert labels == brute_linkage(d, "complete", -cut + 1, True)


@pytest.mark.parametrize("metric", ["levenshtein", "blosum"])
def test_diverse_leads_equal_the_sequential_choice(spark, metric):
    seqs, old = strings(60, 11), strings(6, 12)
    rng = random.Random(4)
    rows = [(f"b{i:03d}", s, rng.randint(0, 20) / 20, rng.randint(1, 50)) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "barcode string, cdr3 string, score double, facs1 long")
    known = spark.createDataFrame([(s,) for s in old], "cdr3 string")
    out = G.select_diverse_leads(df, known, "score", "barcode", min_score=0.3, metric=metric, min_distance=4, max_similarity=1.5)
    total = sum(r[3] for r in rows)
    from cdrloom.constants import BLOSUM62, triangle

    table = triangle(BLOSUM62)

    def near(a, b):
        if metric == "levenshtein":
            return lev(a, b) < 4
        n = min(len(a), len(b))
        return sum(table[a[i], b[i]] for i in range(n)) / n > 1.5

    kept = []
    for key, seq, score, count in sorted(rows, key=lambda r: (-r[2], r[0])):
        if score >= 0.3 and count / total * 1e6 >= 200 and not any(near(seq, p) for p in old + [s for _, s in kept]):
            kept.append((key, seq))
    assert {r["barcode"] for r in out.where("selected").collect()} == {k for k, _ in kept}


def test_prefix_sum_and_row_ids(spark):
    rng = random.Random(0)
    keys = rng.sample(range(10000), 500)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k int, n int").repartition(7)
    got = {r["k"]: r["cum_n"] for r in O.prefix_sum(df, "k", ["n"], buckets=6).collect()}
    total = 0
    for k in sorted(keys):
        total += k % 7
        assert got[k] == total
    ids = sorted(r["i"] for r in O.with_row_ids(cut_lineage(df), "i").collect())
    assert ids == list(range(500))


def test_folds_keep_clusters_whole_and_labels_balanced(spark):
    rng = random.Random(2)
    rows = [(f"b{i}", f"c{0 if i % 3 == 0 else rng.randint(1, 120)}", int(rng.random() < 0.7)) for i in range(900)]
    df = spark.createDataFrame(rows, "barcode string, cluster string, y int")
    folded = X.group_stratified_folds(df, "y", "cluster", "barcode", 5)
    assert X.leakage_report(folded, "cluster", "fold").first()["leaked"] == 0
    again = X.group_stratified_folds(df.repartition(3), "y", "cluster", "barcode", 5)
    assert sorted(map(tuple, folded.select("barcode", "fold").collect())) == sorted(map(tuple, again.select("barcode", "fold").collect()))
    single = X.group_stratified_folds(df, "y", None, "barcode", 5).groupBy("fold").agg(F.avg("y").alias("r"), F.count("*").alias("n"))
    assert all(abs(r["r"] - 0.7) < 0.05 and 170 <= r["n"] <= 190 for r in single.collect())
    held = X.group_holdout(df, "y", "cluster", "barcode")
    assert X.leakage_report(held, "cluster").first()["leaked"] == 0
    few = X.group_stratified_folds(df.where("cluster in ('c0', 'c1')"), "y", "cluster", "barcode", 5)
    assert few.select("fold").distinct().count() == 2


def test_samples_are_nested(spark):
    df = spark.createDataFrame([(f"b{i}", int(i % 3 == 0)) for i in range(300)], "barcode string, y int")
    small, large = (P.balanced_sample(df, "y", "barcode", n).collect() for n in (40, 80))
    assert {r["barcode"] for r in small} < {r["barcode"] for r in large}
    assert sum(r["y"] for r in small) == 20 and len(small) == 40
    ladder = lambda n: sorted(r["size"] for r in P.size_ladder(spark.range(n), 500, 1000, True).collect())
    assert ladder(2500) == [500, 1500, 2500] and ladder(2600)[-1] == 2600 and ladder(100) == [100]


def test_repeated_keys_and_null_clusters_keep_their_rows(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("b", 0, None), ("c", 1, None), ("c", 1, None), ("d", 0, "y"), (None, 1, None)] * 3
    df = spark.createDataFrame(rows, "barcode string, y int, cluster string")
    for group in ("cluster", None):
        out = X.group_stratified_folds(df, "y", group, "barcode", 3).collect()
        assert len(out) == len(rows)
        folds = {}
        for r in out:
            folds.setdefault(r["barcode"], set()).add(r["fold"])
        assert all(len(f) == 1 for f in folds.values())
    sample = P.balanced_sample(df, "y", "barcode", 12).collect()
    assert len(sample) == 12 and sum(r["y"] for r in sample) == 6


def test_exact_quantiles(spark):
    rng = random.Random(8)
    rows = [(g, float(rng.randint(0, 30)) if g else rng.random()) for g in (0, 1) for _ in range(137)] + [(2, 5.0), (1, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    found = {r["g"]: r for r in O.quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], ["g"]).collect()}
    for g in (0, 1, 2):
        values = [v for k, v in rows if k == g and v is not None]
        assert found[g]["n"] == len(values)
        assert np.allclose(found[g]["q"], np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0]))


def test_density_equals_the_kernel_sum(spark):
    from cdrloom.operators.statistics import score_kde

    rng = random.Random(3)
    rows = [(c, rng.gauss(0.4 + 0.2 * c, 0.15)) for c in (0, 1) for _ in range(200)]
    found = score_kde(spark.createDataFrame(rows, "c int, s double"), "s", "c", 50).collect()
    for c in (0, 1):
        s = np.array([v for k, v in rows if k == c])
        h = len(s) ** -0.2 * s.std(ddof=1)
        k = np.exp(-(((np.arange(50) / 49)[:, None] - s) / h) ** 2 / 2).sum(1)
        mine = np.array([r["density"] for r in sorted((r for r in found if r["class"] == c), key=lambda r: r["step"])])
        assert np.allclose(mine, k / k.max(), atol=1e-10)


def test_guards(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    with pytest.raises(Exception, match="only one class"):
        C.validate_dataset(df, "y", 10).collect()
    with pytest.raises(Exception, match="only one class"):
        H.evaluate(df, "s", "y")["summary"].collect()
    with pytest.raises(ValueError):
        C.require_columns(df, ["barcode"])
    with pytest.raises(ValueError):
        FeatureConfig(kmer=True, kmer_sequence="both")
    keyed = spark.createDataFrame([("a",)], "barcode string")
    with pytest.raises(Exception, match="no overlapping keys"):
        J.alignment_report(keyed, spark.createDataFrame([("b",)], "barcode string")).collect()


def test_equal_scores(spark):
    df = spark.createDataFrame([(i % 2, 0.5) for i in range(10)], "y int, s double")
    assert O.curve_areas(O.roc_points(df, "s", "y")).first()["auc_roc"] == 0.5
    assert H.find_threshold(df, "s", "y", "youden").count() == 1


def test_quadratic_fit(spark):
    x = np.arange(1000, 9000, 500.0)
    noise = np.random.default_rng(0).normal(0, 0.01, len(x))
    y = 0.5 + 3e-5 * x - 2e-9 * x * x + noise
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "size double, auc double")
    row = T.scaling_quadratic(df, "size", ["auc"]).first()
    design = np.stack([np.ones_like(x), x, x * x], axis=1)
    beta, residual, *_ = np.linalg.lstsq(design, y, rcond=None)
    error = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * residual[0] / (len(x) - 3))
    assert [row["intercept"], row["slope_linear"], row["coeff_quadratic"]] == pytest.approx(beta.tolist(), rel=1e-6)
    assert [row["t_linear"], row["t_quadratic"]] == pytest.approx((beta / error)[1:].tolist(), rel=1e-5)


def test_embedding_files_round_trip(spark, tmp_path):
    (tmp_path / "demo.ablang.emb.csv").write_text("BARCODE,0,1\n a ,0.5,1\nb,2,3\n")
    found = tables.discover_embeddings(spark, str(tmp_path), "demo").collect()
    assert [r["lm"] for r in found] == ["ablang"]
    rows = tables.read_embeddings(spark, str(tmp_path / "demo.ablang.emb.csv"), "ablang").orderBy("barcode").collect()
    assert [(r["barcode"], r["embedding"]) for r in rows] == [("a", [0.5, 1.0]), ("b", [2.0, 3.0])]
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")


def test_feature_builder_order_and_truncation(spark):
    df = spark.createDataFrame([("EVQL", "DI", "CAR")], "hseq string, lseq string, cdr3 string")
    builder = FeatureBuilder(FeatureConfig(kmer=True, onehot=True, kmer_k=(1,), features=("length",), max_lengths={"hcdr3": 2})).fit(df)
    assert builder.feature_names[0] == "1mer_A" and builder.feature_names[20] == "cdr3_length"
    assert builder.feature_names[21:] == [f"oh_hcdr3_{p}_{a}" for p in (1, 2) for a in "ACDEFGHIKLMNPQRSTVWY"]
    vector = builder.transform(df).first()["features"].toArray()
    assert len(vector) == 61 and vector[20] == 3 and vector[21:].sum() == 2


PLAIN = ["ensure_cdr3", "annotate_liabilities", "cdr3_mutants", "threshold_sweep", "kmer_frequencies", "position_counts",
         "levenshtein_pairs", "enrichment_labels", "class_property_summary"]


@pytest.mark.parametrize("name", PLAIN)
def test_plans_stay_in_the_engine(spark, name):
    plan = load_catalog().QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = load_catalog().QUERIES["confusion_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan and "toxic" not in plan


def test_model_beats_chance(spark):
    rng = random.Random(3)
    rows = [(f"b{i}", "CA" + ("R" * 4 if i % 2 else "D" * 4) + "".join(rng.choice("GSTY") for _ in range(6)), "EVQL", "DIQ", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "barcode string, cdr3 string, hseq string, lseq string, y int")
    model = M.DevelopabilityModel(FeatureConfig(features=("charge", "R", "D")), M.ModelConfig(trees=5, depth=3)).fit(df, "y")
    assert model.task == "classification"
    assert O.curve_areas(O.roc_points(model.score(df, "p"), "p", "y")).first()["auc_roc"] > 0.99
