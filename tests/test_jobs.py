import random
from itertools import count

import pytest

from cdrloom.plans import jobs

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Antibodies of 40 loop families whose class shows in the loop, with embeddings and clones."""
    root = tmp_path_factory.mktemp("jobs")
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    rows, vectors, clones = [], [], []
    for i in range(160):
        good = i % 2
        loop = word(6) + ("DED" if good else "RKR") + word(3)
        rows.append((f"ab-{i}", word(96) + "C" + loop + "WGQG" + word(11), word(107), loop, good))
        vectors.append((f"ab-{i}", *[rng.gauss(good, 0.5) for _ in range(4)]))
        clones.append((f"ab-{i}", loop, rng.randint(0, 9), rng.randint(0, 40) if good else 0))
    spark.createDataFrame(rows, "BARCODE string, HSEQ string, LSEQ string, CDR3 string, psr_filter int").write.parquet(f"{root}/ab.parquet")
    spark.createDataFrame(vectors, "BARCODE string, `0` double, `1` double, `2` double, `3` double").write.option("header", True).csv(f"{root}/db.lm.emb.csv")
    spark.createDataFrame(clones, "barcode string, cdr3 string, macs long, facs1 long").write.parquet(f"{root}/clones.parquet")
    return str(root)


RUNS = count()


def run(folder, verb, *options, source="ab.parquet"):
    out = f"{folder}/{verb}-{next(RUNS)}"
    jobs.main([verb, "--input", f"{folder}/{source}", "--output", out, "--registry", f"{folder}/registry", *options])
    return out


def test_train_search_and_score_with_all_models(spark, folder):
    run(folder, "train", "--model", "logistic_l1", "--lm", "kmer")
    run(folder, "train", "--model", "gradient_boosting", "--lm", "lm", "--embeddings", f"{folder}/db.lm.emb.csv", "--early-stopping")
    found = run(folder, "search", "--space", '{"maxDepth": [2, 3], "numTrees": {"low": 5, "high": 5}, "minInfoGain": {"low": 0.0, "high": 0.01}}', "--draws", "2", "--cutoff", "0.9")
    assert spark.read.parquet(found).count() == 2
    plain = spark.read.parquet(run(folder, "score", "--model", "all"))
    assert {"logistic_l1_kmer_db_score", "random_forest_biophysical_db_label"} <= set(plain.columns) and plain.count() == 160
    assert not [c for c in plain.columns if c.startswith("gradient_boosting")]
    both = spark.read.parquet(run(folder, "score", "--model", "all", "--embeddings", f"{folder}/db.lm.emb.csv"))
    assert "gradient_boosting_lm_db_score" in both.columns and both.count() == 160
    right = both.where("(gradient_boosting_lm_db_score >= 0.5) = (psr_filter = 1)").count()
    assert right > 120
    assert spark.read.parquet(run(folder, "importance", "--model", "random_forest")).count() > 5
    shapley = run(folder, "importance", "--model", "random_forest", "--method", "shapley")
    assert spark.read.parquet(f"{shapley}/attributions").select("barcode").distinct().count() == 160
    assert spark.read.parquet(f"{shapley}/ranking").count() > 1  # only features that small trees split on
    assert spark.read.parquet(run(folder, "scan", "--lm", "kmer", "--model", "logistic_l1", "--first", "2") + "/summary").count() == 2


@pytest.mark.parametrize("options", [("--mode", "one_class"), ("--blosum", "--metric", "blosum", "--mode", "binary_strong")])
def test_expand_modes(spark, folder, options):
    out = run(folder, "expand", *options, source="clones.parquet")
    scored = spark.read.parquet(f"{out}/scored")
    assert scored.count() == 160 and scored.where("score is null").isEmpty()
    files = spark.read.parquet(f"{out}/previous_files")
    assert files.count() == 0
    out = run(folder, "expand", *options, "--previous", f"{folder}/clones.parquet", f"{folder}/absent.csv", source="clones.parquet")
    files = {r["status"]: r for r in spark.read.parquet(f"{out}/previous_files").collect()}
    assert set(files) == {"read", "unreadable"} and spark.read.parquet(f"{out}/leads").count() == 0


def test_the_other_verbs_write_their_tables(spark, folder):
    assert spark.read.parquet(run(folder, "annotate") + "/annotated").count() == 160
    assert spark.read.parquet(run(folder, "split", "--cutoff", "0.9")).count() == 160
    done = run(folder, "crossval", "--kfold", "2", "--cutoff", "0.9", "--model", "logistic_l1", "--lm", "kmer")
    assert spark.read.parquet(f"{done}/folds").count() == 160 and spark.read.parquet(f"{done}/metrics").count() == 2
    assert spark.read.parquet(run(folder, "curve", "--sizes", "80", "--cutoff", "0.9", "--model", "logistic_l1", "--lm", "kmer")).count() == 1
