"""End-to-end jobs: annotate, split, cross-validate, train, score, evaluate, correlate, expand.

``spark-submit cdrloom/plans/jobs.py <verb> --input ... --output ...``
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from cdrloom.constants import NULL_LIKE_SHEET
from cdrloom.models.anomaly import one_class_score
from cdrloom.models.explain import attribution_ranking, permutation_importance
from cdrloom.models.registry import Registry
from cdrloom.models.tree_shap import tree_attributions
from cdrloom.models.training import (
    DevelopabilityModel, ModelConfig, cross_validate, sample_size_curve, scored, search_and_fit, with_class_weight,
)
from cdrloom.models.training import estimator
from cdrloom.operators import annotation, cleaning, clustering, correlation, features, joins, ngs, splits, statistics, thresholds
from cdrloom.operators.mutants import scan, scan_matrix, scan_summary
from cdrloom.session import cut_lineage
from cdrloom.sources import tables


def prepare(df: DataFrame) -> DataFrame:
    """Clean keys and sequences, fill the loop, keep the leading cysteine."""
    out = cleaning.normalize_barcode(df)
    cols = [c for c in ("hseq", "lseq", "cdr3") if c in out.columns]
    return cleaning.fix_c_prefix(cleaning.ensure_cdr3(cleaning.clean_nulls(out, cols, NULL_LIKE_SHEET)))


def property_report(df: DataFrame, label: str) -> DataFrame:
    """Density histograms of eight properties per class, loops under 25 residues."""
    annotated = annotation.annotate_biophysical(cleaning.cdr3_shorter_than(df))
    return statistics.class_density(annotated, label, annotation.PROPERTY_PANELS, annotation.property_panel_filters())


def split(df: DataFrame, label: str, column: str = "CDR3", cutoff: float = 0.8, share: float = 0.8) -> DataFrame:
    """Cluster, hold out whole clusters, then place the unlabelled rows."""
    ordered = df.withColumn("_order", F.monotonically_increasing_id())
    clustered = clustering.cluster_by(cut_lineage(ordered), column, "_order", cutoff)
    group = clustered.columns[-1]
    clustered = cut_lineage(clustered.withColumnRenamed(group, "cluster").drop("_order"))
    sided = splits.group_holdout(clustered.where(F.col(label).isNotNull()), label, "cluster", "barcode", share)
    free = splits.assign_unlabelled(sided, clustered.where(F.col(label).isNull()), "cluster")
    return sided.unionByName(free)


def score_with(registry: Registry, df: DataFrame, target: str, lm: str, model: str, db: str | None = None,
               threshold: float | None = None, path: str | None = None) -> DataFrame:
    """Score and label with a stored model; columns carry model, lm and db."""
    row = registry.find(target, lm, model, db, path)
    stored = registry.load(row["path"], row["threshold"])
    stem = f"{model}_{lm}_{db or row['db']}"
    out = stored.score(df, f"{stem}_score")
    return thresholds.apply_threshold(out, f"{stem}_score", f"{stem}_label", threshold, stored.threshold, stored.task)


def score_with_all(registry: Registry, df: DataFrame, target: str) -> DataFrame:
    """Scores and labels of every stored model of a target that fits the columns of ``df``."""
    rows = [r for r in registry.newest(target) if r["lm"] in ("biophysical", "kmer", "onehot") or "embedding" in df.columns]
    if not rows:
        raise ValueError(f"no stored model for {target}")
    for r in rows:
        df = score_with(registry, df, target, r["lm"], r["model"], r["db"], path=r["path"])
    return df


def scan_antibodies(model: DevelopabilityModel, df: DataFrame) -> dict[str, DataFrame]:
    """Score every substitution; models on stored embeddings cannot score mutants."""
    if model.features.embedding:
        raise ValueError("mutants need fresh embeddings: embed them before scoring")
    scanned = cut_lineage(scan(df, lambda m: model.score(m, "score")))
    return {"scan": scanned, "summary": scan_summary(scanned), "matrix": scan_matrix(scanned)}


def expand_hits(clones: DataFrame, previous: DataFrame, mode: str = "binary_strong", use_blosum: bool = False,
                min_score: float = 0.8, min_cpm: float = 200.0, metric: str = "levenshtein", key: str = "barcode") -> DataFrame:
    """Label clones by enrichment, learn a k-mer model, pick diverse new leads."""
    labelled = ngs.enrichment_labels(clones)
    vectors = cut_lineage(features.kmer_l2_vectors(labelled, "cdr3", "features", use_blosum))
    if mode == "one_class":
        ranked = one_class_score(vectors, "features", key, "positive", "train")
    else:
        train = vectors.where("train").withColumn("label", F.col("positive").cast("double"))
        weighted = with_class_weight(train, "label").persist()
        config = ModelConfig("logistic_l1")
        model = estimator(config, "classification", "weight", rows=weighted.count()).fit(weighted)
        weighted.unpersist()
        ranked = scored(model, vectors, "classification", "score")
    return clustering.select_diverse_leads(
        ranked.drop("features"), previous, "score", key, min_score=min_score, min_cpm=min_cpm, metric=metric
    )


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cdrloom")
    parser.add_argument("verb", choices=["annotate", "split", "crossval", "train", "search", "score", "scan", "curve", "importance", "evaluate", "correlate", "expand"])
    parser.add_argument("--input", nargs="+", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--target", default="psr_filter")
    parser.add_argument("--test-target")
    parser.add_argument("--score-col")
    parser.add_argument("--assay", nargs="*", default=[])
    parser.add_argument("--previous", nargs="*", default=[])
    parser.add_argument("--model", default="random_forest", help="kind of model; score: 'all' takes every stored one")
    parser.add_argument("--lm", default="biophysical", help="biophysical, kmer, onehot, or the tag of stored embeddings")
    parser.add_argument("--embeddings", help="wide CSV (BARCODE, 0..d-1), or table of barcode and embedding")
    parser.add_argument("--early-stopping", action="store_true")
    parser.add_argument("--space", default="{}", help='search: JSON of parameter name to list of values or {"low", "high", "log"}')
    parser.add_argument("--draws", type=int, default=30)
    parser.add_argument("--sizes", type=int, nargs="*", default=[])
    parser.add_argument("--first", type=int, help="scan only the first antibodies, by barcode")
    parser.add_argument("--mode", default="binary_strong", choices=["binary_strong", "one_class"])
    parser.add_argument("--blosum", action="store_true", help="expand: features over similar letters")
    parser.add_argument("--metric", default="levenshtein", choices=["levenshtein", "blosum"])
    parser.add_argument("--method", default="permutation", choices=["permutation", "shapley"], help="importance: shapley is for trees")
    parser.add_argument("--db", default="db")
    parser.add_argument("--registry")
    parser.add_argument("--kfold", type=int, default=10)
    parser.add_argument("--threshold", type=float)
    parser.add_argument("--cluster-column", default="CDR3")
    parser.add_argument("--cutoff", type=float, default=0.8)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"cdrloom-{a.verb}").getOrCreate()
    out = a.output.rstrip("/")
    own = a.lm in ("biophysical", "kmer", "onehot")
    config = features.FeatureConfig(biophysical=a.lm == "biophysical", kmer=a.lm == "kmer", onehot=a.lm == "onehot", embedding=not own)
    model_config = ModelConfig(a.model, early_stopping=a.early_stopping)

    def read() -> DataFrame:
        """Prepared antibodies, with their embeddings if they are named."""
        df = prepare(tables.read_antibodies(spark, a.input[0]))
        if a.embeddings is None:
            return df
        wide = a.embeddings.endswith(".csv")
        found = tables.read_embeddings(spark, a.embeddings, a.lm) if wide else tables.read_table(spark, a.embeddings)
        return joins.align_embedding(df, found.select("barcode", "embedding"))

    def clustered() -> DataFrame:
        df = read().withColumn("_order", F.monotonically_increasing_id())
        out = clustering.cluster_by(cut_lineage(df), a.cluster_column, "_order", a.cutoff)
        return cut_lineage(out.withColumnRenamed(out.columns[-1], "cluster"))

    need = lambda: Registry(spark, a.registry or parser.error("--registry is required"))
    if a.verb == "annotate":
        df = read()
        tables.write_table(annotation.annotate_liabilities(annotation.annotate_biophysical(df), "cdr3"), f"{out}/annotated")
        if a.target in df.columns:
            tables.write_table(property_report(df, a.target), f"{out}/panels")
    elif a.verb == "split":
        tables.write_table(split(read(), a.target, a.cluster_column, a.cutoff), out, partition_by=["side"])
    elif a.verb == "crossval":
        done = cross_validate(clustered(), a.target, config, model_config, k=a.kfold)
        tables.write_fold_predictions(done["predictions"], f"{out}/folds")
        preds = spark.read.parquet(f"{out}/folds")
        tables.write_table(done["metrics"], f"{out}/metrics")
        tables.write_table(thresholds.threshold_report(preds, "prob", "true"), f"{out}/thresholds")
        tables.write_table(thresholds.threshold_stability(preds), f"{out}/stability")
    elif a.verb == "train":
        model = DevelopabilityModel(config, model_config).fit(read(), a.target)
        model.threshold = a.threshold
        need().save(model, a.target, a.lm, a.db)
    elif a.verb == "search":
        model, results = search_and_fit(clustered(), a.target, config, model_config, json.loads(a.space), a.draws, group="cluster")
        need().save(model, a.target, a.lm, a.db)
        rows = [(json.dumps(r.point), float(r.mean), len(r.scores), r.whole) for r in results]
        tables.write_table(spark.createDataFrame(rows, "parameters string, score double, folds int, whole boolean"), out)
    elif a.verb == "curve":
        tables.write_table(sample_size_curve(clustered(), a.target, a.sizes, config, model_config, "cluster"), out)
    elif a.verb == "importance":
        registry, df = need(), read()
        row = registry.find(a.target, a.lm, a.model, a.db)
        stored = registry.load(row["path"], row["threshold"])
        vectors = stored.builder.transform(df.where(F.col(a.target).isNotNull()))
        names, keep = stored.builder.feature_names, stored.builder.interpretable
        if a.method == "shapley":
            found = cut_lineage(tree_attributions(vectors, stored.model, names, "barcode"))
            tables.write_table(found, f"{out}/attributions")
            tables.write_table(attribution_ranking(found, "feature", "value"), f"{out}/ranking")
        else:
            tables.write_table(permutation_importance(vectors, stored.model, a.target, names, keep), out)
    elif a.verb == "score" and a.model == "all":
        tables.write_table(score_with_all(need(), read(), a.target), out)
    elif a.verb == "score":
        tables.write_table(score_with(need(), read(), a.target, a.lm, a.model, a.db, a.threshold), out)
    elif a.verb == "scan":
        registry = need()
        row = registry.find(a.target, a.lm, a.model, a.db)
        df = read() if a.first is None else read().orderBy("barcode").limit(a.first)
        for name, table in scan_antibodies(registry.load(row["path"], row["threshold"]), df).items():
            tables.write_table(table, f"{out}/{name}")
    elif a.verb == "evaluate":
        df = tables.read_table(spark, a.input[0])
        tables.write_evaluation(thresholds.evaluate(df, a.score_col, a.target, a.test_target), out)
    elif a.verb == "correlate":
        files = {p: tables.read_table(spark, p) for p in a.input}
        tables.write_table(correlation.correlations_over_files(files, a.assay), f"{out}/correlations")
        merged = joins.merge_score_files(list(files.values()))
        assays = correlation.resolve_columns(merged, a.assay)
        if len(assays) > 1:
            tables.write_table(correlation.correlation_matrix(merged, assays), f"{out}/matrix")
    elif a.verb == "expand":
        previous, manifest = tables.load_previous(spark, a.previous)
        tables.write_table(manifest, f"{out}/previous_files")
        leads = cut_lineage(expand_hits(tables.read_table(spark, a.input[0]), previous, a.mode, a.blosum, metric=a.metric))
        tables.write_table(leads, f"{out}/scored")
        tables.write_table(leads.where("selected"), f"{out}/leads")


if __name__ == "__main__":
    main()
