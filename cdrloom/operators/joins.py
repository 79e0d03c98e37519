"""Joins between antibody, embedding, score and assay tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.text import barcode_key
from ..session import shared_folder


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(key, barcode_key(F.col(key)))


def align_embedding(df: DataFrame, embedding: DataFrame, key: str = "barcode") -> DataFrame:
    """Rows that have an embedding, with it."""
    return _keyed(df, key).join(_keyed(embedding, key), key)


def alignment_report(df: DataFrame, embedding: DataFrame, key: str = "barcode") -> DataFrame:
    """Matched and excluded rows; no overlap at all fails the job."""
    known = _keyed(embedding.select(key), key).distinct().withColumn("_hit", F.lit(True))
    counts = _keyed(df.select(key), key).join(known, key, "left").agg(
        F.count("*").alias("n"), F.count("_hit").alias("matched")
    )
    matched = F.when(F.col("matched") == 0, F.raise_error(F.lit("no overlapping keys")).cast("long")).otherwise(
        F.col("matched")
    )
    return counts.select("n", matched.alias("matched"), (F.col("n") - F.col("matched")).alias("excluded"),
                         ((F.col("n") - F.col("matched")) / F.col("n")).alias("excluded_share"))


def split_embedding(embedding: DataFrame, train_keys: DataFrame, val_keys: DataFrame,
                    key: str = "barcode") -> tuple[DataFrame, DataFrame]:
    """Embedding rows of each side of a split."""
    table = _keyed(embedding, key)
    side = lambda keys: table.join(_keyed(keys.select(key), key), key, "left_semi")
    return side(train_keys), side(val_keys)


def split_embedding_counts(embedding: DataFrame, train_keys: DataFrame, val_keys: DataFrame,
                           key: str = "barcode") -> DataFrame:
    """Found and missing keys per side."""
    sides = _keyed(train_keys.select(key), key).distinct().withColumn("side", F.lit("train")).unionByName(
        _keyed(val_keys.select(key), key).distinct().withColumn("side", F.lit("val"))
    )
    known = _keyed(embedding.select(key), key).distinct().withColumn("_hit", F.lit(True))
    return sides.join(known, key, "left").groupBy("side").agg(
        F.count("_hit").alias("found"), F.count_if(F.col("_hit").isNull()).alias("missing")
    )


def multi_model_scores(base: DataFrame, scorers: dict[str, Callable[[], DataFrame]],
                       threshold: dict[str, float] | None = None, key: str = "barcode"
                       ) -> tuple[DataFrame, dict[str, str]]:
    """Score and label columns of several models on one base table.

    Each scorer returns (key, score).  Its scores are written once, so a model
    that fails while it scores, as well as one whose plan cannot be built, is
    left out and named in the second result.  Scores are stacked and pivoted,
    so any number of models costs one shuffle plus one join; of several scores
    of a key the highest counts.
    """
    parts, failed = [], {}
    folder = shared_folder(base.sparkSession, "scores")  # a session without a folder fails here, not as a broken model
    for name, make in scorers.items():
        try:
            make().select(key, "score").write.parquet(f"{folder}/{len(parts)}-{len(failed)}")
        except Exception as error:  # a broken model must not stop the others
            failed[name] = str(error)
            continue
        scored = base.sparkSession.read.parquet(f"{folder}/{len(parts)}-{len(failed)}")
        cut = (threshold or {}).get(name, 0.5)
        parts.append(scored.select(key, F.lit(name).alias("model"), "score",
                                   (F.col("score") >= cut).cast("int").alias("label")))
    if not parts:
        return base, failed
    long = reduce(DataFrame.unionByName, parts)
    names = [n for n in scorers if n not in failed]
    wide = long.groupBy(key).pivot("model", names).agg(F.max("score").alias("score"), F.max("label").alias("label"))
    wide = wide.select(key, *wide.columns[1:], *[F.col(f"{n}_label").alias(f"{n}_optimallabel") for n in names])
    return base.join(wide, key, "left"), failed


def merge_score_files(tables: list[DataFrame], key: str = "barcode") -> DataFrame:
    """Full outer join on the key adding new columns; row union if a key is missing."""
    if not all(key in t.columns for t in tables):
        return concat_rows(tables)
    merged = tables[0]
    for other in tables[1:]:
        fresh = [c for c in other.columns if c == key or c not in merged.columns]
        merged = merged.join(other.select(*fresh), key, "outer")
    return merged


def exclude_ids(df: DataFrame, excluded: DataFrame, key: str = "barcode") -> DataFrame:
    return df.join(excluded.select(key).distinct(), key, "left_anti")


# --- set operations -------------------------------------------------------

def union_distinct(columns: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, columns).distinct()


def common_keys(a: DataFrame, b: DataFrame, key: str = "barcode") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def concat_rows(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)


# --- comparing two tables -------------------------------------------------

def compare_tables(left: DataFrame, right: DataFrame, key: str = "barcode") -> DataFrame:
    """Chain equality on shared keys, swapped chains, and a verdict."""
    norm = lambda t, tag: _keyed(t, key).select(key, *[
        F.upper(F.trim(F.col(c))).alias(f"{c}_{tag}") for c in ("hseq", "lseq", "cdr3")
    ])
    both = norm(left, "a").join(norm(right, "b"), key)
    same = lambda x, y: F.count_if(F.col(x) == F.col(y))
    counts = both.agg(
        F.count("*").alias("n_shared"), same("hseq_a", "hseq_b").alias("hseq_match"),
        same("lseq_a", "lseq_b").alias("lseq_match"), same("cdr3_a", "cdr3_b").alias("cdr3_match"),
        F.count_if((F.col("hseq_a") == F.col("lseq_b")) & (F.col("lseq_a") == F.col("hseq_b"))).alias("swapped"),
    )
    n = F.col("n_shared")
    verdict = (
        F.when(n == 0, "no shared keys")
        .when((F.col("hseq_match") == 0) & (F.col("swapped") == n), "chains swapped")
        .when((F.col("hseq_match") == n) & (F.col("cdr3_match") < n), "cdr3 differs")
        .when((F.col("hseq_match") == 0) & (F.col("swapped") == 0), "different sequences")
        .when(F.col("hseq_match") == n, "identical").otherwise("mixed")
    )
    return counts.withColumn("verdict", verdict)


def overlap_scores(left: DataFrame, right: DataFrame, score: str, key: str = "barcode", tolerance: float = 0.1) -> DataFrame:
    """Mean score of shared keys in each table and whether they drift apart."""
    both = _keyed(left.select(key, F.col(score).alias("a")), key).join(
        _keyed(right.select(key, F.col(score).alias("b")), key), key
    )
    means = both.agg(F.count("*").alias("n_shared"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    gap = F.abs(F.col("mean_a") - F.col("mean_b"))
    return means.select("*", gap.alias("gap"), (gap > tolerance).alias("drift"))


def length_qc(tables: dict[str, DataFrame], max_len: int = 25) -> DataFrame:
    """CDR3 lengths and missing light chains, one row per table."""
    parts = []
    for name, df in tables.items():
        n, light = F.length(F.coalesce("cdr3", F.lit("nan"))), F.coalesce(F.col("lseq"), F.lit("nan"))
        parts.append(df.agg(
            F.count("*").alias("n"), F.min(n).alias("min_len"), F.avg(n).alias("mean_len"), F.max(n).alias("max_len"),
            F.avg((n > max_len).cast("int")).alias("long_share"),
            F.avg(F.length(light)).alias("mean_lseq"),
            F.avg((light == "").cast("int")).alias("empty_lseq_share"),
            F.avg((light == "nan").cast("int")).alias("nan_lseq_share"),
        ).withColumn("table", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def calibration_probe(df: DataFrame, score: str, label: str, order: str, threshold: float, n: int = 20) -> DataFrame:
    """Scores of the first ``n`` known rows of each class in an explicit order."""
    first = reduce(DataFrame.unionByName, [
        df.where(F.col(label) == y).orderBy(order).limit(n).select(F.lit(y).alias("class"), F.col(score).alias("s"))
        for y in (1, 0)
    ])
    return first.groupBy("class").agg(
        F.count("*").alias("n"), F.avg("s").alias("mean"), F.min("s").alias("min"), F.max("s").alias("max"),
        F.avg((F.col("s") >= threshold).cast("int")).alias("share_above"),
    )
