"""Correlations between scores and assays, pairwise or on complete rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import NOT_SCORE_PATTERNS, SCORE_PATTERNS
from ..functions.special import correlation_p_value
from ..functions.text import logit, stars
from ..session import cut_lineage
from .ordered import average_ranks, curve_areas, roc_points


def weighted_corr(x: Column, y: Column, w: Column) -> Column:
    """Correlation of weighted pairs, from deviations of a common scale."""
    n = F.sum(w)
    cov = F.sum(w * x * y) - F.sum(w * x) * F.sum(w * y) / n
    vx = F.sum(w * x * x) - F.sum(w * x) * F.sum(w * x) / n
    vy = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / n
    return F.try_divide(cov, F.sqrt(vx * vy))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Rank correlation with tie-averaged ranks and its p-value.

    Equal (x, y) pairs are merged before the ranks are joined back, so a hot
    value costs one row per distinct partner, and the merged pairs are written
    once, so the source is read once.  Ranks are scaled to (0, 1] and
    centred, which keeps the sums exact enough for billions of rows.
    """
    by = list(by or [])
    known = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).na.drop(
        subset=["_x", "_y"]
    )
    pairs = cut_lineage(known.groupBy(*by, "_x", "_y").agg(F.count("*").alias("w")))
    rx = average_ranks(pairs, "_x", by, "w").select(*by, "_x", F.col("avg_rank").alias("rx"))
    ry = average_ranks(pairs, "_y", by, "w").select(*by, "_y", F.col("avg_rank").alias("ry"))
    ranked = pairs.join(rx, [*by, "_x"]).join(ry, [*by, "_y"])
    sizes = pairs.groupBy(*by).agg(F.sum("w").alias("_n"))
    if by:
        ranked = ranked.join(sizes, by)
        n = F.col("_n")
    else:
        n = sizes.scalar()
    u = F.col("rx") / n - 0.5
    v = F.col("ry") / n - 0.5
    out = ranked.select(*by, u.alias("u"), v.alias("v"), "w").groupBy(*by).agg(
        F.sum("w").alias("n"), weighted_corr(F.col("u"), F.col("v"), F.col("w")).alias("spearman")
    )
    return out.withColumn("spearman_p", correlation_p_value(F.col("spearman"), F.col("n")))


def pearson(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = known.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"))
    return out.withColumn("pearson_p", correlation_p_value(F.col("pearson"), F.col("n")))


def is_score_name(col: str) -> bool:
    """A score column of one of the known models (not an assay)."""
    return col.endswith("_score") and col.startswith(("rf_", "transformer_", "xgboost_", "cnn_"))


def score_prefix(col: str) -> str | None:
    """Model tag of a column name, None if the name is no score."""
    name = col.lower()
    if any(re.search(p, name) for p in NOT_SCORE_PATTERNS):
        return None
    return next((tag for tag, p in SCORE_PATTERNS if re.search(p, name)), None)


def detect_score_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Score columns by name and range: numeric, within [-0.01, 1.01].

    Names are decided from the schema; the ranges of all candidates come from
    one aggregate.
    """
    named = [(c, tag) for c in df.columns if (tag := score_prefix(c))]
    if not named:
        return []
    number = {c: F.col(f"`{c}`").try_cast("double") for c, _ in named}
    row = df.agg(*[f(v).alias(f"{k}{i}") for i, (c, _) in enumerate(named)
                   for k, f, v in (("lo", F.min, number[c]), ("hi", F.max, number[c]))]).first()
    return [(c, tag) for i, (c, tag) in enumerate(named)
            if row[f"lo{i}"] is not None and row[f"lo{i}"] >= -0.01 and row[f"hi{i}"] <= 1.01]


def resolve_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Columns by exact name, else by name without case; unknown ones are left out."""
    lower = {}
    for c in df.columns:
        lower.setdefault(c.lower(), c)
    found = [c if c in df.columns else lower.get(c.lower()) for c in wanted]
    return [c for c in found if c]


def score_assay_pairs(df: DataFrame, scores: list[str], assays: list[str], logit_scores: bool = False) -> DataFrame:
    """Long (score_col, assay_col, x, y), pairwise complete."""
    pairs = []
    for s in scores:
        x = F.col(s).try_cast("double")
        x = logit(x) if logit_scores else x
        pairs += [
            F.struct(F.lit(s).alias("score_col"), F.lit(a).alias("assay_col"), x.alias("x"),
                     F.col(a).try_cast("double").alias("y"))
            for a in assays if a != s and not is_score_name(a)
        ]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").na.drop()


def score_assay_correlations(df: DataFrame, scores: list[str], assays: list[str],
                             logit_scores: bool = False, min_rows: int = 5) -> DataFrame:
    """Both correlations with p-values for every score and assay."""
    by = ["score_col", "assay_col"]
    long = score_assay_pairs(df, scores, assays, logit_scores)
    linear = pearson(long, "x", "y", by)
    ranks = spearman(long, "x", "y", by).select(*by, "spearman", "spearman_p")
    return linear.join(ranks, by).where(F.col("n") >= min_rows).select(
        *by, "n", F.col("spearman").alias("spearman_rho"), "spearman_p",
        stars(F.col("spearman_p")).alias("significance"),
        F.col("pearson").alias("pearson_r"), "pearson_p",
    )


def correlations_over_files(files: dict[str, DataFrame], assays: list[str], logit_scores: bool = False) -> DataFrame:
    """Score/assay correlations of several tables; a score seen before is skipped."""
    seen: set[str] = set()
    parts = []
    for name, df in files.items():
        here = resolve_columns(df, assays)
        fresh = [(c, tag) for c, tag in detect_score_columns(df) if c not in seen] if here else []
        for score, tag in fresh:
            complete = df.select(score, *[a for a in here if a != score]).na.drop()
            seen.add(score)
            parts.append(
                score_assay_correlations(complete, [score], here, logit_scores)
                .withColumn("file", F.lit(name)).withColumn("model", F.lit(tag))
            )
    if not parts:
        raise ValueError("no score column next to the requested assays")
    return reduce(DataFrame.unionByName, parts)


def correlation_matrix(df: DataFrame, cols: list[str], method: str = "spearman") -> DataFrame:
    """Long square matrix on rows that are complete in all columns."""
    numeric = df.select(*[F.col(c).try_cast("double").alias(c) for c in cols]).na.drop()
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if method == "spearman":
        numeric = cut_lineage(numeric.groupBy(*cols).agg(F.count("*").alias("_w")))
        size = numeric.agg(F.sum("_w").alias("_n")).scalar()
        ranked = numeric
        for c in cols:  # every column is ranked once
            ranks = average_ranks(numeric, c, weight="_w").select(c, (F.col("avg_rank") / size - 0.5).alias(f"_r_{c}"))
            ranked = ranked.join(ranks, c)
        cells = [weighted_corr(F.col(f"_r_{a}"), F.col(f"_r_{b}"), F.col("_w")) for a, b in pairs]
        one = ranked.agg(F.sum("_w").alias("n"), F.array(*cells).alias("r"))
    else:
        one = numeric.agg(F.count("*").alias("n"), F.array(*[F.corr(a, b) for a, b in pairs]).alias("r"))
    names = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b")) for a, b in pairs])
    upper = one.select("n", F.explode(F.arrays_zip(names.alias("p"), F.col("r"))).alias("c")).select("c.p.*", "c.r", "n")
    # mirror and diagonal come from the few rows of the upper triangle
    cells = F.array(
        F.struct("col_a", "col_b", "r"),
        F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), F.col("r")),
        F.struct(F.col("col_a"), F.col("col_a").alias("col_b"), F.lit(1.0).alias("r")),
        F.struct(F.col("col_b").alias("col_a"), F.col("col_b"), F.lit(1.0).alias("r")),
    )
    return upper.select(F.explode(cells).alias("c"), "n").select("c.*", "n").distinct()


def guarded_auc(df: DataFrame, score: str, assay: str, cutoff: float = 0.27, min_class: int = 5,
                by: list[str] | None = None) -> DataFrame:
    """AUC of a score against ``assay < cutoff``; null if a class is too small."""
    by = list(by or [])
    known = df.where(F.col(score).isNotNull() & F.col(assay).isNotNull()).withColumn(
        "_y", (F.col(assay) < cutoff).cast("int")
    )
    areas = curve_areas(roc_points(known, score, "_y", by), by)
    enough = (F.col("n_pos") >= min_class) & (F.col("n_neg") >= min_class)
    return areas.select(*by, F.when(enough, F.col("auc_roc")).alias("auc"), "n_pos", "n_neg")


def guarded_rho(df: DataFrame, score: str, assay: str, min_rows: int = 5, by: list[str] | None = None) -> DataFrame:
    rho = spearman(df, score, assay, by)
    return rho.select(*(by or []), "n", F.when(F.col("n") >= min_rows, F.col("spearman")).alias("rho"))


def external_matrix(df: DataFrame, scores: list[str], assays: list[str], cutoff: float = 0.27,
                    min_class: int = 5) -> DataFrame:
    """Model x assay grid of AUC and rank correlation."""
    by = ["score_col", "assay_col"]
    long = score_assay_pairs(df, scores, assays)
    auc = guarded_auc(long, "x", "y", cutoff, min_class, by).select(*by, "auc")
    rho = guarded_rho(long, "x", "y", by=by)
    return auc.join(rho, by)
