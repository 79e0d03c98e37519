"""Row-level cleaning: keys, missing values, CDR3 repair, exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import NULL_LIKE, NULL_LIKE_SHEET
from ..functions import text as T
from ..session import cut_lineage
from .ordered import join_small, with_row_ids

ELISA = ("psr_norm_insulin", "psr_norm_dna", "psr_norm_smp", "psr_norm_avidin")


def normalize_barcode(df: DataFrame, column: str = "barcode") -> DataFrame:
    """Trimmed text key; consecutive numbers in scan order if there is none."""
    if column in df.columns:
        return df.withColumn(column, T.barcode_key(F.col(column)))
    return with_row_ids(cut_lineage(df), column).withColumn(column, F.col(column).cast("string"))


def clean_nulls(df: DataFrame, cols: list[str], spellings: tuple[str, ...] = NULL_LIKE) -> DataFrame:
    return df.withColumns({c: T.null_like_to_empty(F.col(c), spellings) for c in cols})


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail on a missing column; drop rows with a null in a required one."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.na.drop(subset=required)


def ensure_cdr3(df: DataFrame, cdr3: str = "cdr3", hseq: str = "hseq", method: str | None = None) -> DataFrame:
    """Fill empty CDR3 values from the heavy chain; ``method`` names a how-column."""
    if hseq not in df.columns:
        return df
    given = T.null_like_to_empty(F.col(cdr3)) if cdr3 in df.columns else F.lit("")
    marked = df.withColumn("_given", given)
    found = T.cdr3_from_heavy_chain(F.col(hseq))
    out = marked.withColumn(cdr3, F.when(F.col("_given") == "", found).otherwise(F.col("_given")))
    if method:
        how = F.when(F.col("_given") != "", "given").when(F.col(cdr3) != "", "extracted").otherwise("failed")
        out = out.withColumn(method, how)
    return out.drop("_given")


def cdr3_fill_counts(df: DataFrame, cdr3: str = "cdr3", hseq: str = "hseq") -> DataFrame:
    """How many rows had, got or still lack a CDR3."""
    return ensure_cdr3(df, cdr3, hseq, "method").groupBy("method").agg(F.count("*").alias("n"))


def fix_c_prefix(df: DataFrame, cdr3: str = "cdr3") -> DataFrame:
    return df.withColumn(cdr3, T.with_c_prefix(F.col(cdr3))) if cdr3 in df.columns else df


def strip_leading_c(df: DataFrame, cdr3: str = "cdr3", mode: str = "auto", share: float = 0.9) -> DataFrame:
    """Drop the leading cysteine: always, or only if most rows carry one."""
    stripped = T.without_c_prefix(F.col(cdr3))
    if mode == "always":
        return df.withColumn(cdr3, stripped)
    starts = F.coalesce(F.col(cdr3).startswith("C"), F.lit(False))
    common = df.agg(F.avg(starts.cast("int")).alias("_share"))
    wide = join_small(df, common, [])
    return wide.withColumn(cdr3, F.when(F.col("_share") > share, stripped).otherwise(F.col(cdr3))).drop("_share")


def one_hot_ready(df: DataFrame, hseq: str = "hseq", lseq: str = "lseq", cdr3: str = "cdr3") -> DataFrame:
    """Clean the sequence columns and keep rows with at least five heavy residues."""
    cols = [c for c in (hseq, lseq, cdr3) if c in df.columns]
    return clean_nulls(df, cols, NULL_LIKE_SHEET).where(F.length(F.trim(F.col(hseq))) >= 5)


def one_hot_ready_report(df: DataFrame, hseq: str = "hseq", lseq: str = "lseq") -> DataFrame:
    clean = clean_nulls(df, [hseq, lseq], NULL_LIKE_SHEET)
    short = F.length(F.trim(F.col(hseq))) < 5
    return clean.agg(
        F.count("*").alias("n"), F.count_if(F.col(lseq) == "").alias("empty_lseq"),
        F.count_if(short).alias("dropped"), F.count_if(~short).alias("kept"),
    )


def denoise_elisa(df: DataFrame, assays: tuple[str, ...] = ELISA, label: str = "psr_filter",
                  predicted: str = "psr_rf_elisa", antigen: str = "antigen", batch: str = "id2",
                  min_batch: int = 8700) -> DataFrame:
    """High-confidence assay rows: complete, label confirmed, no test antigen, late batch."""
    test = F.coalesce(F.col(antigen).rlike("(?i)test"), F.lit(False))
    return df.na.drop(subset=[*assays, label]).where(
        (F.col(label) == F.col(predicted)) & ~test & (F.col(batch) > min_batch)
    )


def trainset_exclusions(df: DataFrame, charge: str = "charge2", label: str = "psr_filter", mean: str = "psr_mean",
                        insulin: str = "psr_norm_insulin", key: str = "barcode", batch: str = "id2",
                        min_batch: int = 8763) -> DataFrame:
    """Drop every row of a key that breaks one of three plausibility rules.

    A rule sees only rows the earlier rules left, but a key struck by any rule
    goes as a whole, so one pass of keys suffices when keys are unique; repeated
    keys are handled by striking keys, not rows.
    """
    q, y = F.col(charge), F.col(label)
    rules = [
        (q > 2) & (y == 1),
        (q < 0) & (y == 0) & (F.col(mean) < 1),
        (y == 1) & (F.col(insulin) > 0.3) & (q > 1),
    ]
    struck = df.where(rules[0] | rules[1] | rules[2]).select(key).distinct()
    return df.join(struck, key, "left_anti").where(F.col(batch) > min_batch)


def with_assay_mean(df: DataFrame, assays: tuple[str, ...] = ELISA, name: str = "psr_mean") -> DataFrame:
    """Rows with all assays, and their mean."""
    total = sum((F.col(a) for a in assays[1:]), F.col(assays[0]))
    return df.na.drop(subset=list(assays)).withColumn(name, total / len(assays))


def cdr3_shorter_than(df: DataFrame, cdr3: str = "cdr3", limit: int = 25) -> DataFrame:
    return df.where(F.length(F.col(cdr3)) < limit)


def detect_task(df: DataFrame, target: str) -> DataFrame:
    """'classification' for at most two values out of {0, 1}, else 'regression'."""
    y = F.col(target).cast("double")
    # min/max of the values settles "at most two" once all of them are 0 or 1
    return df.where(y.isNotNull()).agg(
        F.when(F.bool_and(y.isin(0.0, 1.0)), "classification").otherwise("regression").alias("task"),
        F.count("*").alias("n"),
    )


def validate_dataset(df: DataFrame, label: str, embedding_dim: int, kfold: bool = True) -> DataFrame:
    """Size, minority, safe fold count and warnings; one class or n < 2 is fatal."""
    n, minority = F.col("n"), F.least("n1", "n0")
    by_size = F.when(n < 500, 3).when(n < 1000, 5).otherwise(10)
    safe = F.greatest(F.lit(2), F.least(by_size, minority, F.floor(n / 2)))
    stats = df.where(F.col(label).isNotNull()).agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")
    )
    fatal = F.when(n < 2, "fewer than 2 samples").when(minority == 0, "only one class")
    checked = F.when(fatal.isNotNull(), F.raise_error(fatal).cast("long")).otherwise(n)
    out = stats.select(
        checked.alias("n"), minority.alias("min_class"), (minority / n).alias("min_rate"),
        F.least(n, F.lit(256)).alias("safe_batch"),
        (safe if kfold else F.lit(None)).cast("int").alias("safe_kfold"),
        (n < 100).alias("warn_small"),
        (F.lit(kfold) & (minority / n < 0.05)).alias("warn_imbalance"),
        (F.lit(kfold) & (safe < 5)).alias("warn_few_folds"),
        (F.lit(embedding_dim > 512) & (n < 500)).alias("warn_wide_embedding"),
    )
    return out
