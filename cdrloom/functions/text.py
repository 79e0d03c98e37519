"""Column expressions that clean keys, sequences, labels and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import CDR3_PATTERNS, NULL_LIKE


def barcode_key(col: Column) -> Column:
    """Join key: text without surrounding blanks."""
    return F.trim(col.cast("string"))


def null_like_to_empty(col: Column, spellings: tuple[str, ...] = NULL_LIKE) -> Column:
    """Empty string for null and for the usual spellings of a missing value."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.when(F.lower(F.trim(text)).isin(*spellings), F.lit("")).otherwise(text)


def cdr3_from_heavy_chain(hseq: Column) -> Column:
    """Loop between the last anchor pair of a heavy chain, '' if there is none."""
    cleaned = F.regexp_replace(F.upper(hseq), "[- ]", "")
    strict, relaxed = (
        F.try_element_at(F.regexp_extract_all(cleaned, F.lit(p), F.lit(1)), F.lit(-1))
        for p in CDR3_PATTERNS
    )
    long_enough = F.length(F.trim(hseq)) >= 20
    return F.coalesce(F.when(long_enough, F.coalesce(strict, relaxed)), F.lit(""))


def with_c_prefix(cdr3: Column) -> Column:
    """Prepend the conserved cysteine where a non-empty loop lacks it."""
    bare = (F.length(cdr3) > 0) & ~cdr3.startswith("C")
    return F.when(bare, F.concat(F.lit("C"), cdr3)).otherwise(cdr3)


def without_c_prefix(cdr3: Column) -> Column:
    return F.when(cdr3.startswith("C"), F.substring(cdr3, 2, 1 << 30)).otherwise(cdr3)


def hypervariable_loop(cdr3: Column) -> Column:
    """Loop without its CAR/C start and without a ``.D[YW]`` end."""
    cleaned = F.regexp_replace(F.upper(cdr3), "-", "")
    return F.regexp_replace(F.regexp_replace(cleaned, "^(CAR|C)", ""), ".D[YW]$", "")


def spr_label(annotation: Column) -> Column:
    """0 if the note says fail, else 1 for premium/strong/weak, else null."""
    return F.when(annotation.contains("fail"), 0).when(
        annotation.rlike("premium|strong|weak"), 1
    )


def label_text(label: Column) -> Column:
    value = label.cast("double")
    return F.when(value == 1, "PASS").when(value == 0, "FAIL").otherwise(label.cast("string"))


def below_cutoff(assay: Column, cutoff: float = 0.27) -> Column:
    """1.0 where the assay is below the cutoff; a missing assay counts as 0.0."""
    return F.coalesce(assay < cutoff, F.lit(False)).cast("double")


def logit(score: Column, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(score, F.lit(eps)), F.lit(1.0 - eps))
    return F.ln(p / (1.0 - p))


def number_or_null(col: Column) -> Column:
    return col.try_cast("double")


def number_or_zero(col: Column) -> Column:
    return F.coalesce(number_or_null(col), F.lit(0.0))


def stars(p_value: Column) -> Column:
    """Significance marks at .001, .01 and .05."""
    return (
        F.when(p_value < 0.001, "***").when(p_value < 0.01, "**")
        .when(p_value < 0.05, "*").otherwise("ns")
    )


def spaced(seq: Column) -> Column:
    """One blank between residues: the usual tokenizer input."""
    return F.trim(F.regexp_replace(seq, "(.)", "$1 "))


def paired_text(heavy: Column, light: Column, style: str) -> Column:
    """Model input for a chain pair: 'spaced', 'double_cls' or 'single_cls'."""
    if style == "spaced":
        return F.concat_ws(" ", spaced(heavy), spaced(light))
    if style == "double_cls":
        return F.concat(spaced(heavy), F.lit(" [CLS] [CLS] "), spaced(light))
    if style == "single_cls":
        return F.concat(spaced(heavy), F.lit(" [CLS] "), spaced(light))
    raise ValueError(f"unknown pair style: {style}")
