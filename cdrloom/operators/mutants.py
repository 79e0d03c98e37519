"""Single-residue scans of the CDR3 loop, in bulk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import AMINO_ACIDS
from ..session import dealt


def mutants(df: DataFrame, key: str = "barcode", cdr3: str = "cdr3", hseq: str = "hseq") -> DataFrame:
    """All position x residue substitutions, the wild type residue included.

    The changed loop replaces the first occurrence of the loop in the heavy
    chain; a heavy chain without the loop stays as it is.
    """
    return _substituted(df, F.array(*[F.lit(x) for x in AMINO_ACIDS]), cdr3, hseq)


def _substituted(df: DataFrame, residues: Column, cdr3: str = "cdr3", hseq: str = "hseq") -> DataFrame:
    """A row per position and residue; ``residues`` is an array that may refer to ``_loop`` and ``pos``.

    The changed loop comes out of the explode: as a later column it would be
    made again wherever a score refers to it.  The outer form keeps the
    optimizer from filtering on (and so recomputing) the array.
    """
    loop = F.upper(F.coalesce(F.col(cdr3), F.lit("")))
    base = df.withColumn("_loop", loop).where(F.length("_loop") > 0)
    base = base.withColumn("_at", F.instr(F.coalesce(F.col(hseq), F.lit("")), F.col("_loop")))
    rows = base.withColumn("pos", F.explode(F.sequence(F.lit(1), F.length("_loop"))))
    made = F.transform(residues, lambda x: F.struct(x.alias("mut"), F.overlay(F.col("_loop"), x, F.col("pos"), F.lit(1)).alias("changed")))
    rows = rows.withColumn("_made", F.explode_outer(made)).withColumn("mut", F.col("_made.mut"))
    changed = F.col("_made.changed")
    spliced = F.when(F.col("_at") > 0, F.overlay(F.col(hseq), changed, F.col("_at"), F.length("_loop"))).otherwise(F.col(hseq))
    return rows.withColumns({
        "wt": F.substring(F.col("_loop"), F.col("pos"), F.lit(1)), "_changed": changed, "_spliced": spliced,
    }).withColumns({cdr3: F.col("_changed"), hseq: F.col("_spliced")}).drop("_loop", "_at", "_made", "_changed", "_spliced")


def scan(df: DataFrame, score: Callable[[DataFrame], DataFrame], key: str = "barcode") -> DataFrame:
    """Long (key, pos, wt, mut, score, delta) from one bulk scoring of all mutants.

    ``score`` adds a ``score`` column and keeps the others.  The wild type rows
    of an antibody are its parent; a mutant that cannot be scored takes the
    parent's score.  Parents are scored first and joined to the antibodies, so
    that no mutant is shuffled.
    """
    wild = _substituted(df, F.array(F.substring(F.col("_loop"), F.col("pos"), F.lit(1)))).where(F.col("mut").isin(*AMINO_ACIDS))
    parent = score(wild).groupBy(key).agg(F.max("score").alias("_parent"))
    scored = score(mutants(dealt(df, key).join(parent, key, "left"), key))
    # out of an explode again, or each use of the score would compute it
    once = F.explode_outer(F.array(F.coalesce("score", "_parent"))).alias("score")
    scored = scored.select(key, "pos", "wt", "mut", once, "_parent")
    return scored.select(key, "pos", "wt", "mut", "score", (F.col("score") - F.col("_parent")).alias("delta"))


def scan_summary(scanned: DataFrame, key: str = "barcode", flat: float = 0.01) -> DataFrame:
    """Range, flatness, best and worst substitution per antibody."""
    step = F.struct("delta", "pos", "mut")
    return scanned.groupBy(key).agg(
        F.count("*").alias("n"), (F.max("score") - F.min("score")).alias("range"),
        ((F.max("score") - F.min("score")) < flat).alias("flat"),
        F.max(F.struct(F.col("delta"), -F.col("pos"), F.col("mut"))).alias("_best"),
        F.min(step).alias("_worst"),
    ).select(
        key, "n", "range", "flat", F.col("_best.delta").alias("best_delta"), F.col("_best.mut").alias("best_mut"),
        F.col("_worst.delta").alias("worst_delta"), F.col("_worst.pos").alias("worst_pos"), F.col("_worst.mut").alias("worst_mut"),
    )


def scan_matrix(scanned: DataFrame, key: str = "barcode", value: str = "score") -> DataFrame:
    """One row per antibody and residue, one column per loop position present."""
    last = scanned.agg(F.max("pos")).first()[0] or 0
    # a column per position in one aggregate; a pivot would group by position as well and move every mutant
    at = lambda i: F.max(F.when(F.col("pos") == i, F.col(value))).alias(str(i))
    return scanned.groupBy(key, "mut").agg(*[at(i) for i in range(1, last + 1)])
