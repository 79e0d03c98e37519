"""Liability and property columns for a sequence column, one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import LIABILITY_MOTIFS
from ..functions import sequence as S
from .cleaning import strip_leading_c


def _motifs(seq: Column, prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{m}": S.motif_flag(seq, m) for m in LIABILITY_MOTIFS}


def _shared(seq: Column, prefix: str) -> dict[str, Column]:
    return {
        f"{prefix}_cys": S.unpaired_cysteine(seq),
        f"{prefix}_neg_charge": S.simple_charge(seq) < -4,
        f"{prefix}_pos_charge": S.simple_charge(seq) > 2,
        f"{prefix}_arg": S.residues(seq, "R") > 2,
        f"{prefix}_trp": S.residues(seq, "W") > 2,
        f"{prefix}_rmd": S.residues(seq, "R") - S.residues(seq, "D") > 1,
        f"{prefix}_isoelectricpoint": S.protein_pi(seq),
    }


def annotate_liabilities(df: DataFrame, column: str = "cdr3_aa") -> DataFrame:
    """``l_*`` columns: motifs, charges, hydrophilicity, counts, pI, mass."""
    seq = F.coalesce(F.col(column), F.lit(""))
    return df.withColumns({
        **_motifs(seq, "l"),
        **_shared(seq, "l"),
        "l_charge_value": S.simple_charge(seq),
        "l_charge_value2": S.simple_charge(seq, histidine=True),
        "l_hydrophobic": S.parker(seq) < -1,
        "l_hydrophobic_value": S.parker(seq),
        "l_molecular_weight": S.protein_mass(seq),
    })


def annotate_properties(df: DataFrame, column: str, label: str = "") -> DataFrame:
    """``{label}_*`` columns: motifs, charges and published protein parameters."""
    label = label or column
    seq = F.coalesce(F.col(column), F.lit(""))
    return df.withColumns({
        **_motifs(seq, label),
        **_shared(seq, label),
        f"{label}_simple_charge": S.simple_charge(seq),
        f"{label}_parker_hplc": S.parker(seq) < -1,
        f"{label}_parker_hplc_index": S.parker(seq),
        f"{label}_charge": S.protein_charge(seq),
        f"{label}_instability_index": S.protein_instability(seq),
        f"{label}_aromaticity": S.protein_aromaticity(seq),
        f"{label}_hydrophobicity": S.protein_gravy(seq),
        f"{label}_length": S.protein_length(seq),
    })


def residue_counts(df: DataFrame, cdr3: str = "cdr3") -> DataFrame:
    """R, D, E, W counts and length of the upper-cased loop."""
    loop = F.upper(F.coalesce(F.col(cdr3), F.lit("")))
    return df.withColumns({
        "R": S.residues(loop, "R"), "D": S.residues(loop, "D"), "E": S.residues(loop, "E"),
        "CDR3_W_count": S.residues(loop, "W"), "CDR3_len": F.length(loop),
    })


def annotate_biophysical(df: DataFrame, cdr3: str = "cdr3", hseq: str = "hseq", strip: str = "auto") -> DataFrame:
    """Properties of heavy chain (VH) and loop (HCDR3) plus residue counts."""
    out = strip_leading_c(df, cdr3, strip)
    return residue_counts(annotate_properties(annotate_properties(out, hseq, "VH"), cdr3, "HCDR3"), cdr3)


# (panel, column, kind) of the eight property panels; the tryptophan panel only
# looks at loops with exactly one arginine.
PROPERTY_PANELS = [
    ("arginine", "R", "unit"),
    ("aspartate", "D", "unit"),
    ("tryptophan", "CDR3_W_count", "unit"),
    ("glutamate", "E", "unit"),
    ("length", "CDR3_len", "unit"),
    ("charge", "HCDR3_charge", "unit"),
    ("loop_pi", "HCDR3_isoelectricpoint", "unit"),
    ("heavy_pi", "VH_isoelectricpoint", "edges_1_11"),
]


def property_panel_filters() -> dict[str, Column]:
    return {"tryptophan": F.col("R") == 1}
