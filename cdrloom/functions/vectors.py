"""Array expressions: k-mers, one-hot tokens, pooling, prefix similarity."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, functions as F

from ..constants import AMINO_ACIDS, BLOSUM62, triangle
from .sequence import feature_text, letter_codes, pair_cell, pair_cells, windows


def kmer_vocabulary(k_list: list[int]) -> list[str]:
    """All k-mers of the 20 residues, shorter k first."""
    return ["".join(p) for k in k_list for p in product(AMINO_ACIDS, repeat=k)]


def kmer_tokens(seq: Column, k_list: list[int]) -> Column:
    return F.flatten(F.array(*[windows(seq, k) for k in k_list]))


def one_hot_tokens(seq: Column, max_len: int, prefix: str) -> Column:
    """``prefix_position_residue`` for each of the first ``max_len`` known residues."""
    text = F.substring(feature_text(seq), 1, max_len)
    marks = F.transform(
        windows(text, 1),
        lambda residue, i: F.when(
            F.position(residue, F.lit(AMINO_ACIDS)) > 0,
            F.concat_ws("_", F.lit(prefix), (i + 1).cast("string"), residue),
        ),
    )
    return F.array_compact(marks)


def one_hot_names(prefix: str, max_len: int) -> list[str]:
    return [f"{prefix}_{p}_{aa}" for p in range(1, max_len + 1) for aa in AMINO_ACIDS]


def masked_mean(vectors: Column, mask: Column, dim: int) -> Column:
    """Mean of the vectors whose mask is 1; token lists are short arrays in a row."""
    kept = F.transform(
        F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda t: t["m"] == 1),
        lambda t: t["v"],
    )
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(kept, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def average_chains(heavy: Column, light: Column) -> Column:
    """Element-wise mean of two chain vectors; the heavy one alone if no light."""
    both = F.zip_with(heavy, light, lambda h, l: (h + l) / 2)
    return F.when(light.isNull(), heavy).otherwise(both)


def _pairwise_blosum(a: Column, b: Column) -> Column:
    """BLOSUM62 sum over the positions both strings have."""
    n = F.least(F.length(a), F.length(b))
    cells = pair_cells(triangle(BLOSUM62), -4)
    head = lambda s: F.slice(letter_codes(s), F.lit(1), n)
    values = F.zip_with(head(a), head(b), lambda x, y: pair_cell(cells, x, y))
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def prefix_similarity(a: Column, b: Column) -> Column:
    """Mean BLOSUM62 over the shorter length, -10 if one string is empty."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, _pairwise_blosum(a, b) / n).otherwise(F.lit(-10.0))


def same_length_distance(a: Column, b: Column) -> Column:
    """``4 * length - BLOSUM62 sum``; unequal lengths fail the job."""
    equal = F.length(a) == F.length(b)
    return F.when(equal, F.length(a) * 4 - _pairwise_blosum(a, b)).otherwise(
        F.raise_error(F.lit("sequences must be of equal length")).cast("double")
    )
