import math

import pytest
from pyspark.sql import functions as F

from cdrloom import constants as K
from cdrloom.functions import alignment as A, sequence as S, special, text as T, vectors as V


def one(spark, value, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
    return row.select(value.alias("v")).first()["v"]


def test_tables_are_complete():
    assert len(K.triangle(K.BLOSUM62)) == len(K.triangle(K.PAM30)) == 400
    assert K.triangle(K.BLOSUM62)["W", "W"] == 11 and K.triangle(K.PAM30)["W", "F"] == -4


@pytest.mark.parametrize("hseq,loop", [
    # an earlier cysteine within 30 residues of the end anchor wins, as the pattern says
    ("EVQLVESGGGLVQPGGSLRLSCAASGFTFSSYAMSWVRQAYYCARDRGYYWGQGTLVTVSS", "AASGFTFSSYAMSWVRQAYYCARDRGYY"),
    ("EVQLVESGGGLVQPGGSLRLSCAASGFTFSSYAMSWVRQAPGKGLEWVSAYYCARDRGYYWGQGTLVTVSS", "ARDRGYY"),
    ("evqlvesggglvqpggslrlyycardrgyywgqgtl", "ARDRGYY"),
    ("CARDRGWGQG", ""),
    ("AAAAAAAAAAAAAAAAAAAAAAAAAAAA", ""),
    ("AAAAAAAAAACARDWGQGAAAAACTTTTWGQGA", "TTTT"),
    ("AAAAAAAAAAAAAAAAACARDRWGAAAA", "ARDR"),
])
def test_loop_extraction(spark, hseq, loop):
    assert one(spark, T.cdr3_from_heavy_chain(F.col("h")), h=hseq) == loop


@pytest.mark.parametrize("raw,clean", [(None, ""), (" NaN ", ""), ("n/a", ""), ("CAR", "CAR"), ("", "")])
def test_null_like(spark, raw, clean):
    assert one(spark, T.null_like_to_empty(F.col("c")), c=raw) == clean


@pytest.mark.parametrize("cdr3,loop", [("CARGFDYW", "GFDYW"), ("CARDRGYYY", "DRGYYY"), ("CAAFDY", "AA"), ("c-ardDW", ""), ("", "")])
def test_hypervariable_loop(spark, cdr3, loop):
    assert one(spark, T.hypervariable_loop(F.col("c")), c=cdr3) == loop


def charge(seq, ph):
    pk_n = K.BJELLQVIST_NTERM_BY_RESIDUE.get(seq[0], K.BJELLQVIST_NTERM)
    pk_c = K.BJELLQVIST_CTERM_BY_RESIDUE.get(seq[-1], K.BJELLQVIST_CTERM)
    net = 1 / (1 + 10 ** (ph - pk_n)) - 1 / (1 + 10 ** (pk_c - ph))
    net += sum(1 / (1 + 10 ** (ph - K.BJELLQVIST_POSITIVE[x])) for x in seq if x in K.BJELLQVIST_POSITIVE)
    return net - sum(1 / (1 + 10 ** (K.BJELLQVIST_NEGATIVE[x] - ph)) for x in seq if x in K.BJELLQVIST_NEGATIVE)


@pytest.mark.parametrize("seq", ["CARDRGYYYGMDVW", "KKKRRH", "DDDEEE", "G"])
def test_neutral_point(spark, seq):
    pi = one(spark, S.protein_pi(F.col("s")), s=seq)
    assert 4.05 <= pi <= 12
    if 4.1 < pi < 11.9:
        assert charge(seq, pi - 1e-3) > 0 > charge(seq, pi + 1e-3)
    assert one(spark, S.protein_charge(F.col("s")), s=seq) == pytest.approx(charge(seq, 7.4), abs=1e-9)


def test_values_that_cannot_be_computed_are_zero(spark):
    s = F.col("s")
    for value in (S.protein_gravy(s), S.protein_mass(s), S.protein_instability(s)):
        assert one(spark, value, s="AXB") == 0
    assert one(spark, S.protein_pi(s), s="") == 0
    assert one(spark, S.min_window_parker(s, 5), s="ACD") is None
    assert one(spark, S.protein_mass(s), s="GG_tail") == pytest.approx(2 * 75.0666 - 18.0153)


def test_unknown_residues_count_in_the_length(spark):
    assert one(spark, S.parker(F.col("s")), s="WX") == -5.0
    assert one(spark, S.feature_gravy(F.col("s")), s="IX") == 2.25


def test_empty_loop_makes_every_feature_zero(spark):
    for name in ("length", "vh_length", "vh_charge", "pi", "count_K", "R", "nonsense"):
        assert one(spark, S.biophysical_feature(name, F.col("c"), F.col("h")), c="", h="EVQL") == 0


def test_prefix_similarity(spark):
    p = V.prefix_similarity(F.col("a"), F.col("b"))
    assert one(spark, p, a="AW", b="AWK") == 7.5
    assert one(spark, p, a="", b="A") == -10
    assert one(spark, p, a="X", b="A") == -4


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_indel_matches_dynamic_programming():
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("ACD") for _ in range(rng.randint(0, 70))) for _ in range(2))
        assert A.indel(a, b) == len(a) + len(b) - 2 * lcs(a, b)


def test_global_scores():
    blosum = A.BLOSUM62_ARRAY
    assert A.global_scores(["AAAA"], ["AAA"], blosum, -10, -1).tolist() == [2]
    assert A.global_scores(["WAAAW"], ["WW"], blosum, -10, -1).tolist() == [22 - 12]
    example = ["MAKPLTDQ", "MAKPLTEQ", "MVKPLTDQ", "LAKPLTDQ"]
    own = A.global_scores(example, example, blosum, -10, -1).tolist()
    assert own[0] == sum(K.triangle(K.BLOSUM62)[x, x] for x in example[0])


def test_expect_values_fall_and_invert():
    values = [A.expect_value(s) for s in range(-40, 80, 5)]
    assert all(x > y for x, y in zip(values, values[1:]))
    cut = A.score_cutoff(1e-4)
    assert A.expect_value(cut) < 1e-4 <= A.expect_value(cut - 1)


def test_t_tail():
    assert special.t_two_sided(0, 5) == pytest.approx(1)
    assert special.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.t_two_sided(12.70620474, 1) == pytest.approx(0.05, abs=1e-8)
    assert math.isnan(special.t_two_sided(float("nan"), 3))
