"""Published scales, patterns and substitution matrices.

Everything in this module is data that has to equal the published (or agreed)
values for results to be right; there is no logic here beyond unpacking text.
"""

from __future__ import annotations

# The 20 standard amino acids, alphabetical one-letter order.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

# Spellings that mean "no value" in sequence columns.
NULL_LIKE = ("nan", "none", "null", "n/a", "na", "")
NULL_LIKE_SHEET = NULL_LIKE + ("#n/a", "#value!", "#ref!")

# CDR3 anchors, strict pattern first, relaxed pattern second.
CDR3_PATTERNS = (r"C([A-Z]{3,30}?)WG[A-Z]G", r"C([A-Z]{3,35}?)WG")

# Sequence liability motifs.
LIABILITY_MOTIFS = {
    "glyco": "N[^P][ST]",
    "asp_isomer": "D[GSD]",
    "asn_deamid": "N[GSN]",
    "aromatic": "[FWYH][FWYH][FWYH]",
    "frag": "DP",
    "poly": "RR|WW|VV",
    "RR": "RR",
    "WW": "WW",
    "VV": "VV",
    "neg_patch": "[DE][DE]|[DE].[DE]",
}

# Kyte-Doolittle hydropathy.
KYTE_DOOLITTLE = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2,
    "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5,
    "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}

# Parker HPLC hydrophilicity.
PARKER = {
    "A": 2.1, "C": 1.4, "D": 10.0, "E": 7.8, "F": -9.2, "G": 5.7, "H": 2.1,
    "I": -8.0, "K": 5.7, "L": -9.2, "M": -4.2, "N": 7.0, "P": 2.1, "Q": 6.0,
    "R": 4.2, "S": 6.5, "T": 5.2, "V": -3.7, "W": -10.0, "Y": -1.9,
}

# pKa set of the model features (no cysteine or tyrosine term).
FEATURE_PKA_ACID = {"D": 3.9, "E": 4.1}
FEATURE_PKA_BASE = {"H": 6.0, "K": 10.5, "R": 12.5}
FEATURE_PKA_NTERM = 8.0
FEATURE_PKA_CTERM = 3.1

# Dipeptide weights of the model features; all others weigh 1.
FEATURE_DIPEPTIDES = {
    "CD": 20.26, "CH": 33.6, "CL": 20.26, "CM": 33.6, "CP": 20.26, "CT": 33.6,
    "DG": 20.26, "DS": 20.26, "FD": 54.96, "GD": 20.26, "GH": 33.6,
    "HN": 20.26, "LR": 20.26, "ND": 20.26, "NL": 20.26, "NP": 20.26,
    "QD": 20.26, "QR": 20.26, "RD": 20.26, "RH": 20.26, "RR": 58.28,
    "SR": 20.26, "TD": 20.26, "TP": 20.26, "WM": 24.68,
}

# Bjellqvist pKa set, with the terminal residues that shift it.
BJELLQVIST_POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
BJELLQVIST_NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
BJELLQVIST_NTERM = 7.5
BJELLQVIST_CTERM = 3.55
BJELLQVIST_NTERM_BY_RESIDUE = {
    "A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7,
}
BJELLQVIST_CTERM_BY_RESIDUE = {"D": 4.55, "E": 4.75}

# Average residue masses (free amino acid) and water, in dalton.
RESIDUE_MASS = {
    "A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891,
    "G": 75.0666, "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729,
    "M": 149.2113, "N": 132.1179, "O": 255.3134, "P": 115.1305, "Q": 146.1445,
    "R": 174.201, "S": 105.0926, "T": 119.1192, "U": 168.0532, "V": 117.1463,
    "W": 204.2252, "Y": 181.1885,
}
WATER_MASS = 18.0153

# Guruprasad dipeptide instability weights other than 1.
# One line per first residue: second residue and weight.
GURUPRASAD = """
A  C 44.94  D -7.49  H -7.49  P 20.26
C  D 20.26  H 33.60  L 20.26  M 33.60  P 20.26  Q -6.54  T 33.60  V -6.54  W 24.68
D  F -6.54  K -7.49  R -6.54  S 20.26  T -14.03
E  C 44.94  D 20.26  E 33.60  H -6.54  I 20.26  P 20.26  Q 20.26  S 20.26  W -14.03
F  D 13.34  K -14.03  P 20.26  Y 33.601
G  A -7.49  E -6.54  G 13.34  I -7.49  K -7.49  N -7.49  T -7.49  W 13.34  Y -7.49
H  F -9.37  G -9.37  I 44.94  K 24.68  N 24.68  P -1.88  T -6.54  W -1.88  Y 44.94
I  E 44.94  H 13.34  K -7.49  L 20.26  P -1.88  V -7.49
K  G -7.49  I -7.49  L -7.49  M 33.60  P -6.54  Q 24.64  R 33.60  V -7.49
L  K -7.49  P 20.26  Q 33.60  R 20.26  W 24.68
M  A 13.34  H 58.28  M -1.88  P 44.94  Q -6.54  R -6.54  S 44.94  T -1.88  Y 24.68
N  C -1.88  F -14.03  G -14.03  I 44.94  K 24.68  P -1.88  Q -6.54  T -7.49  W -9.37
P  A 20.26  C -6.54  D -6.54  E 18.38  F 20.26  M -6.54  P 20.26  Q 20.26  R -6.54  S 20.26  V 20.26  W -1.88
Q  C -6.54  D 20.26  E 20.26  F -6.54  P 20.26  Q 20.26  S 44.94  V -6.54  Y -6.54
R  G -7.49  H 20.26  N 13.34  P 20.26  Q 20.26  R 58.28  S 44.94  W 58.28  Y -6.54
S  C 33.60  E 20.26  P 44.94  Q 20.26  R 20.26  S 20.26
T  E 20.26  F 13.34  G -7.49  N -14.03  Q -6.54  W -14.03
V  D -14.03  G -7.49  K -1.88  P 20.26  T -7.49  Y -6.54
W  A -14.03  G -9.37  H 24.68  L 13.34  M 24.68  N 13.34  T -14.03  V -7.49
Y  A 24.68  D 24.68  E -6.54  G -7.49  H 13.34  M 44.94  P 13.34  R -15.91  T -7.49  W -9.37  Y 13.34
"""

# BLOSUM62, lower triangle, NCBI residue order.
BLOSUM62 = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""

# PAM30, lower triangle, NCBI residue order.
PAM30 = """
A   6
R  -7   8
N  -4  -6   8
D  -3 -10   2   8
C  -6  -8 -11 -14  10
Q  -4  -2  -3  -2 -14   8
E  -2  -9  -2   2 -14   1   8
G  -2  -9  -3  -3  -9  -7  -4   6
H  -7  -2   0  -4  -7   1  -5  -9   9
I  -5  -5  -5  -7  -6  -8  -5 -11  -9   8
L  -6  -8  -7 -12 -15  -5  -9 -10  -6  -1   7
K  -7   0  -1  -4 -14  -3  -4  -7  -6  -6  -8   7
M  -5  -4  -9 -11 -13  -4  -7  -8 -10  -1   1  -2  11
F  -8  -9  -9 -15 -13 -13 -14  -9  -6  -2  -3 -14  -4   9
P  -2  -4  -6  -8  -8  -3  -5  -6  -4  -8  -7  -6  -8 -10   8
S   0  -3   0  -4  -3  -5  -4  -2  -6  -7  -8  -4  -5  -6  -2   6
T  -1  -6  -2  -5  -8  -5  -6  -6  -7  -2  -7  -3  -4  -9  -4   0   7
W -13  -2  -8 -15 -15 -13 -17 -15  -7 -14  -6 -12 -13  -4 -14  -5 -13  13
Y  -8 -10  -4 -11  -4 -12  -8 -14  -3  -6  -7  -9 -11   2 -13  -7  -6  -5  10
V  -2  -8  -8  -8  -6  -7  -6  -5  -6   2  -2  -9  -1  -8  -6  -6  -3 -15  -7   7
"""

# Skew-normal fit (shape, location, scale) of PAM30 loop scores.
LOOP_SCORE_SKEWNORM = (2.39163661, -18.46987085, 12.44510516)

# Score-column names, priority order, and names never scored.
SCORE_PATTERNS = (
    ("transformer_lm", r"transformer_lm.*score"),
    ("transformer_onehot", r"transformer_onehot.*score"),
    ("transformer", r"transformer.*score"),
    ("xgboost", r"(xgboost|xgb).*score"),
    ("random_forest", r"^rf_.*_score$"),
    ("random_forest", r"(rf|random_forest).*pred.*proba"),
    ("cnn", r"cnn.*score"),
    ("ensemble", r"(ensemble|mean).*score"),
    ("pred_proba", r"pred.*proba"),
    ("score", r"(?<![a-z_])score$"),
)
NOT_SCORE_PATTERNS = (
    r"_label$", r"_pred$", r"_filter$", r"_flag$", r"optimallabel", r"costlabel",
    r"f1label", r"f2label", r"f05label", r"sens90label", r"_bvp_filter",
    r"_elisa_filter",
)


def triangle(text: str) -> dict[tuple[str, str], int]:
    """Symmetric pair scores from a lower-triangle matrix in text form."""
    rows = [line.split() for line in text.strip().splitlines()]
    order = [row[0] for row in rows]
    scores = {}
    for row in rows:
        for other, value in zip(order, row[1:]):
            scores[row[0], other] = scores[other, row[0]] = int(value)
    return scores


def guruprasad_pairs() -> dict[tuple[str, str], float]:
    """Dipeptide weights that differ from 1."""
    pairs = {}
    for line in GURUPRASAD.strip().splitlines():
        first, *rest = line.split()
        for second, weight in zip(rest[::2], rest[1::2]):
            pairs[first, second] = float(weight)
    return pairs
