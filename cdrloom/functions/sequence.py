"""Physico-chemical properties of amino-acid strings as Column expressions.

Everything works on residue counts (``length`` minus ``length(translate)``),
so a property costs a few passes over the string inside generated code and the
optimizer shares the counts between properties of one projection.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from .. import constants as K


def residues(seq: Column, letters: str) -> Column:
    """How many residues of ``seq`` are one of ``letters``."""
    # faster than one translate, which looks every letter up as a string
    return F.length(seq) - F.length(reduce(lambda rest, x: F.replace(rest, F.lit(x), F.lit("")), letters, seq))


def scale_sum(seq: Column, scale: dict[str, float]) -> Column:
    """Sum of a residue scale; residues with equal values share one count."""
    by_value: dict[float, str] = {}
    for residue, value in scale.items():
        by_value[value] = by_value.get(value, "") + residue
    return reduce(add, (residues(seq, r) * F.lit(v) for v, r in by_value.items()))


def scale_mean(seq: Column, scale: dict[str, float]) -> Column:
    """Mean of a residue scale; unknown residues count in the length, '' gives 0."""
    return F.when(F.length(seq) > 0, scale_sum(seq, scale) / F.length(seq)).otherwise(F.lit(0.0))


def motif_flag(seq: Column, motif: str) -> Column:
    return seq.rlike(K.LIABILITY_MOTIFS[motif])


def unpaired_cysteine(seq: Column) -> Column:
    return (residues(seq, "C") % 2 == 1) | seq.rlike("C.C|CC")


def simple_charge(seq: Column, histidine: bool = False) -> Column:
    return residues(seq, "RKH" if histidine else "RK") - residues(seq, "DE")


def parker(seq: Column) -> Column:
    return scale_mean(seq, K.PARKER)


def windows(seq: Column, k: int) -> Column:
    """All k-residue windows of ``seq`` in order; empty array if it is shorter."""
    if k == 1:
        return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))
    starts = F.sequence(F.lit(1), F.length(seq) - (k - 1))
    cut = F.transform(starts, lambda i: F.substring(seq, i, F.lit(k)))
    return F.when(F.length(seq) >= k, cut).otherwise(F.array().cast("array<string>"))


def min_window_parker(seq: Column, k: int) -> Column:
    """Lowest mean Parker value over k-residue windows; null if there is none."""
    return F.array_min(F.transform(windows(seq, k), parker))


# --- pair tables ----------------------------------------------------------

OTHER = 26  # code of anything that is not A-Z


def letter_codes(seq: Column) -> Column:
    """0..25 for A-Z, 26 for anything else, as an array in residue order."""

    def code(ch: Column) -> Column:
        place = F.ascii(ch) - 65
        return F.when(place.between(0, 25), place).otherwise(F.lit(OTHER))

    return F.transform(F.split(seq, ""), code)


def pair_cells(table: dict[tuple[str, str], float], default: float) -> Column:
    """Flat 27 x 27 literal array of a residue pair table."""
    letters = [chr(65 + i) for i in range(OTHER)] + ["?"]
    return F.array(*[F.lit(float(table.get((x, y), default))) for x in letters for y in letters])


def pair_cell(cells: Column, a: Column, b: Column) -> Column:
    return F.element_at(cells, a * (OTHER + 1) + b + 1)


def neighbour_sum(seq: Column, table: dict[tuple[str, str], float], default: float) -> Column:
    """Sum of a pair table over adjacent residues, in one pass along the string."""
    cells = pair_cells(table, default)

    def step(state: Column, code: Column) -> Column:
        value = F.when(state["prev"] >= 0, pair_cell(cells, state["prev"], code)).otherwise(F.lit(0.0))
        return F.struct(code.alias("prev"), (state["total"] + value).alias("total"))

    start = F.struct(F.lit(-1).alias("prev"), F.lit(0.0).alias("total"))
    return F.aggregate(letter_codes(seq), start, step, lambda state: state["total"])


# --- published protein parameters ----------------------------------------
#
# These follow the widely used protein-analysis conventions: text after an
# underscore is ignored, letters are upper-cased, and a property that cannot be
# computed is 0.

def _standard(seq: Column) -> Column:
    return F.upper(F.substring_index(seq, "_", 1))


def _only_known(seq: Column, alphabet: str = K.AMINO_ACIDS) -> Column:
    return F.length(F.translate(seq, alphabet, "")) == 0


def _zero_unless(ok: Column, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.lit(0.0))


def _terminal_pk(residue: Column, table: dict[str, float], default: float) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for letter, pk in table.items():
        out = out.when(residue == letter, F.lit(pk))
    return out.otherwise(F.lit(default))


# Charge is evaluated on h = 10 ** pH, so a group with acid constant k adds
# 1 / (h / 10**k + 1) if basic and h / (10**k + h) if acidic: no powers inside
# the search for the neutral point.

def _bjellqvist_parts(seq: Column) -> Column:
    """Counts and terminal constants of one sequence, so charge needs no string."""
    nterm = _terminal_pk(F.substring(seq, 1, 1), K.BJELLQVIST_NTERM_BY_RESIDUE, K.BJELLQVIST_NTERM)
    cterm = _terminal_pk(F.substring(seq, -1, 1), K.BJELLQVIST_CTERM_BY_RESIDUE, K.BJELLQVIST_CTERM)
    counts = [residues(seq, r).cast("double").alias(r) for r in "KRHDECY"]
    ten = F.lit(10.0)
    return F.struct(*counts, F.pow(ten, nterm).alias("nterm"), F.pow(ten, cterm).alias("cterm"))


def _basic(h: Column, constant: Column) -> Column:
    return F.lit(1.0) / (h / constant + 1.0)


def _acidic(h: Column, constant: Column) -> Column:
    return h / (constant + h)


def _bjellqvist_charge(parts: Column, h: Column) -> Column:
    net = _basic(h, parts["nterm"]) - _acidic(h, parts["cterm"])
    for residue, pk in K.BJELLQVIST_POSITIVE.items():
        net = net + parts[residue] * _basic(h, F.lit(10.0**pk))
    for residue, pk in K.BJELLQVIST_NEGATIVE.items():
        net = net - parts[residue] * _acidic(h, F.lit(10.0**pk))
    return net


def _with_parts(parts: Column, use) -> Column:
    """``use(parts)`` with the struct computed once per row."""
    return F.element_at(F.transform(F.array(parts), use), 1)


def protein_charge(seq: Column, ph: float = 7.4) -> Column:
    s = _standard(seq)
    value = _with_parts(_bjellqvist_parts(s), lambda p: _bjellqvist_charge(p, F.lit(10.0**ph)))
    return _zero_unless(F.length(s) > 0, value)


def _steps(first: float, count: int) -> Column:
    """10 ** (first / 2**i): the shrinking moves of a search by halving."""
    return F.array(*[F.lit(10.0 ** (first / 2**i)) for i in range(count)])


def _walk(charge, start: Column, steps: Column) -> Column:
    """Follow the sign of the charge: up while positive, down otherwise."""
    return F.aggregate(steps, start, lambda h, f: F.when(charge(h) > 0, h * f).otherwise(h / f))


def protein_pi(seq: Column) -> Column:
    """Isoelectric point between 4.05 and 12, first probe 7.4, width below 1e-4.

    After the first probe the remaining side (4.6 or 3.35 wide) is halved; both
    sides need sixteen more probes to get below that width.
    """
    s = F.upper(seq)
    low, first, high = 4.05, 7.4, 12.0

    def solve(parts: Column) -> Column:
        charge = lambda h: _bjellqvist_charge(parts, h)
        up = charge(F.lit(10.0**first)) > 0
        start = F.when(up, F.lit(10.0 ** ((first + high) / 2))).otherwise(F.lit(10.0 ** ((low + first) / 2)))
        steps = F.when(up, _steps((high - first) / 4, 16)).otherwise(_steps((first - low) / 4, 16))
        return F.log10(_walk(charge, start, steps))

    return _zero_unless(F.length(s) > 0, _with_parts(_bjellqvist_parts(s), solve))


def protein_mass(seq: Column) -> Column:
    s = _standard(seq)
    mass = scale_sum(s, K.RESIDUE_MASS) - (F.length(s) - 1) * F.lit(K.WATER_MASS)
    return _zero_unless(_only_known(s, "".join(K.RESIDUE_MASS)), mass)


def protein_gravy(seq: Column) -> Column:
    s = _standard(seq)
    return _zero_unless(_only_known(s), scale_mean(s, K.KYTE_DOOLITTLE))


def protein_aromaticity(seq: Column) -> Column:
    s = _standard(seq)
    return _zero_unless(F.length(s) > 0, residues(s, "FWY") / F.length(s))


def protein_instability(seq: Column) -> Column:
    s = _standard(seq)
    total = neighbour_sum(s, K.guruprasad_pairs(), 1.0)
    return _zero_unless((F.length(s) > 1) & _only_known(s), F.lit(10.0) / F.length(s) * total)


def protein_length(seq: Column) -> Column:
    return F.length(F.substring_index(seq, "_", 1))


# --- model features -------------------------------------------------------

def feature_text(seq: Column) -> Column:
    """Sequence as the models see it: upper case, no gaps, '' for null."""
    return F.regexp_replace(F.upper(F.coalesce(seq, F.lit(""))), "-", "")


def _rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def feature_charge(seq: Column, digits: int | None = 4) -> Column:
    """Side-chain charge at pH 7 of D, E, H, K, R."""
    weights = {r: -1 / (1 + 10 ** (pk - 7)) for r, pk in K.FEATURE_PKA_ACID.items()}
    weights |= {r: 1 / (1 + 10 ** (7 - pk)) for r, pk in K.FEATURE_PKA_BASE.items()}
    return _rounded(scale_sum(seq, weights), digits)


def feature_gravy(seq: Column, digits: int | None = 4) -> Column:
    return _rounded(scale_mean(seq, K.KYTE_DOOLITTLE), digits)


def feature_pi(seq: Column, digits: int | None = 3) -> Column:
    """Isoelectric point on [0, 14] with termini; 60 halvings exhaust a double."""

    def solve(counts: Column) -> Column:
        def charge(h: Column) -> Column:
            net = _basic(h, F.lit(10.0**K.FEATURE_PKA_NTERM)) - _acidic(h, F.lit(10.0**K.FEATURE_PKA_CTERM))
            for r, pk in K.FEATURE_PKA_ACID.items():
                net = net - counts[r] * _acidic(h, F.lit(10.0**pk))
            for r, pk in K.FEATURE_PKA_BASE.items():
                net = net + counts[r] * _basic(h, F.lit(10.0**pk))
            return net

        return F.log10(_walk(charge, F.lit(1e7), _steps(3.5, 60)))

    packed = F.struct(*[residues(seq, r).cast("double").alias(r) for r in "DEHKR"])
    return _rounded(_with_parts(packed, solve), digits)


def feature_instability(seq: Column, digits: int | None = 3) -> Column:
    table = {(k[0], k[1]): v for k, v in K.FEATURE_DIPEPTIDES.items()}
    value = F.lit(10.0) / F.length(seq) * neighbour_sum(seq, table, 1.0)
    return _rounded(F.when(F.length(seq) >= 2, value).otherwise(F.lit(0.0)), digits)


def feature_share(seq: Column, letters: str, digits: int | None = 4) -> Column:
    return _rounded(residues(seq, letters) / F.length(seq), digits)


def biophysical_feature(name: str, cdr3: Column, heavy: Column, rounded: bool = True, cleaned: bool = False) -> Column:
    """One named model feature; an empty CDR3 makes every feature 0. ``cleaned``: both are ``feature_text`` already."""
    loop, vh = (cdr3, heavy) if cleaned else (feature_text(cdr3), feature_text(heavy))
    four, three = (4, 3) if rounded else (None, None)
    n = F.length(loop)
    square = feature_charge(loop, four)
    known = {
        "length": lambda: n,
        "cdr3_length": lambda: n,
        "pi": lambda: feature_pi(loop, three),
        "charge": lambda: feature_charge(loop, four),
        "charge_ph7": lambda: feature_charge(loop, four),
        "hydrophobicity": lambda: feature_gravy(loop, four),
        "aromaticity": lambda: feature_share(loop, "FYW", four),
        "instability": lambda: feature_instability(loop, three),
        "net_charge_sq": lambda: _rounded(square * square, four),
        "frac_charged": lambda: feature_share(loop, "DERKH", four),
        "frac_hydrophobic": lambda: feature_share(loop, "AVILMFWP", four),
        "vh_length": lambda: F.length(vh),
        "vh_cdr3_length_ratio": lambda: _rounded(F.length(vh) / n, four),
        "vh_charge": lambda: feature_charge(vh, four),
        "vh_charge_ph7": lambda: feature_charge(vh, four),
        "vh_hydrophobicity": lambda: feature_gravy(vh, four),
    }
    if name in known:
        value = known[name]()
    elif name.startswith("count_") and name[6:] in K.AMINO_ACIDS:
        value = residues(loop, name[6:])
    elif len(name) == 1 and name in K.AMINO_ACIDS:
        value = residues(loop, name)
    else:
        value = F.lit(0.0)
    return F.when(n > 0, value.cast("double")).otherwise(F.lit(0.0))
