"""Queries over sequence properties and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import sequence as S, text as T, vectors as V
from ..models.embedding import embed_sequences, hashed_kmer_model
from ..operators import annotation as A, features as X
from ..operators.statistics import class_density
from ..session import cut_lineage
from .catalog import query
from .inputs import ANTIBODIES_SQL, ASSAYS_SQL, EMBEDDINGS_SQL, LABELLED_SQL, antibodies, assays, embeddings, labelled, r6, table


def sql_count(seq: str, letters: str) -> str:
    return "(" + " + ".join(f"(length({seq}) - length(replace({seq}, '{x}', '')))" for x in letters) + ")"


def sql_scale(seq: str, scale: dict[str, float]) -> str:
    return "(" + " + ".join(f"{sql_count(seq, x)} * ({v})::DOUBLE" for x, v in scale.items()) + ")"


def sql_mean(seq: str, scale: dict[str, float]) -> str:
    return f"CASE WHEN length({seq}) > 0 THEN {sql_scale(seq, scale)} / length({seq}) ELSE 0 END"


def sql_pk(residue: str, cases: dict[str, float], default: float) -> str:
    return f"CASE {residue} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE {default} END::DOUBLE"


# Charge of counts at a pH, published set; {ph} is filled in.
BJELLQVIST_SQL = (
    "(1 / (power(10::DOUBLE, {ph} - nt) + 1)"
    + "".join(f" + n{r.lower()} / (power(10::DOUBLE, {{ph}} - {pk}) + 1)" for r, pk in K.BJELLQVIST_POSITIVE.items())
    + " - 1 / (power(10::DOUBLE, ct - {ph}) + 1)"
    + "".join(f" - n{r.lower()} / (power(10::DOUBLE, {pk} - {{ph}}) + 1)" for r, pk in K.BJELLQVIST_NEGATIVE.items())
    + ")"
)


def sql_parts(source: str, seq: str) -> str:
    counts = ", ".join(f"{sql_count(seq, r)}::DOUBLE AS n{r.lower()}" for r in "KRHDECY")
    nt = sql_pk(f"substr({seq}, 1, 1)", K.BJELLQVIST_NTERM_BY_RESIDUE, K.BJELLQVIST_NTERM)
    ct = sql_pk(f"substr({seq}, length({seq}), 1)", K.BJELLQVIST_CTERM_BY_RESIDUE, K.BJELLQVIST_CTERM)
    return f"SELECT barcode, {seq} AS s, {counts}, {nt} AS nt, {ct} AS ct FROM {source}"


def sql_halving(parts: str, charge: str, lo: float, hi: float, first: float, steps: int) -> str:
    """Recursive halving: rows of ``parts`` plus lo, hi, ph after the last step."""
    up = charge.format(ph="ph") + " > 0"
    low, high = f"CASE WHEN {up} THEN ph ELSE lo END", f"CASE WHEN {up} THEN hi ELSE ph END"
    return f"""halving AS (
  SELECT *, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi, {first}::DOUBLE AS ph, 0 AS step FROM {parts}
  UNION ALL
  SELECT * EXCLUDE (lo, hi, ph, step), {low}, {high}, (({low}) + ({high})) / 2, step + 1 FROM halving WHERE step < {steps}),
solved AS (SELECT * FROM halving WHERE step = {steps})"""


# --- flags, charges, scales ------------------------------------------------

MOTIF_FLAGS_SQL = ", ".join(f"regexp_matches(cdr3, '{m}') AS {n}" for n, m in K.LIABILITY_MOTIFS.items())


@query("motif_flags", f"WITH {ANTIBODIES_SQL} SELECT barcode, {MOTIF_FLAGS_SQL} FROM ab")
def motif_flags(spark, sf):
    seq = F.col("cdr3")
    return antibodies(spark, sf).select("barcode", *[S.motif_flag(seq, m).alias(m) for m in K.LIABILITY_MOTIFS])


@query("unpaired_cysteine", f"""WITH {ANTIBODIES_SQL} SELECT barcode,
{sql_count('hseq', 'C')} % 2 = 1 OR regexp_matches(hseq, 'C.C|CC') AS cys FROM ab""")
def unpaired_cysteine(spark, sf):
    return antibodies(spark, sf).select("barcode", S.unpaired_cysteine(F.col("hseq")).alias("cys"))


@query("simple_charge", f"""WITH {ANTIBODIES_SQL}, q AS (SELECT barcode,
  {sql_count('cdr3', 'RK')} - {sql_count('cdr3', 'DE')} AS charge, {sql_count('cdr3', 'RKH')} - {sql_count('cdr3', 'DE')} AS charge2 FROM ab)
SELECT barcode, CAST(charge AS INTEGER) AS charge, CAST(charge2 AS INTEGER) AS charge2, charge < -4 AS neg, charge > 2 AS pos FROM q""")
def simple_charge(spark, sf):
    q = S.simple_charge(F.col("cdr3"))
    return antibodies(spark, sf).select(
        "barcode", q.alias("charge"), S.simple_charge(F.col("cdr3"), True).alias("charge2"), (q < -4).alias("neg"), (q > 2).alias("pos")
    )


@query("parker_hydrophilicity", f"""WITH {ANTIBODIES_SQL}, p AS (SELECT barcode, {sql_mean('cdr3', K.PARKER)} AS v FROM ab)
SELECT barcode, round(v, 6) AS parker, v < -1 AS hydrophobic FROM p""")
def parker_hydrophilicity(spark, sf):
    v = S.parker(F.col("cdr3"))
    return antibodies(spark, sf).select("barcode", r6(v).alias("parker"), (v < -1).alias("hydrophobic"))


@query("min_window_parker", f"""WITH {ANTIBODIES_SQL}, w AS (SELECT barcode, unnest(range(1, length(cdr3) - 3)) AS i, cdr3 FROM ab WHERE length(cdr3) >= 5),
v AS (SELECT barcode, substr(cdr3, i::BIGINT, 5) AS k FROM w), m AS (SELECT barcode, min({sql_mean('k', K.PARKER)}) AS v FROM v GROUP BY 1)
SELECT barcode, round(v, 6) AS lowest FROM ab LEFT JOIN m USING (barcode)""")
def min_window_parker(spark, sf):
    return antibodies(spark, sf).select("barcode", r6(S.min_window_parker(F.col("cdr3"), 5)).alias("lowest"))


@query("residue_count_flags", f"""WITH {ANTIBODIES_SQL} SELECT barcode, {sql_count('cdr3', 'R')} > 2 AS arg, {sql_count('cdr3', 'W')} > 2 AS trp,
{sql_count('cdr3', 'R')} - {sql_count('cdr3', 'D')} > 1 AS rmd FROM ab""")
def residue_count_flags(spark, sf):
    r = lambda x: S.residues(F.col("cdr3"), x)
    return antibodies(spark, sf).select("barcode", (r("R") > 2).alias("arg"), (r("W") > 2).alias("trp"), (r("R") - r("D") > 1).alias("rmd"))


@query("isoelectric_point", f"""WITH RECURSIVE {ANTIBODIES_SQL}, parts AS ({sql_parts('ab', 'hseq')}),
{sql_halving('parts', BJELLQVIST_SQL, 4.05, 12, 7.4, 17)} SELECT barcode, round(ph, 6) AS pi FROM solved""")
def isoelectric_point(spark, sf):
    return antibodies(spark, sf).select("barcode", r6(S.protein_pi(F.col("hseq"))).alias("pi"))


GURUPRASAD_SQL = "CASE substr(s, i::BIGINT, 2) " + " ".join(f"WHEN '{a}{b}' THEN {w}" for (a, b), w in K.guruprasad_pairs().items()) + " ELSE 1.0 END::DOUBLE"
MASS20 = {a: K.RESIDUE_MASS[a] for a in K.AMINO_ACIDS}


@query("protein_parameters", f"""WITH {ANTIBODIES_SQL}, parts AS ({sql_parts('ab', 'hseq')}),
dip AS (SELECT barcode, sum({GURUPRASAD_SQL}) AS d FROM (SELECT barcode, hseq AS s, unnest(range(1, length(hseq))) AS i FROM ab) GROUP BY 1)
SELECT barcode, round({BJELLQVIST_SQL.format(ph='7.4')}, 6) AS charge, round({sql_scale('s', MASS20)} - (length(s) - 1) * {K.WATER_MASS}, 4) AS mass,
  round({sql_mean('s', K.KYTE_DOOLITTLE)}, 8) AS gravy, round({sql_count('s', 'FWY')} / length(s), 8) AS aromaticity,
  round(10 / length(s) * d, 8) AS instability, length(s) AS len FROM parts JOIN dip USING (barcode)""")
def protein_parameters(spark, sf):
    h = F.col("hseq")
    return antibodies(spark, sf).select(
        "barcode", r6(S.protein_charge(h)).alias("charge"), F.round(S.protein_mass(h), 4).alias("mass"),
        F.round(S.protein_gravy(h), 8).alias("gravy"), F.round(S.protein_aromaticity(h), 8).alias("aromaticity"),
        F.round(S.protein_instability(h), 8).alias("instability"), S.protein_length(h).alias("len"),
    )


FEATURE_CHARGE = {r: -1 / (1 + 10 ** (pk - 7)) for r, pk in K.FEATURE_PKA_ACID.items()} | {
    r: 1 / (1 + 10 ** (7 - pk)) for r, pk in K.FEATURE_PKA_BASE.items()
}


@query("feature_charge", f"WITH {ANTIBODIES_SQL} SELECT barcode, round({sql_scale('cdr3', FEATURE_CHARGE)}, 6) AS charge FROM ab")
def feature_charge(spark, sf):
    return antibodies(spark, sf).select("barcode", r6(S.feature_charge(F.col("cdr3"), None)).alias("charge"))


@query("feature_gravy", f"WITH {ANTIBODIES_SQL} SELECT barcode, round({sql_mean('cdr3', K.KYTE_DOOLITTLE)}, 6) AS gravy FROM ab")
def feature_gravy(spark, sf):
    return antibodies(spark, sf).select("barcode", r6(S.feature_gravy(F.col("cdr3"), None)).alias("gravy"))


FEATURE_PI_SQL = (
    f"(1 / (1 + power(10::DOUBLE, {{ph}} - {K.FEATURE_PKA_NTERM})) - 1 / (1 + power(10::DOUBLE, {K.FEATURE_PKA_CTERM} - {{ph}}))"
    + "".join(f" - n{r.lower()} / (1 + power(10::DOUBLE, {pk} - {{ph}}))" for r, pk in K.FEATURE_PKA_ACID.items())
    + "".join(f" + n{r.lower()} / (1 + power(10::DOUBLE, {{ph}} - {pk}))" for r, pk in K.FEATURE_PKA_BASE.items()) + ")"
)
FIVE_COUNTS = ", ".join(f"{sql_count('cdr3', r)}::DOUBLE AS n{r.lower()}" for r in "DEHKR")


@query("feature_pi", f"""WITH RECURSIVE {ANTIBODIES_SQL}, parts AS (SELECT barcode, {FIVE_COUNTS} FROM ab),
{sql_halving('parts', FEATURE_PI_SQL, 0, 14, 7, 60)} SELECT barcode, round(ph, 6) AS pi FROM solved""")
def feature_pi(spark, sf):
    return antibodies(spark, sf).select("barcode", r6(S.feature_pi(F.col("cdr3"), None)).alias("pi"))


FEATURE_DIPEPTIDE_SQL = "CASE substr(cdr3, i::BIGINT, 2) " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in K.FEATURE_DIPEPTIDES.items()) + " ELSE 1.0 END::DOUBLE"


@query("feature_instability", f"""WITH {ANTIBODIES_SQL}, d AS (SELECT barcode, sum({FEATURE_DIPEPTIDE_SQL}) AS d
  FROM (SELECT barcode, cdr3, unnest(range(1, length(cdr3))) AS i FROM ab) GROUP BY 1)
SELECT barcode, round(CASE WHEN length(cdr3) >= 2 THEN 10 / length(cdr3) * d ELSE 0 END, 6) AS instability FROM ab LEFT JOIN d USING (barcode)""")
def feature_instability(spark, sf):
    return antibodies(spark, sf).select("barcode", r6(S.feature_instability(F.col("cdr3"), None)).alias("instability"))


BIOPHYSICAL = ("length", "aromaticity", "net_charge_sq", "frac_charged", "frac_hydrophobic", "vh_length", "vh_cdr3_length_ratio",
               "vh_charge", "vh_hydrophobicity", "count_K", "R", "unknown_name")


@query("biophysical_features", f"""WITH {ANTIBODIES_SQL} SELECT barcode,
  CASE WHEN cdr3 = '' THEN 0 ELSE length(cdr3) END::DOUBLE AS length,
  CASE WHEN cdr3 = '' THEN 0 ELSE round({sql_count('cdr3', 'FYW')} / length(cdr3), 6) END AS aromaticity,
  CASE WHEN cdr3 = '' THEN 0 ELSE round(power({sql_scale('cdr3', FEATURE_CHARGE)}, 2), 6) END AS net_charge_sq,
  CASE WHEN cdr3 = '' THEN 0 ELSE round({sql_count('cdr3', 'DERKH')} / length(cdr3), 6) END AS frac_charged,
  CASE WHEN cdr3 = '' THEN 0 ELSE round({sql_count('cdr3', 'AVILMFWP')} / length(cdr3), 6) END AS frac_hydrophobic,
  CASE WHEN cdr3 = '' THEN 0 ELSE length(hseq) END::DOUBLE AS vh_length,
  CASE WHEN cdr3 = '' THEN 0 ELSE round(length(hseq) / length(cdr3), 6) END AS vh_cdr3_length_ratio,
  CASE WHEN cdr3 = '' THEN 0 ELSE round({sql_scale('hseq', FEATURE_CHARGE)}, 6) END AS vh_charge,
  CASE WHEN cdr3 = '' THEN 0 ELSE round({sql_mean('hseq', K.KYTE_DOOLITTLE)}, 8) END AS vh_hydrophobicity,
  CASE WHEN cdr3 = '' THEN 0 ELSE {sql_count('cdr3', 'K')} END::DOUBLE AS count_K,
  CASE WHEN cdr3 = '' THEN 0 ELSE {sql_count('cdr3', 'R')} END::DOUBLE AS R, 0::DOUBLE AS unknown_name FROM ab""")
def biophysical_features(spark, sf):
    value = lambda n: S.biophysical_feature(n, F.col("cdr3"), F.col("hseq"), rounded=False)
    cols = [F.round(value(n), 8 if n == "vh_hydrophobicity" else 6).alias(n) for n in BIOPHYSICAL]
    return antibodies(spark, sf).select("barcode", *cols)


@query("residue_counts", f"""WITH {ANTIBODIES_SQL} SELECT barcode, {sql_count('cdr3', 'R')} AS R, {sql_count('cdr3', 'D')} AS D,
{sql_count('cdr3', 'E')} AS E, {sql_count('cdr3', 'W')} AS CDR3_W_count, length(cdr3) AS CDR3_len FROM ab""")
def residue_counts(spark, sf):
    return A.residue_counts(antibodies(spark, sf).select("barcode", "cdr3")).drop("cdr3")


@query("annotate_liabilities", f"""WITH RECURSIVE {ANTIBODIES_SQL}, parts AS ({sql_parts('ab', 'cdr3')}), {sql_halving('parts', BJELLQVIST_SQL, 4.05, 12, 7.4, 17)}
SELECT barcode, {", ".join(f"regexp_matches(s, '{m}') AS l_{n}" for n, m in K.LIABILITY_MOTIFS.items())},
  {sql_count('s', 'C')} % 2 = 1 OR regexp_matches(s, 'C.C|CC') AS l_cys,
  {sql_count('s', 'RK')} - {sql_count('s', 'DE')} < -4 AS l_neg_charge, {sql_count('s', 'RK')} - {sql_count('s', 'DE')} > 2 AS l_pos_charge,
  {sql_count('s', 'RK')} - {sql_count('s', 'DE')} AS l_charge_value, {sql_count('s', 'RKH')} - {sql_count('s', 'DE')} AS l_charge_value2,
  {sql_mean('s', K.PARKER)} < -1 AS l_hydrophobic, round({sql_mean('s', K.PARKER)}, 6) AS l_hydrophobic_value,
  {sql_count('s', 'R')} > 2 AS l_arg, {sql_count('s', 'W')} > 2 AS l_trp, {sql_count('s', 'R')} - {sql_count('s', 'D')} > 1 AS l_rmd,
  round(CASE WHEN s = '' THEN 0 ELSE ph END, 6) AS l_isoelectricpoint,
  round({sql_scale('s', MASS20)} - (length(s) - 1) * {K.WATER_MASS}, 4) AS l_molecular_weight FROM solved""")
def annotate_liabilities(spark, sf):
    out = A.annotate_liabilities(antibodies(spark, sf).select("barcode", "cdr3"), "cdr3").drop("cdr3")
    return out.withColumns({
        "l_hydrophobic_value": r6("l_hydrophobic_value"), "l_isoelectricpoint": r6("l_isoelectricpoint"),
        "l_molecular_weight": F.round("l_molecular_weight", 4),
    })


@query("annotate_properties", f"""WITH RECURSIVE {ANTIBODIES_SQL}, parts AS ({sql_parts('ab', 'hseq')}), {sql_halving('parts', BJELLQVIST_SQL, 4.05, 12, 7.4, 17)},
dip AS (SELECT barcode, sum({GURUPRASAD_SQL}) AS d FROM (SELECT barcode, hseq AS s, unnest(range(1, length(hseq))) AS i FROM ab) GROUP BY 1)
SELECT barcode, {", ".join(f"regexp_matches(s, '{m}') AS VH_{n}" for n, m in K.LIABILITY_MOTIFS.items())},
  {sql_count('s', 'C')} % 2 = 1 OR regexp_matches(s, 'C.C|CC') AS VH_cys,
  {sql_count('s', 'RK')} - {sql_count('s', 'DE')} < -4 AS VH_neg_charge, {sql_count('s', 'RK')} - {sql_count('s', 'DE')} > 2 AS VH_pos_charge,
  {sql_count('s', 'RK')} - {sql_count('s', 'DE')} AS VH_simple_charge,
  {sql_mean('s', K.PARKER)} < -1 AS VH_parker_hplc, round({sql_mean('s', K.PARKER)}, 8) AS VH_parker_hplc_index,
  {sql_count('s', 'R')} > 2 AS VH_arg, {sql_count('s', 'W')} > 2 AS VH_trp, {sql_count('s', 'R')} - {sql_count('s', 'D')} > 1 AS VH_rmd,
  round(ph, 6) AS VH_isoelectricpoint, round({BJELLQVIST_SQL.format(ph='7.4')}, 6) AS VH_charge, round(10 / length(s) * d, 8) AS VH_instability_index,
  round({sql_count('s', 'FWY')} / length(s), 8) AS VH_aromaticity, round({sql_mean('s', K.KYTE_DOOLITTLE)}, 8) AS VH_hydrophobicity, length(s) AS VH_length
FROM solved JOIN dip USING (barcode)""")
def annotate_properties(spark, sf):
    out = A.annotate_properties(antibodies(spark, sf).select("barcode", "hseq"), "hseq", "VH").drop("hseq")
    floats = ("parker_hplc_index", "isoelectricpoint", "charge", "instability_index", "aromaticity", "hydrophobicity")
    digits = {"parker_hplc_index": 8, "aromaticity": 8, "hydrophobicity": 8, "instability_index": 8}
    return out.withColumns({f"VH_{c}": F.round(f"VH_{c}", digits.get(c, 6)) for c in floats})


@query("pair_text", f"""WITH {ANTIBODIES_SQL}, t AS (SELECT barcode, trim(regexp_replace(cdr3, '(.)', '\\1 ', 'g')) AS h, trim(regexp_replace(substr(lseq, 1), '(.)', '\\1 ', 'g')) AS l FROM ab)
SELECT barcode, h || ' [CLS] [CLS] ' || l AS two, h || ' [CLS] ' || l AS one, h || ' ' || l AS plain FROM t""")
def pair_text(spark, sf):
    pair = lambda s: T.paired_text(F.col("cdr3"), F.col("lseq"), s)
    return antibodies(spark, sf).select("barcode", pair("double_cls").alias("two"), pair("single_cls").alias("one"), pair("spaced").alias("plain"))


# --- distributions per class ----------------------------------------------

PANEL_SQL = " UNION ALL ".join([
    "SELECT 'arginine' AS panel, quality AS class, floor(R + 0.5) AS bin FROM b",
    "SELECT 'aspartate', quality, floor(D + 0.5) FROM b",
    "SELECT 'tryptophan', quality, CASE WHEN R = 1 THEN floor(W + 0.5) END FROM b",
    "SELECT 'glutamate', quality, floor(E + 0.5) FROM b",
    "SELECT 'length', quality, floor(n + 0.5) FROM b",
    "SELECT 'charge', quality, floor(hcharge + 0.5) FROM b",
    "SELECT 'loop_pi', quality, floor(hpi + 0.5) FROM b",
    "SELECT 'heavy_pi', quality, CASE WHEN vpi BETWEEN 1 AND 11 THEN least(floor(vpi), 10) END FROM b",
])


@query("class_density_hist", f"""WITH RECURSIVE {LABELLED_SQL}, parts AS (
  SELECT barcode || kind AS barcode, * EXCLUDE (barcode, kind) FROM (
    SELECT *, '/h' AS kind FROM ({sql_parts('lab', 'cdr3')}) UNION ALL SELECT *, '/v' FROM ({sql_parts('lab', 'hseq')}))),
{sql_halving('parts', BJELLQVIST_SQL, 4.05, 12, 7.4, 17)},
b AS (SELECT quality, {sql_count('cdr3', 'R')} AS R, {sql_count('cdr3', 'D')} AS D, {sql_count('cdr3', 'E')} AS E, {sql_count('cdr3', 'W')} AS W, length(cdr3) AS n,
  CASE WHEN cdr3 = '' THEN 0 ELSE (SELECT {BJELLQVIST_SQL.format(ph='7.4')} FROM parts p WHERE p.barcode = lab.barcode || '/h') END AS hcharge,
  CASE WHEN cdr3 = '' THEN 0 ELSE h.ph END AS hpi, v.ph AS vpi
  FROM lab JOIN solved h ON h.barcode = lab.barcode || '/h' JOIN solved v ON v.barcode = lab.barcode || '/v' WHERE length(cdr3) < 25),
x AS (SELECT panel, class, bin::BIGINT AS bin, count(*) AS n FROM ({PANEL_SQL}) WHERE bin IS NOT NULL GROUP BY ALL)
SELECT panel, class, bin, n, round(n / sum(n) OVER (PARTITION BY panel, class), 6) AS density FROM x""")
def class_density_hist(spark, sf):
    df = labelled(spark, sf).select("barcode", "quality", "cdr3", "hseq").where(F.length("cdr3") < 25)
    annotated = A.annotate_biophysical(df)
    out = class_density(annotated, "quality", A.PROPERTY_PANELS, A.property_panel_filters())
    return out.withColumn("density", r6("density"))


SUMMARY_LOOP = "(CASE WHEN filled <> '' AND filled NOT LIKE 'C%' THEN 'C' || filled ELSE filled END)"


@query("class_property_summary", f"""WITH {LABELLED_SQL}, found AS (
  SELECT *, CASE WHEN length(trim(hseq)) < 20 THEN '' ELSE coalesce(
      regexp_extract_all(h, 'C([A-Z]{{3,30}}?)WG[A-Z]G', 1)[-1], regexp_extract_all(h, 'C([A-Z]{{3,35}}?)WG', 1)[-1], '') END AS loop
  FROM (SELECT *, regexp_replace(upper(hseq), '[- ]', '', 'g') AS h FROM lab)),
f AS (SELECT quality, CASE WHEN lower(trim(cdr3)) IN ('nan','none','null','n/a','na','') THEN loop ELSE cdr3 END AS filled FROM found),
s AS (SELECT quality, {SUMMARY_LOOP} AS s FROM f)
SELECT quality AS class, count(*) AS n, round(avg(length(s)), 6) AS mean_length, round(avg({sql_count('s', 'RK')} - {sql_count('s', 'DE')}), 6) AS mean_charge,
  round(avg({sql_mean('s', K.PARKER)}), 6) AS mean_parker,
  {", ".join(f"round(avg(CASE WHEN regexp_matches(s, '{m}') THEN 1 ELSE 0 END), 6) AS {n}" for n, m in K.LIABILITY_MOTIFS.items())}
FROM s GROUP BY 1""")
def class_property_summary(spark, sf):
    from ..operators.cleaning import ensure_cdr3, fix_c_prefix

    df = fix_c_prefix(ensure_cdr3(labelled(spark, sf))).select(F.col("quality").alias("class"), "cdr3")
    s = F.col("cdr3")
    rate = lambda flag: r6(F.avg(flag.cast("int")))
    return df.groupBy("class").agg(
        F.count("*").alias("n"), r6(F.avg(F.length(s))).alias("mean_length"), r6(F.avg(S.simple_charge(s))).alias("mean_charge"),
        r6(F.avg(S.parker(s))).alias("mean_parker"), *[rate(S.motif_flag(s, m)).alias(m) for m in K.LIABILITY_MOTIFS],
    )


# --- feature tables --------------------------------------------------------

KMER_SQL = "SELECT barcode, {k} AS k, substr(t, i::BIGINT, {k}) AS kmer, length(t) - {k} + 1 AS total FROM (SELECT barcode, t, unnest(range(1, length(t) - {k} + 2)) AS i FROM txt WHERE length(t) >= {k})"


@query("kmer_frequencies", f"""WITH {ANTIBODIES_SQL}, txt AS (SELECT barcode, cdr3 AS t FROM ab), w AS ({KMER_SQL.format(k=1)} UNION ALL {KMER_SQL.format(k=2)})
SELECT barcode, k, kmer, round(count(*) / any_value(total), 6) AS value FROM w GROUP BY 1, 2, 3""")
def kmer_frequencies(spark, sf):
    return X.kmer_table(antibodies(spark, sf), "barcode", F.col("cdr3"), [1, 2]).withColumn("value", r6("value"))


@query("kmer_l2_features", f"""WITH {ANTIBODIES_SQL}, txt AS (SELECT barcode, 'C' || cdr3 || 'W' AS t FROM ab WHERE length(cdr3) >= 4),
w AS ({KMER_SQL.format(k=1)} UNION ALL {KMER_SQL.format(k=2)} UNION ALL {KMER_SQL.format(k=3)}),
c AS (SELECT barcode, kmer, count(*) AS n FROM w GROUP BY 1, 2)
SELECT barcode, kmer, round(n / sqrt(sum(n * n) OVER (PARTITION BY barcode)), 6) AS value FROM c""")
def kmer_l2_features(spark, sf):
    return X.kmer_l2_table(antibodies(spark, sf), "barcode", "cdr3").withColumn("value", r6("value"))


@query("kmer_l2_vectors", f"""WITH {ANTIBODIES_SQL}, txt AS (SELECT barcode, 'C' || cdr3 || 'W' AS t FROM ab WHERE length(cdr3) >= 4),
w AS ({KMER_SQL.format(k=1)} UNION ALL {KMER_SQL.format(k=2)} UNION ALL {KMER_SQL.format(k=3)}),
c AS (SELECT barcode, kmer, count(*) AS n FROM w GROUP BY 1, 2)
SELECT barcode, coalesce(k.d, 0) AS filled, round(coalesce(k.s, 0), 6) AS total FROM ab LEFT JOIN (
  SELECT barcode, count(*) AS d, sum(n) / sqrt(sum(n * n)) AS s FROM c GROUP BY 1) k USING (barcode)""")
def kmer_l2_vectors(spark, sf):
    out = X.kmer_l2_vectors(antibodies(spark, sf).select("barcode", "cdr3"), "cdr3", "v")
    v = F.unwrap_udt("v")
    total = F.aggregate(v["values"], F.lit(0.0), lambda s, x: s + x)
    return out.select("barcode", F.size(v["indices"]).cast("long").alias("filled"), r6(total).alias("total"))


NEIGHBOUR_CASE = "CASE substr(t, i::BIGINT, 2) " + " ".join(f"WHEN '{x}{y}' THEN {v}" for (x, y), v in K.triangle(K.BLOSUM62).items()) + " ELSE -4 END::DOUBLE"


@query("kmer_l2_blosum", f"""WITH {ANTIBODIES_SQL}, txt AS (SELECT barcode, 'C' || cdr3 || 'W' AS t FROM ab WHERE length(cdr3) >= 4),
w AS ({KMER_SQL.format(k=1)} UNION ALL {KMER_SQL.format(k=2)} UNION ALL {KMER_SQL.format(k=3)}),
c AS (SELECT barcode, k, kmer, count(*) AS n FROM w GROUP BY ALL),
u AS (SELECT barcode, sum(n) / sqrt(sum(n * n)) AS words, sum(n) FILTER (k = 1) / sqrt(sum(n * n) FILTER (k = 1)) AS singles, count(*) + count(*) FILTER (k = 1) AS filled FROM c GROUP BY 1),
b AS (SELECT barcode, avg({NEIGHBOUR_CASE}) AS b FROM (SELECT barcode, t, unnest(range(1, length(t))) AS i FROM txt) GROUP BY 1),
v AS (SELECT barcode, coalesce(words, 0) AS words, coalesce(singles, 0) AS singles, coalesce(filled, 0) AS filled, coalesce(b, 0) AS b FROM ab LEFT JOIN u USING (barcode) LEFT JOIN b USING (barcode))
SELECT barcode, filled + CAST(b <> 0 AS INTEGER) AS filled, CASE WHEN filled = 0 THEN 0 ELSE round((words + singles + b) / sqrt(2 + b * b), 6) END AS total,
  CASE WHEN filled = 0 THEN 0 ELSE round(b / sqrt(2 + b * b), 6) END AS blosum FROM v""")
def kmer_l2_blosum(spark, sf):
    """k-mers, residues and the mean score of neighbours, each of unit length, in one vector of unit length."""
    out = X.kmer_l2_vectors(antibodies(spark, sf).select("barcode", "cdr3"), "cdr3", "v", use_blosum=True)
    # only the places that are stored: of 8,441 a loop fills a few dozen
    out = out.select("barcode", F.unwrap_udt("v").alias("v"))
    x, size = F.col("v")["values"], F.size(F.col("v")["values"])
    ends = (F.col("v")["type"] == 1) | (F.get(F.col("v")["indices"], size - 1) == F.col("v")["size"] - 1)
    total = F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    filled = F.size(F.filter(x, lambda y: y != 0)).cast("long")
    return out.select("barcode", filled.alias("filled"), r6(total).alias("total"), r6(F.when(ends, F.get(x, size - 1)).otherwise(0.0)).alias("blosum"))


@query("one_hot", f"""WITH {ANTIBODIES_SQL} SELECT barcode, CAST(i AS INTEGER) AS pos, substr(cdr3, i::BIGINT, 1) AS aa
FROM (SELECT barcode, cdr3, unnest(range(1, least(length(cdr3), 25) + 1)) AS i FROM ab)""")
def one_hot(spark, sf):
    return X.one_hot_table(antibodies(spark, sf), "barcode", F.col("cdr3"), 25)


@query("fit_max_lengths", f"""WITH {ANTIBODIES_SQL} SELECT max(length(hseq)) AS vh, 130 AS vl, max(length(cdr3)) AS hcdr3,
count(*) FILTER (length(lseq) > 130) AS truncated_vl FROM ab""")
def fit_max_lengths(spark, sf):
    ab = antibodies(spark, sf)
    fitted = X.max_lengths(ab, {"vh": "hseq", "vl": "lseq", "hcdr3": "cdr3"}, {"vl": 130})
    cut = X.truncated_counts(ab, {"truncated_vl": "lseq"}, {"truncated_vl": 130})
    from ..operators.ordered import join_small

    return join_small(fitted, cut, [])


def sql_places(seq: str, most: int, before: int = 0) -> str:
    """One-hot places of a sequence's first residues, as a list."""
    return f"list_transform(range(least(length({seq}), {most})), lambda i: ({before} + i) * 20 + position(substr({seq}, i + 1, 1) IN '{K.AMINO_ACIDS}') - 1)"


@query("two_branch_encoding", f"""WITH {ANTIBODIES_SQL}, p AS (SELECT barcode, list_concat({sql_places('hseq', 135)}, {sql_places('lseq', 135, 135)}) AS chain, {sql_places('cdr3', 25)} AS loop FROM ab)
SELECT barcode, 270 * 20 AS chain_size, len(chain) AS chain_set, md5(array_to_string(chain, ',')) AS chain_places, 500 AS cdr3_size, len(loop) AS cdr3_set, array_to_string(loop, ',') AS cdr3_places FROM p""")
def two_branch_encoding(spark, sf):
    out = X.two_branch_vectors(antibodies(spark, sf))
    n = lambda c: F.size(F.unwrap_udt(c)["indices"])
    size = lambda c: F.unwrap_udt(c)["size"]
    places = lambda c: F.array_join(F.unwrap_udt(c)["indices"].cast("array<string>"), ",")
    return out.select("barcode", size("chain_features").alias("chain_size"), n("chain_features").alias("chain_set"), F.md5(places("chain_features")).alias("chain_places"),
                      size("cdr3_features").alias("cdr3_size"), n("cdr3_features").alias("cdr3_set"), places("cdr3_features").alias("cdr3_places"))


BUILT_SQL = f"""bi AS (SELECT ab.*, embedding FROM ab JOIN emb USING (barcode)), txt AS (SELECT barcode, cdr3 AS t FROM bi),
kw AS ({KMER_SQL.format(k=1)} UNION ALL {KMER_SQL.format(k=2)}),
parts AS (SELECT barcode, {FIVE_COUNTS} FROM bi WHERE cdr3 <> ''), {sql_halving('parts', FEATURE_PI_SQL, 0, 14, 7, 60)},
plain AS (SELECT barcode, 'cdr3_length' AS feature, length(cdr3)::DOUBLE AS value FROM bi
  UNION ALL SELECT barcode, 'cdr3_pi', round(ph, 3) FROM solved
  UNION ALL SELECT barcode, 'cdr3_charge', round({sql_scale('cdr3', FEATURE_CHARGE)}, 4) FROM bi
  UNION ALL SELECT barcode, 'cdr3_hydrophobicity', round({sql_mean('cdr3', K.KYTE_DOOLITTLE)}, 4) FROM bi
  UNION ALL SELECT barcode, 'cdr3_R', {sql_count('cdr3', 'R')} FROM bi UNION ALL SELECT barcode, 'cdr3_D', {sql_count('cdr3', 'D')} FROM bi UNION ALL SELECT barcode, 'cdr3_W', {sql_count('cdr3', 'W')} FROM bi),
letters_at AS (SELECT barcode, prefix || '_' || i || '_' || substr(s, i::BIGINT, 1) AS feature FROM (
  SELECT barcode, prefix, s, unnest(range(1, length(s) + 1)) AS i FROM (SELECT barcode, 'oh_vh' AS prefix, hseq AS s FROM bi UNION ALL SELECT barcode, 'oh_vl', lseq FROM bi))),
built AS (SELECT barcode, 'emb_' || (i - 1) AS feature, x::DOUBLE AS value FROM (SELECT barcode, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM bi)
  UNION ALL SELECT barcode, k || 'mer_' || kmer, count(*) / any_value(total)::DOUBLE FROM kw GROUP BY barcode, k, kmer
  UNION ALL SELECT * FROM plain UNION ALL SELECT barcode, feature, 1 FROM letters_at)"""


@query("feature_builder", f"""WITH RECURSIVE {ANTIBODIES_SQL}, {EMBEDDINGS_SQL}, {BUILT_SQL}
SELECT barcode, feature, round(value, CASE WHEN feature = 'cdr3_hydrophobicity' THEN 3 ELSE 6 END) AS value FROM built WHERE abs(value) >= 0.0000005""")
def feature_builder(spark, sf):
    """All features of a row that are not zero, by the name that the builder gives to their place."""
    df = antibodies(spark, sf).join(embeddings(spark, sf), "barcode")
    config = X.FeatureConfig(embedding=True, kmer=True, biophysical=True, onehot=True, onehot_sequence="VHVL")
    builder = X.FeatureBuilder(config).fit(df)
    out = builder.transform(df.select("barcode", "hseq", "lseq", "cdr3", "embedding"))
    v = F.unwrap_udt("features")
    names = spark.createDataFrame(list(enumerate(builder.feature_names)), "i int, feature string")  # as many as a vector has places
    dense = v["type"] == 1
    pairs = F.arrays_zip(F.when(dense, F.sequence(F.lit(0), F.size(v["values"]) - 1)).otherwise(v["indices"]).alias("i"), v["values"].alias("x"))
    long = out.select("barcode", F.explode(pairs).alias("p")).select("barcode", "p.i", r6("p.x").alias("value")).where("value <> 0")
    # the builder rounds to four digits, where means over sixteen residues are ties; three digits do not depend on their side
    value = F.when(F.col("feature") == "cdr3_hydrophobicity", F.round("value", 3)).otherwise(F.col("value"))
    return long.join(F.broadcast(names), "i").select("barcode", "feature", value.alias("value"))


Z_SQL = "round((({c}) - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END, 6)"


@query("standardize", f"""WITH {LABELLED_SQL} SELECT barcode, {Z_SQL.format(c='score')} AS score, {Z_SQL.format(c='length(lseq)')} AS n, 0::DOUBLE AS flat FROM lab""")
def standardize(spark, sf):
    df = labelled(spark, sf).select("barcode", "score", F.length("lseq").alias("n"), F.lit(3.0).alias("flat"))
    return X.standardize(df, ["score", "n", "flat"]).withColumns({"score": r6("score"), "n": r6("n")})


@query("standardize_embeddings", """WITH d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
z AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i) AS z FROM d)
SELECT vec_id || '-0' AS barcode, round(sum(z), 4) AS total, round(sum(z * z), 4) AS square FROM z GROUP BY 1""")
def standardize_embeddings(spark, sf):
    out = X.standardize_vectors(embeddings(spark, sf).withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding", "barcode")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return out.select("barcode", F.round(total, 4).alias("total"), F.round(square, 4).alias("square"))


@query("pca")
def pca(spark, sf):
    return X.pca_scores(embeddings(spark, sf), "embedding", "barcode", 10)


@query("pca_distances", """WITH d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
z AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY i)) / CASE WHEN stddev_pop(x) OVER (PARTITION BY i) > 0 THEN stddev_pop(x) OVER (PARTITION BY i) ELSE 1 END AS z FROM d)
SELECT vec_id || '-0' AS barcode, round(sum(z * z), 4) AS square, 0.0::DOUBLE AS largest_covariance, true AS descending FROM z GROUP BY 1""")
def pca_distances(spark, sf):
    """All components: they keep the length of each vector, are uncorrelated, and their variances fall."""
    vectors = embeddings(spark, sf)
    scores = cut_lineage(X.pca_scores(vectors, "embedding", "barcode", 64))
    long = scores.select("barcode", F.posexplode("components").alias("i", "x"))
    size = long.agg(F.max("i") + 1).first()[0]
    at = lambda i: F.get("components", F.lit(i))
    spread = scores.agg(*[F.covar_pop(at(i), at(j)).alias(f"c{i}_{j}") for i in range(size) for j in range(i, min(size, i + 2))]).first()
    aside = max((abs(spread[f"c{i}_{i + 1}"]) for i in range(size - 1)), default=0.0)
    falls = all(spread[f"c{i}_{i}"] >= spread[f"c{i + 1}_{i + 1}"] - 1e-9 for i in range(size - 1))
    square = F.aggregate("components", F.lit(0.0), lambda s, x: s + x * x)
    return scores.select("barcode", F.round(square, 4).alias("square"), F.lit(round(aside, 6)).alias("largest_covariance"), F.lit(falls).alias("descending"))


@query("mean_pool", """WITH d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
t AS (SELECT vec_id, i // 8 AS token, i % 8 AS dim, x FROM d)
SELECT vec_id, dim, round(sum(x) / greatest(count(*), 1), 6) AS value FROM t WHERE (vec_id + token) % 3 <> 0 GROUP BY 1, 2""")
def mean_pool(spark, sf):
    e = F.col("embedding").cast("array<double>")
    df = table(spark, sf, "embeddings").select(
        "vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(e, i * 8 + 1, 8)).alias("tokens"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.col("vec_id") + i) % 3 != 0).cast("int")).alias("mask"),
    )
    pooled = df.select("vec_id", F.posexplode(V.masked_mean(F.col("tokens"), F.col("mask"), 8)).alias("dim", "value"))
    return pooled.withColumn("value", r6("value"))


@query("average_chains", """WITH p AS (SELECT vec_id, embedding AS h, lead(embedding) OVER (ORDER BY vec_id) AS l FROM embeddings),
d AS (SELECT vec_id, unnest(h)::DOUBLE AS h, unnest(coalesce(l, h))::DOUBLE AS l FROM p)
SELECT vec_id, round(sum((h + l) / 2), 4) AS total FROM d GROUP BY 1""")
def average_chains(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("h"))
    light = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("l"))
    mean = e.join(light, "vec_id", "left").select("vec_id", V.average_chains(F.col("h"), F.col("l")).alias("v"))
    return mean.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("embed_batch", f"""WITH {ANTIBODIES_SQL}, {EMBEDDINGS_SQL} SELECT barcode, 'demo' AS lm, 32 AS dim, true AS unit FROM ab WHERE barcode NOT IN (SELECT barcode FROM emb)""")
def embed_batch(spark, sf):
    ab = antibodies(spark, sf)
    done = embeddings(spark, sf).select("barcode", F.lit("demo").alias("lm"))
    out = embed_sequences(ab, hashed_kmer_model(32), 32, "demo", existing=done)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return out.select("barcode", "lm", F.size("embedding").alias("dim"), (F.abs(norm - 1) < 1e-5).alias("unit"))
