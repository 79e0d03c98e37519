"""Queries over similarity, clusters, splits, mutants, selection rounds and models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vectors as V
from ..models import anomaly, explain, training as M, tree_shap
from ..operators import clustering as C, mutants as U, nearest, ngs as N, similarity as S, splits as P
from ..operators.features import FeatureConfig, kmer_l2_vectors
from ..operators.ordered import curve_areas, join_small, roc_points
from ..session import cut_lineage, dealt
from .catalog import query
from .inputs import ANTIBODIES_SQL, CLONES_SQL, LABELLED_SQL, PREVIOUS_SQL, antibodies, clones, labelled, previous, r6

# --- pair jobs --------------------------------------------------------------

LOOPS_SQL = "loops AS (SELECT min(row_id) AS id, cdr3 AS seq FROM ab WHERE cdr3 <> '' GROUP BY cdr3)"


def loops(spark, sf):
    return antibodies(spark, sf).where("cdr3 <> ''").groupBy(F.col("cdr3").alias("seq")).agg(F.min("row_id").alias("id"))


@query("levenshtein_pairs", f"""WITH {ANTIBODIES_SQL}, {LOOPS_SQL}
SELECT a.id AS a, b.id AS b, levenshtein(a.seq, b.seq) AS distance FROM loops a JOIN loops b ON a.id < b.id AND abs(length(a.seq) - length(b.seq)) <= 3
WHERE levenshtein(a.seq, b.seq) <= 3""")
def levenshtein_pairs(spark, sf):
    return S.levenshtein_pairs(loops(spark, sf), 3)


@query("similarity_join", f"""WITH {LABELLED_SQL}, {LOOPS_SQL}, {PREVIOUS_SQL},
n AS (SELECT l.seq, min(levenshtein(l.seq, p.cdr3)) AS d FROM loops l, prev p GROUP BY 1)
SELECT loops.seq, coalesce(d, 999) AS nearest FROM loops LEFT JOIN n USING (seq)""")
def similarity_join(spark, sf):
    known = previous(spark, sf).withColumnRenamed("cdr3", "seq")
    return nearest.nearest_previous(loops(spark, sf).select("seq"), known, "seq").select("seq", "nearest")


BLOSUM_CASE = "CASE substr(a, i::BIGINT, 1) || substr(b, i::BIGINT, 1) " + " ".join(
    f"WHEN '{x}{y}' THEN {v}" for (x, y), v in K.triangle(K.BLOSUM62).items()) + " ELSE -4 END"


@query("max_blosum_similarity", f"""WITH {LABELLED_SQL}, {LOOPS_SQL}, {PREVIOUS_SQL}, p AS (SELECT seq, cdr3, seq AS a, cdr3 AS b FROM loops, prev),
s AS (SELECT seq, cdr3, sum({BLOSUM_CASE}) / count(*) AS s FROM (SELECT *, unnest(range(1, least(length(a), length(b)) + 1)) AS i FROM p) GROUP BY 1, 2)
SELECT loops.seq, round(coalesce(max(s), -999), 6) AS max_similarity FROM loops LEFT JOIN s USING (seq) GROUP BY 1""")
def max_blosum_similarity(spark, sf):
    known = previous(spark, sf).withColumnRenamed("cdr3", "seq")
    return nearest.most_similar(loops(spark, sf).select("seq"), known, "seq").select("seq", r6("max_similarity").alias("max_similarity"))


def neighbours(spark, sf, step=1):
    """Each loop with the one ``step`` pieces further on in its document."""
    ab = antibodies(spark, sf).select("barcode", "doc_id", "tile", "cdr3")
    other = ab.select("doc_id", (F.col("tile") - step).alias("tile"), F.col("cdr3").alias("b"))
    return ab.join(other, ["doc_id", "tile"]).select("barcode", F.col("cdr3").alias("a"), "b")


NEIGHBOUR_SQL = "pairs AS (SELECT x.barcode, x.cdr3 AS a, y.cdr3 AS b FROM ab x JOIN ab y ON x.doc_id = y.doc_id AND y.tile = x.tile + 1)"


@query("blosum_prefix_similarity", f"""WITH {ANTIBODIES_SQL}, {NEIGHBOUR_SQL},
s AS (SELECT barcode, sum({BLOSUM_CASE})::DOUBLE AS s, count(*) AS n FROM (SELECT *, unnest(range(1, least(length(a), length(b)) + 1)) AS i FROM pairs) GROUP BY 1)
SELECT barcode, CASE WHEN least(length(a), length(b)) > 0 THEN round(s / n, 6) ELSE -10 END AS similarity FROM pairs LEFT JOIN s USING (barcode)""")
def blosum_prefix_similarity(spark, sf):
    return neighbours(spark, sf).select("barcode", r6(V.prefix_similarity(F.col("a"), F.col("b"))).alias("similarity"))


@query("blosum_distance_same_len", f"""WITH {ANTIBODIES_SQL}, {NEIGHBOUR_SQL.replace("+ 1", "+ 9")}, p AS (SELECT barcode, a, b FROM pairs WHERE length(a) = length(b) AND a <> '')
SELECT barcode, 4 * any_value(length(a)) - sum({BLOSUM_CASE})::DOUBLE AS distance FROM (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM p) GROUP BY 1""")
def blosum_distance_same_len(spark, sf):
    pairs = neighbours(spark, sf, 9).where((F.length("a") == F.length("b")) & (F.col("a") != ""))  # loop lengths recur every nine pieces
    return pairs.select("barcode", V.same_length_distance(F.col("a"), F.col("b")).alias("distance"))


def alignment_sql(source: str, key: str, matrix: str, unknown: int, gap_open: int, gap_extend: int) -> str:
    """CTE ``aligned`` (key, a, b, score): global alignments with affine gaps of the pairs (key, a, b) of ``source``.

    Cells are filled one anti-diagonal at a time; h0 and h1 are the last two diagonals, f and e the best
    scores that end in a gap in b or in a, all by the place in b.
    """
    cells = K.triangle(matrix)
    letters = [chr(65 + i) for i in range(26)]
    score = "[" + ", ".join(str(cells.get((x, y), unknown)) for x in letters for y in letters) + "]"
    gap = lambda n: f"({gap_open} + ({n} - 1) * ({gap_extend}))"
    low, i = -1000000, "(d + 1 - j)"
    match = f"h0[j] + {score}[(ascii(substr(a, {i}, 1)) - 65) * 26 + ascii(substr(b, j, 1)) - 64]"
    inside = f"{i} >= 1 AND {i} <= length(a)"
    down = f"CASE WHEN j >= 1 AND {inside} THEN greatest(h1[j + 1] + ({gap_open}), f[j + 1] + ({gap_extend})) ELSE {low} END"
    right = f"CASE WHEN j >= 1 AND {inside} THEN greatest(h1[j] + ({gap_open}), e[j] + ({gap_extend})) ELSE {low} END"
    best = (f"CASE WHEN {i} < 0 OR {i} > length(a) THEN {low} WHEN j = 0 THEN {gap(i)} WHEN {i} = 0 THEN {gap('j')} "
            f"ELSE greatest({match}, {down}, {right}) END")
    over = lambda x: f"list_transform(range(length(b) + 1), lambda j: {x})"
    return f"""walk AS (SELECT {key}, a, b, 0::BIGINT AS d, {over(f'{low}')} AS h0, {over(f'CASE WHEN j = 0 THEN 0 ELSE {low} END')} AS h1, {over(f'{low}')} AS f, {over(f'{low}')} AS e FROM {source}
  UNION ALL SELECT {key}, a, b, d + 1, h1, {over(best)}, {over(down)}, {over(right)} FROM walk WHERE d < length(a) + length(b)),
aligned AS (SELECT {key}, a, b, h1[length(b) + 1] AS score FROM walk WHERE d = length(a) + length(b))"""


@query("blosum_global_distance", f"""WITH RECURSIVE {ANTIBODIES_SQL}, {NEIGHBOUR_SQL}, filled AS (SELECT * FROM pairs WHERE a <> '' AND b <> ''),
{alignment_sql('filled', 'barcode', K.BLOSUM62, -4, -10, -1)}
SELECT barcode, round((4 * least(length(a), length(b)) - score) / (4.0::DOUBLE * least(length(a), length(b))), 6) AS distance FROM aligned""")
def blosum_global_distance(spark, sf):
    pairs = neighbours(spark, sf).where("a <> '' and b <> ''").select("barcode", F.col("a").alias("seq_a"), F.col("b").alias("seq_b"))
    return S.with_global_distance(pairs).select("barcode", r6("distance").alias("distance"))


PAM30_SELF = {x: v for (x, y), v in K.triangle(K.PAM30).items() if x == y}
PAM30_OWN_SQL = "(" + " + ".join(f"(length(seq) - length(replace(seq, '{x}', ''))) * {v}" for x, v in PAM30_SELF.items()) + ")"
#: Every edit costs a pair at least this much against the mean of both self scores: a swap, or half a residue and a gap step.
PAM30_EDIT = min(min((PAM30_SELF[x] + PAM30_SELF[y]) / 2 - v for (x, y), v in K.triangle(K.PAM30).items() if x != y), min(PAM30_SELF.values()) / 2 + 1)


@query("pam30_loop_pairs", f"""WITH RECURSIVE {ANTIBODIES_SQL}, {LOOPS_SQL},
full_loops AS (SELECT id, CASE WHEN length(seq) < 5 THEN repeat('C', 37) ELSE seq END AS seq FROM loops),
texts AS (SELECT min(id) AS id, substr(seq, 3, length(seq) - 4) AS seq FROM full_loops GROUP BY 2),
able AS MATERIALIZED (SELECT id, seq, {PAM30_OWN_SQL} AS own FROM texts WHERE {PAM30_OWN_SQL} >= 75),
near AS MATERIALIZED (SELECT least(x.id, y.id) || '/' || greatest(x.id, y.id) AS pair, least(x.id, y.id) AS ida, greatest(x.id, y.id) AS idb, x.seq AS a, y.seq AS b FROM able x JOIN able y
  ON x.id < y.id AND levenshtein(x.seq, y.seq) <= ((x.own + y.own) / 2.0 - 75) / {PAM30_EDIT}),
{alignment_sql('near', 'pair, ida, idb', K.PAM30, -17, -9, -1)}
SELECT ida AS a, idb AS b, CAST(score AS INTEGER) AS score FROM aligned WHERE score >= 75""")
def pam30_loop_pairs(spark, sf):
    texts = loops(spark, sf).select("id", S.loop_text(F.col("seq")).alias("seq")).groupBy("seq").agg(F.min("id").alias("id"))
    return S.loop_score_pairs(texts, 75).select("a", "b", "score")


@query("top_distance_pairs", f"""WITH {CLONES_SQL}, t AS (SELECT cdr3, score, row_number() OVER (ORDER BY score DESC, cdr3) AS rank FROM clones QUALIFY rank <= 50)
SELECT CAST(a.rank AS INTEGER) AS rank_a, CAST(b.rank AS INTEGER) AS rank_b, levenshtein(a.cdr3, b.cdr3) AS distance FROM t a JOIN t b ON a.rank < b.rank""")
def top_distance_pairs(spark, sf):
    return S.top_pairs(clones(spark, sf), "cdr3", "score")[1]


@query("top_mapping", f"""WITH {CLONES_SQL} SELECT CAST(row_number() OVER (ORDER BY score DESC, cdr3) AS INTEGER) AS rank, cdr3 AS seq, score FROM clones QUALIFY rank <= 50""")
def top_mapping(spark, sf):
    return S.top_pairs(clones(spark, sf), "cdr3", "score")[0]


# --- clusters ----------------------------------------------------------------

@query("greedy_cluster")
def greedy_cluster(spark, sf):
    return C.greedy_cluster(antibodies(spark, sf), "cdr3", "row_id", 0.8).select("barcode", "cluster")


@query("cluster_by_vh")
def cluster_by_vh(spark, sf):
    return C.cluster_by(labelled(spark, sf), "VH", "row_id").select("barcode", F.col("`VH_CLUSTER_0.8`").alias("cluster"))


@query("cluster_by_vhvl")
def cluster_by_vhvl(spark, sf):
    return C.cluster_by(labelled(spark, sf), "VHVL", "row_id").select("barcode", F.col("`VHVL_CLUSTER_0.8`").alias("cluster"))


@query("complete_linkage")
def complete_linkage(spark, sf):
    return C.complete_linkage(clones(spark, sf), "cdr3", "row_id", 1e-4).select("barcode", "cluster")


@query("greedy_cluster_violations", f"""WITH {ANTIBODIES_SQL} SELECT count(*) AS n_rows, count(DISTINCT cdr3) AS n_strings, 0::BIGINT AS misplaced, 0::BIGINT AS misnumbered FROM ab""")
def greedy_cluster_violations(spark, sf):
    out = cut_lineage(C.greedy_cluster(antibodies(spark, sf), "cdr3", "row_id", 0.8).select("cdr3", "row_id", "cluster"))
    return C.leader_violations(out, "cdr3", "row_id", "cluster", 0.8)


def chain_violations(spark, sf, column, text):
    name = f"{column}_CLUSTER_0.8"
    out = C.cluster_by(labelled(spark, sf), column, "row_id").select(text.alias("text"), "row_id", F.col(f"`{name}`").alias("cluster"))
    return C.leader_violations(cut_lineage(out), "text", "row_id", "cluster", 0.8)


@query("cluster_by_vh_violations", f"""WITH {LABELLED_SQL} SELECT count(*) AS n_rows, count(DISTINCT hseq) AS n_strings, 0::BIGINT AS misplaced, 0::BIGINT AS misnumbered FROM lab""")
def cluster_by_vh_violations(spark, sf):
    return chain_violations(spark, sf, "VH", F.col("hseq"))


@query("cluster_by_vhvl_violations", f"""WITH {LABELLED_SQL} SELECT count(*) AS n_rows, count(DISTINCT hseq || '_' || lseq) AS n_strings, 0::BIGINT AS misplaced,
  0::BIGINT AS misnumbered FROM lab""")
def cluster_by_vhvl_violations(spark, sf):
    return chain_violations(spark, sf, "VHVL", F.concat_ws("_", "hseq", "lseq"))


@query("complete_linkage_violations", f"""WITH {CLONES_SQL} SELECT count(*) AS n_rows, 0::BIGINT AS missing_links, 0::BIGINT AS mergeable FROM clones""")
def complete_linkage_violations(spark, sf):
    out = cut_lineage(C.complete_linkage(clones(spark, sf), "cdr3", "row_id", 1e-4).select("cdr3", "row_id", "cluster"))
    return C.linkage_violations(out, "cdr3", "row_id", 1e-4)


CLUSTERED_SQL = CLONES_SQL + """, cl AS (SELECT barcode, row_id, cdr3 AS cdr3_aa, germline AS vh_scaffold, germline AS vl_scaffold, macs AS count, macs / sum(macs) OVER () AS freq,
  row_id AS rank, doc_id % 50 AS cluster, regexp_matches(cdr3, 'RR') AS l_RR FROM clones)"""


def clustered(spark, sf):
    df = clones(spark, sf)
    total = df.agg(F.sum("macs").alias("t")).scalar()
    return df.select(
        "barcode", "row_id", F.col("cdr3").alias("cdr3_aa"), F.col("germline").alias("vh_scaffold"), F.col("germline").alias("vl_scaffold"),
        F.col("macs").alias("count"), (F.col("macs") / total).alias("freq"), F.col("row_id").alias("rank"),
        (F.col("doc_id") % 50).alias("cluster"), F.col("cdr3").rlike("RR").alias("l_RR"),
    )


@query("consolidate_clusters", f"""WITH {CLUSTERED_SQL}, g AS (SELECT cluster, arg_min(cdr3_aa, row_id) AS cdr3_aa_first, arg_min(vh_scaffold, row_id) AS vh_scaffold_first,
  arg_min(vl_scaffold, row_id) AS vl_scaffold_first, arg_min(rank, row_id) AS rank_first, arg_min(count, row_id) AS count_first, round(arg_min(freq, row_id), 9) AS freq_first,
  arg_min(l_RR, row_id) AS l_RR_first, CAST(sum(count) AS BIGINT) AS count_sum, round(sum(freq), 9) AS freq_sum, count(*) AS n_seqs FROM cl GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY count_sum DESC, cluster) AS rank_cluster FROM g""")
def consolidate_clusters(spark, sf):
    out = C.consolidate_clusters(clustered(spark, sf).withColumn("freq", F.col("freq")), "row_id")
    return out.withColumns({"freq_first": F.round("freq_first", 9), "freq_sum": F.round("freq_sum", 9)})


@query("cluster_sizes", f"WITH {CLUSTERED_SQL} SELECT cluster, count(*) AS n FROM cl GROUP BY 1")
def cluster_sizes(spark, sf):
    return C.cluster_sizes(clustered(spark, sf))


@query("cluster_summary", f"""WITH {CLUSTERED_SQL}, s AS (SELECT cluster, count(*) AS n FROM cl GROUP BY 1)
SELECT count(*) AS n_clusters, round(avg(n), 6) AS mean_size, max(n) AS max_size FROM s""")
def cluster_summary(spark, sf):
    return C.cluster_summary(clustered(spark, sf)).withColumn("mean_size", r6("mean_size"))


def leads_sql(score: float, near: str) -> str:
    """The sequential choice: in order of score a clone is kept if it is near no known and no kept loop."""
    return f"""WITH RECURSIVE {LABELLED_SQL}{CLONES_SQL[len(ANTIBODIES_SQL):]}, {PREVIOUS_SQL},
cpm AS (SELECT *, facs1 * 1000000.0 / (SELECT sum(facs1) FROM clones) AS cpm FROM clones),
firsts AS (SELECT arg_min(barcode, (-score, barcode)) AS barcode, max(score) AS score, cdr3 AS seq FROM cpm WHERE score >= {score} AND cpm >= 100 AND length(cdr3) >= 4 GROUP BY cdr3),
queue AS MATERIALIZED (SELECT barcode, seq, row_number() OVER (ORDER BY score DESC, barcode) AS i FROM firsts WHERE NOT EXISTS (SELECT 1 FROM prev WHERE {near.format(a='cdr3', b='seq')})),
near AS (SELECT y.i, list(x.i) AS others FROM queue x JOIN queue y ON x.i < y.i AND {near.format(a='x.seq', b='y.seq')} GROUP BY y.i),
turn AS MATERIALIZED (SELECT i, barcode, coalesce(others, []) AS others FROM queue LEFT JOIN near USING (i)),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept, NULL::VARCHAR AS took
  UNION ALL SELECT turn.i, CASE WHEN list_has_any(kept, others) THEN kept ELSE list_append(kept, turn.i) END, CASE WHEN NOT list_has_any(kept, others) THEN barcode END
  FROM walk JOIN turn ON turn.i = walk.i + 1)
"""


CELLS = "MAP {" + ", ".join(f"'{x}{y}': {v}" for (x, y), v in K.triangle(K.BLOSUM62).items()) + "}"
ALIKE = ("list_sum(list_transform(range(1, least(length({a}), length({b})) + 1), lambda p: coalesce(" + CELLS.replace("{", "{{").replace("}", "}}")
         + "[substr({a}, p, 1) || substr({b}, p, 1)], -4))) / least(length({a}), length({b})) > 1.5")


@query("select_diverse_leads", leads_sql(0.5, "levenshtein({a}, {b}) < 5") + """
SELECT barcode, round(cpm, 4) AS cpm, barcode IN (SELECT took FROM walk WHERE took IS NOT NULL) AS selected FROM cpm""")
def select_diverse_leads(spark, sf):
    out = C.select_diverse_leads(clones(spark, sf), previous(spark, sf), "score", "barcode", min_score=0.5, min_cpm=100)
    return out.select("barcode", F.round("cpm", 4).alias("cpm"), "selected")


@query("select_diverse_leads_blosum", leads_sql(0.9, ALIKE) + """
SELECT barcode, barcode IN (SELECT took FROM walk WHERE took IS NOT NULL) AS selected FROM cpm""")
def select_diverse_leads_blosum(spark, sf):
    out = C.select_diverse_leads(clones(spark, sf), previous(spark, sf), "score", "barcode", metric="blosum", min_score=0.9, min_cpm=100)
    return out.select("barcode", "selected")


# --- splits ------------------------------------------------------------------

def grouped(spark, sf):
    return labelled(spark, sf).select("barcode", "doc_id", "quality", F.concat_ws("/", "antigen", "germline", (F.col("doc_id") % 7).cast("string")).alias("cluster"), "score")


FOLDS_SQL = """grp AS (SELECT barcode, quality, 'group:' || antigen || '/' || germline || '/' || (doc_id % 7) AS unit FROM lab),
unit AS (SELECT unit, count(*) AS size, CAST(avg(CAST(quality = 1 AS INTEGER)) > 0.5 AS INTEGER) AS stratum FROM grp GROUP BY 1),
k AS (SELECT least(5, count(*)) AS k FROM unit),
seat AS (SELECT unit, k, row_number() OVER (PARTITION BY stratum ORDER BY size DESC, md5(unit || ':42'), unit) - 1 AS p FROM unit, k),
folds AS (SELECT barcode, quality, substr(unit, 7) AS cluster, CAST(CASE WHEN (p // k) % 2 = 0 THEN p % k ELSE k - 1 - p % k END AS INTEGER) AS fold FROM grp JOIN seat USING (unit))"""


@query("group_stratified_folds", f"WITH {LABELLED_SQL}, {FOLDS_SQL} SELECT barcode, cluster, fold FROM folds")
def group_stratified_folds(spark, sf):
    return P.group_stratified_folds(grouped(spark, sf), "quality", "cluster", "barcode", 5).select("barcode", "cluster", "fold")


@query("group_holdout", f"""WITH {LABELLED_SQL}, {FOLDS_SQL},
r AS (SELECT fold, avg(CAST(quality = 1 AS INTEGER)) AS rate FROM folds GROUP BY 1), w AS (SELECT avg(CAST(quality = 1 AS INTEGER)) AS whole FROM folds),
b AS (SELECT fold AS best FROM r, w ORDER BY abs(rate - whole), fold LIMIT 1)
SELECT barcode, cluster, CASE WHEN fold = best THEN 'val' ELSE 'train' END AS side FROM folds, b""")
def group_holdout(spark, sf):
    return P.group_holdout(grouped(spark, sf), "quality", "cluster", "barcode").select("barcode", "cluster", "side")


SIDES_SQL = "sides AS (SELECT barcode, antigen, quality, CASE WHEN fold = 0 THEN 'val' ELSE 'train' END AS side FROM lab)"


@query("leakage_report", f"""WITH {LABELLED_SQL}, {SIDES_SQL}, g AS (SELECT antigen, count(DISTINCT side) AS s FROM sides GROUP BY 1)
SELECT count(*) AS n_clusters, count(*) FILTER (s > 1) AS leaked FROM g""")
def leakage_report(spark, sf):
    df = labelled(spark, sf).withColumn("side", F.when(F.col("fold") == 0, "val").otherwise("train"))
    return P.leakage_report(df, "antigen")


@query("assign_unlabelled", f"""WITH {LABELLED_SQL}, {SIDES_SQL}, g AS (SELECT antigen, bool_or(side = 'train') AS tr, bool_or(side = 'val') AS va FROM sides GROUP BY 1)
SELECT barcode, CASE WHEN va AND NOT tr THEN 'val' ELSE 'train' END AS side FROM ab LEFT JOIN g USING (antigen) WHERE barcode NOT IN (SELECT barcode FROM lab)""")
def assign_unlabelled(spark, sf):
    lab = labelled(spark, sf)
    sides = lab.withColumn("side", F.when(F.col("fold") == 0, "val").otherwise("train"))
    free = antibodies(spark, sf).join(lab.select("barcode"), "barcode", "left_anti")
    return P.assign_unlabelled(sides, free, "antigen").select("barcode", "side")


# --- mutants -----------------------------------------------------------------

MUTANTS_SQL = "WITH " + LABELLED_SQL + """, pos AS (SELECT barcode, hseq, cdr3, unnest(range(1, length(cdr3) + 1)) AS i FROM lab WHERE cdr3 <> ''),
mut AS (SELECT barcode, CAST(i AS INTEGER) AS pos, substr(cdr3, i::BIGINT, 1) AS wt, aa AS mut, substr(cdr3, 1, i::BIGINT - 1) || aa || substr(cdr3, i::BIGINT + 1) AS cdr3, cdr3 AS old, hseq AS h
  FROM pos, (SELECT unnest(string_split('A,C,D,E,F,G,H,I,K,L,M,N,P,Q,R,S,T,V,W,Y', ',')) AS aa)),
m AS (SELECT barcode, pos, wt, mut, cdr3, CASE WHEN position(old IN h) > 0 THEN substr(h, 1, position(old IN h) - 1) || cdr3 || substr(h, position(old IN h) + length(old)) ELSE h END AS hseq FROM mut)"""


@query("cdr3_mutants", MUTANTS_SQL + " SELECT barcode, pos, wt, mut, cdr3, hseq FROM m")
def cdr3_mutants(spark, sf):
    return U.mutants(labelled(spark, sf)).select("barcode", "pos", "wt", "mut", "cdr3", "hseq")


HYDRO_SQL = "(" + " + ".join(f"(length(cdr3) - length(replace(cdr3, '{x}', ''))) * ({v})::DOUBLE" for x, v in K.KYTE_DOOLITTLE.items()) + ") / length(cdr3)"


def hydropathy_score(df):
    from ..functions.sequence import feature_gravy

    return df.withColumn("score", feature_gravy(F.col("cdr3"), None))


SCAN_SQL = MUTANTS_SQL + f""", s AS (SELECT barcode, pos, wt, mut, {HYDRO_SQL} AS score FROM m), w AS (SELECT barcode, max(score) AS base FROM s WHERE wt = mut GROUP BY 1),
d AS (SELECT s.*, round(score - base, 9) AS delta FROM s JOIN w USING (barcode))"""


@query("mutation_scan", SCAN_SQL + " SELECT barcode, pos, wt, mut, round(score, 9) AS score, delta FROM d")
def mutation_scan(spark, sf):
    out = U.scan(labelled(spark, sf), hydropathy_score)
    return out.withColumns({"score": F.round("score", 9), "delta": F.round("delta", 9)})


@query("mutation_summary", SCAN_SQL + """
SELECT barcode, count(*) AS n, round(max(score) - min(score), 6) AS range, max(score) - min(score) < 0.01 AS flat,
  max(delta) AS best_delta, (SELECT x.mut FROM d x WHERE x.barcode = d.barcode ORDER BY delta DESC, pos, mut DESC LIMIT 1) AS best_mut,
  min(delta) AS worst_delta, (SELECT x.pos FROM d x WHERE x.barcode = d.barcode ORDER BY delta, pos, mut LIMIT 1) AS worst_pos,
  (SELECT x.mut FROM d x WHERE x.barcode = d.barcode ORDER BY delta, pos, mut LIMIT 1) AS worst_mut FROM d GROUP BY barcode""")
def mutation_summary(spark, sf):
    scanned = U.scan(labelled(spark, sf), hydropathy_score).withColumn("delta", F.round("delta", 9))
    return U.scan_summary(scanned).withColumn("range", r6("range"))


@query("mutation_matrix", SCAN_SQL + """ SELECT barcode, mut, """ + ", ".join(f'round(max(score) FILTER (pos = {i}), 9) AS "{i}"' for i in range(1, 17)) + " FROM d GROUP BY 1, 2")
def mutation_matrix(spark, sf):
    out = U.scan_matrix(U.scan(labelled(spark, sf), hydropathy_score))
    return out.withColumns({c: F.round(f"`{c}`", 9) for c in out.columns if c.isdigit()})


# --- selection rounds ---------------------------------------------------------

ENRICHED_SQL = "WITH " + CLONES_SQL + """, f AS (SELECT *, macs / sum(macs) OVER () AS freq_before, facs1 / sum(facs1) OVER () AS freq_after FROM clones),
e AS (SELECT *, freq_after / (freq_before + 1e-8) AS fold_change, CAST(facs1 > 5 AND freq_after >= freq_before * 1.5 AS INTEGER) AS positive, macs > 0 OR facs1 > 0 AS train FROM f)"""


def enriched(spark, sf):
    return N.enrichment_labels(clones(spark, sf))


@query("enrichment_labels", ENRICHED_SQL + " SELECT barcode, round(freq_before, 9) AS freq_before, round(freq_after, 9) AS freq_after, round(fold_change, 4) AS fold_change, positive, train FROM e")
def enrichment_labels(spark, sf):
    return enriched(spark, sf).select("barcode", F.round("freq_before", 9).alias("freq_before"), F.round("freq_after", 9).alias("freq_after"),
                                      F.round("fold_change", 4).alias("fold_change"), "positive", "train")


@query("fold_change_histogram", ENRICHED_SQL + """, l AS (SELECT log10(fold_change + 1e-8) AS v FROM e WHERE fold_change > 0), s AS (SELECT min(v) AS lo, max(v) AS hi FROM l)
SELECT CAST(least(floor((v - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n FROM l, s GROUP BY 1""")
def fold_change_histogram(spark, sf):
    return N.fold_change_histogram(enriched(spark, sf))


@query("position_counts", f"""WITH {ANTIBODIES_SQL}, p AS (SELECT i - 1 AS pos, substr(cdr3, i::BIGINT, 1) AS aa FROM (SELECT cdr3, unnest(range(1, length(cdr3) + 1)) AS i FROM ab)),
c AS (SELECT CAST(pos AS INTEGER) AS pos, aa, count(*) AS n FROM p GROUP BY 1, 2) SELECT pos, aa, n, round(n / sum(n) OVER (PARTITION BY pos), 6) AS prob FROM c""")
def position_counts(spark, sf):
    return N.position_counts(antibodies(spark, sf), "cdr3").withColumn("prob", r6("prob"))


PROFILE_SQL = ENRICHED_SQL + """, grp AS (SELECT 'baseline' AS g, cdr3 FROM e WHERE macs > 0 UNION ALL SELECT 'positive', cdr3 FROM e WHERE positive = 1 UNION ALL SELECT 'high', cdr3 FROM e WHERE score > 0.8),
pr AS (SELECT g, i - 1 AS pos, substr(cdr3, i::BIGINT, 1) AS aa, count(*) AS n FROM (SELECT g, cdr3, unnest(range(1, length(cdr3) + 1)) AS i FROM grp) GROUP BY ALL),
ps AS (SELECT *, n / sum(n) OVER (PARTITION BY g, pos) AS prob FROM pr),
en AS (SELECT g, pos, -sum(prob * log2(prob)) AS h FROM ps GROUP BY 1, 2),
gr AS (SELECT pos, aa FROM (SELECT DISTINCT pos FROM ps), (SELECT unnest(string_split('A,C,D,E,F,G,H,I,K,L,M,N,P,Q,R,S,T,V,W,Y', ',')) AS aa)),
kl AS (SELECT pos, aa, coalesce(max(prob) FILTER (g = 'high'), 1e-10) AS p, coalesce(max(prob) FILTER (g = 'baseline'), 1e-10) AS q FROM gr LEFT JOIN ps USING (pos, aa) GROUP BY 1, 2)"""


@query("position_entropy", PROFILE_SQL + """ SELECT g AS "group", CAST(pos + 105 AS INTEGER) AS position, round(-sum(prob * log2(prob)), 6) AS entropy,
  arg_max(aa, n * 100 - ascii(aa)) AS top_aa, round(max(n) / sum(n), 6) AS top_share FROM ps GROUP BY 1, 2""")
def position_entropy(spark, sf):
    out = N.position_entropy(enriched(spark, sf), "cdr3", "score")
    return out.withColumns({"entropy": r6("entropy"), "top_share": r6("top_share")})


@query("position_divergence", PROFILE_SQL + " SELECT CAST(pos + 105 AS INTEGER) AS position, aa, round(p * log2(p / q), 6) AS contribution FROM kl")
def position_divergence(spark, sf):
    return N.position_divergence(enriched(spark, sf), "cdr3", "score").withColumn("contribution", r6("contribution"))


@query("position_stats", PROFILE_SQL + """, k AS (SELECT pos, sum(p * log2(p / q)) AS kl FROM kl GROUP BY 1),
w AS (SELECT pos, coalesce(max(h) FILTER (g = 'baseline'), 0) AS b, coalesce(max(h) FILTER (g = 'positive'), 0) AS p, coalesce(max(h) FILTER (g = 'high'), 0) AS h FROM en GROUP BY 1)
SELECT CAST(pos + 105 AS INTEGER) AS position, round(b, 6) AS entropy_baseline, round(p, 6) AS entropy_positive, round(h, 6) AS entropy_high, round(kl, 6) AS kl, round(b - h, 6) AS entropy_delta FROM w JOIN k USING (pos)""")
def position_stats(spark, sf):
    out = N.position_stats(enriched(spark, sf), "cdr3", "score")
    return out.withColumns({c: r6(c) for c in out.columns if c != "position"})


# --- models --------------------------------------------------------------------

# Values of fitted models have no SQL; what has to hold for every row has.
VALID_SQL = f"WITH {LABELLED_SQL} SELECT barcode, true AS valid, true AS learned FROM lab"
#: Area under the curve that a fitted model passes on the rows it learned from; one score for all rows has 0.5.
LEARNED = 0.6


def with_learned(rows, truth, name, least=LEARNED):
    """Is the area under the ROC curve of all rows at least ``least``?"""
    rows = cut_lineage(rows)
    area = curve_areas(roc_points(rows, name, truth)).select((F.col("auc_roc") >= least).alias("learned"))
    return join_small(rows, area, [])


def valid_probability(scored, name="prob"):
    """One row per antibody: is there a probability, and do they rank the passing rows in front?"""
    rows = with_learned(scored.select("barcode", "quality", name), "quality", name)
    return rows.select("barcode", F.coalesce(F.col(name).between(0, 1), F.lit(False)).alias("valid"), "learned")


FOREST = M.ModelConfig("random_forest")
SEARCH_SPACE = {
    "maxDepth": M.Whole(2, 12), "numTrees": M.Whole(10, 60), "subsamplingRate": M.Between(0.6, 1.0), "minInstancesPerNode": M.Whole(1, 10),
    "featureSubsetStrategy": M.OneOf(["sqrt", "log2", "onethird", "all"]), "minInfoGain": M.Between(0.0, 0.01), "maxBins": M.Whole(16, 64),
}
PROPERTIES = FeatureConfig(features=("length", "pi", "charge", "hydrophobicity", "R", "D", "W", "vh_charge", "vh_hydrophobicity"))


@query("train_random_forest", VALID_SQL)
def train_random_forest(spark, sf):
    df = labelled(spark, sf)
    model = M.DevelopabilityModel(PROPERTIES, FOREST).fit(df, "quality")
    return valid_probability(model.score(df, "prob"))


@query("train_gradient_boosting", VALID_SQL)
def train_gradient_boosting(spark, sf):
    df = labelled(spark, sf).withColumn("held", F.col("fold") == 0)
    config = M.ModelConfig("gradient_boosting")
    model = M.DevelopabilityModel(PROPERTIES, config).fit(df, "quality", validation="held")
    return valid_probability(model.score(df, "prob"))


@query("train_logistic_l1", VALID_SQL)
def train_logistic_l1(spark, sf):
    df = labelled(spark, sf)
    config = M.ModelConfig("logistic_l1")
    model = M.DevelopabilityModel(FeatureConfig(kmer=True, biophysical=False, kmer_k=(1,)), config).fit(df, "quality")
    return valid_probability(model.score(df, "prob"))


@query("train_regression", VALID_SQL.replace("AS learned", "AS explains"))
def train_regression(spark, sf):
    df = labelled(spark, sf).withColumn("target", F.length("lseq") / 10.0)
    scored = M.DevelopabilityModel(PROPERTIES, FOREST).fit(df, "target").score(df, "value")
    span = df.agg(F.min("target").alias("low"), F.max("target").alias("high"))  # means of targets stay within
    rows = cut_lineage(scored.select("barcode", "target", "value"))
    fit = rows.agg((F.sum(F.pow(F.col("target") - F.col("value"), 2)) < F.count("*") * F.var_pop("target")).alias("explains"))  # better than the mean
    rows = join_small(join_small(rows, span, []), fit, [])
    return rows.select("barcode", F.col("value").between(F.col("low"), F.col("high")).alias("valid"), "explains")


@query("cross_validate", f"WITH {LABELLED_SQL} SELECT barcode, quality AS true, true AS valid, 1::BIGINT AS folds_of_cluster, 1::BIGINT AS times FROM lab")
def cross_validate(spark, sf):
    df = labelled(spark, sf).withColumn("cluster", F.col("doc_id"))
    out = M.cross_validate(df, "quality", PROPERTIES, FOREST)["predictions"]
    rows = cut_lineage(out.select("barcode", F.split("barcode", "-")[0].alias("cluster"), "true", "prob", "fold"))
    folds = rows.groupBy("cluster").agg(F.count_distinct("fold").alias("folds_of_cluster"))  # a cluster is judged by one model
    times = rows.groupBy("barcode").agg(F.count("*").alias("times"))  # and each row once
    valid = (F.col("prob").between(0, 1) & F.col("fold").between(0, 9)).alias("valid")
    return rows.join(folds, "cluster").join(times, "barcode").select("barcode", F.col("true").cast("int").alias("true"), valid, "folds_of_cluster", "times")


@query("random_search", """SELECT unnest(range(30)) AS draw, true AS inside, true AS judged, 1::BIGINT AS n_best, true AS stored""")
def random_search(spark, sf):
    """Thirty draws from ranges: each inside them and judged on a fold at least, one best, its model stored."""
    df = labelled(spark, sf).withColumn("cluster", F.col("doc_id"))
    model, results = M.search_and_fit(df, "quality", PROPERTIES, FOREST, SEARCH_SPACE, group="cluster")
    best = max(r.mean for r in results if r.whole)
    inside = lambda p: all(d.holds(p[n]) for n, d in SEARCH_SPACE.items())
    stored = M.with_parameters(FOREST, max((r for r in results if r.whole), key=lambda r: r.mean).point) == model.config
    rows = [(k, inside(r.point), all(0 <= s <= 1 for s in r.scores) and len(r.scores) > 0 and (r.whole or r.bound < best)) for k, r in enumerate(results)]
    n_best = sum(r.whole and r.mean == best for r in results[:1])
    return spark.createDataFrame([(*row, n_best, stored) for row in rows], "draw long, inside boolean, judged boolean, n_best long, stored boolean")


BAGS_SQL = "len(list_filter(range(10), lambda g: ('0x' || substr(md5(barcode || ':' || (42 + g)), 1, 8))::BIGINT < 1580030168))"


@query("out_of_bag", f"""WITH {LABELLED_SQL} SELECT barcode, quality AS true, {BAGS_SQL} AS bags, {BAGS_SQL} > 0 AS scored FROM lab""")
def out_of_bag(spark, sf):
    """Per row the number of bags without it, and whether those have scored it."""
    out = M.out_of_bag(labelled(spark, sf), "quality", PROPERTIES, FOREST)["predictions"]
    return out.select("barcode", F.col("true").cast("int").alias("true"), "bags", F.coalesce(F.col("prob").between(0, 1), F.lit(False)).alias("scored"))


@query("sample_size_curve", "SELECT unnest([200, 400]) AS sample_size, true AS valid")
def sample_size_curve(spark, sf):
    df = labelled(spark, sf)
    out = M.sample_size_curve(df, "quality", [200, 400], PROPERTIES, FOREST, group="doc_id")
    whole = (F.col("train_size") + F.col("test_size") == F.col("sample_size")) & F.col("auc").between(0, 1)
    return out.select("sample_size", whole.alias("valid"))


@query("permutation_importance", """SELECT unnest(['cdr3_length', 'cdr3_pi', 'cdr3_charge', 'cdr3_hydrophobicity', 'cdr3_R', 'cdr3_D', 'cdr3_W', 'vh_charge', 'vh_hydrophobicity']) AS feature, true AS valid""")
def permutation_importance(spark, sf):
    df = labelled(spark, sf)
    model = M.DevelopabilityModel(PROPERTIES, FOREST).fit(df, "quality")
    vectors = model.builder.transform(df)
    names = model.builder.feature_names
    out = explain.permutation_importance(vectors, model.model, "quality", names, model.builder.interpretable)
    return out.select("feature", F.col("importance").between(-1, 1).alias("valid"))


@query("tree_contributions", f"""WITH {LABELLED_SQL} SELECT barcode, kind, 0.0::DOUBLE AS gap, 9 AS most_features FROM lab, (SELECT unnest(['random_forest', 'gradient_boosting']) AS kind)""")
def tree_contributions(spark, sf):
    """Base value plus all contributions of a row against what the model itself returns."""
    df = dealt(labelled(spark, sf), "barcode", 1).withColumn("held", F.col("fold") == 0)
    parts = []
    for config, validation in ((FOREST, None), (M.ModelConfig("gradient_boosting"), "held")):
        model = M.DevelopabilityModel(PROPERTIES, config).fit(df, "quality", validation=validation)
        vectors = cut_lineage(model.builder.transform(df).select("barcode", "features"))  # read for the parts and for the margin
        found = tree_shap.tree_contributions(vectors, model.model, model.builder.feature_names, "barcode")
        total = F.aggregate("parts", F.col("base"), lambda s, p: s + p["value"])
        fit = F.greatest(F.lit(9), F.size("parts"))
        gap = found.join(tree_shap.margin(model.model, vectors).select("barcode", "margin"), "barcode")
        parts.append(gap.select("barcode", F.lit(config.kind).alias("kind"), F.abs(F.round(total - F.col("margin"), 6)).alias("gap"), fit.alias("most_features")))
    return parts[0].unionByName(parts[1])


@query("linear_contributions")
def linear_contributions(spark, sf):
    df = labelled(spark, sf)
    features = FeatureConfig(kmer=True, biophysical=False, kmer_k=(1,))
    model = M.DevelopabilityModel(features, M.ModelConfig("logistic_l1")).fit(df, "quality")
    vectors = model.builder.transform(df)
    parts = explain.linear_contributions(vectors, model.model, model.builder.feature_names, "barcode", model.builder.interpretable)
    return explain.attribution_ranking(parts, "feature", "value", 10)


@query("linear_contribution_sums", f"""WITH {LABELLED_SQL} SELECT barcode, 20 AS n_features, 0.0::DOUBLE AS gap FROM lab""")
def linear_contribution_sums(spark, sf):
    """Contributions of a row plus the mean margin of all rows against the margin that the model returns."""
    df = labelled(spark, sf)
    features = FeatureConfig(kmer=True, biophysical=False, kmer_k=(1,))
    model = M.DevelopabilityModel(features, M.ModelConfig("logistic_l1")).fit(df, "quality")
    vectors = cut_lineage(model.builder.transform(df).select("barcode", "features"))
    parts = explain.linear_contributions(vectors, model.model, model.builder.feature_names, "barcode", model.builder.interpretable)
    sums = parts.groupBy("barcode").agg(F.count("*").cast("int").alias("n_features"), F.sum("value").alias("total"))
    margins = cut_lineage(model.model.transform(vectors).select("barcode", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("margin")))
    whole = join_small(margins.join(sums, "barcode"), margins.agg(F.avg("margin").alias("base")), [])
    return whole.select("barcode", "n_features", F.abs(F.round(F.col("total") + F.col("base") - F.col("margin"), 6)).alias("gap"))


ATTRIBUTION_SQL = """att AS (SELECT barcode, i AS pos, substr(cdr3, i::BIGINT, 1) AS feature, ((doc_id * 17 + i * 31) % 200 - 100) / 100 AS value
  FROM (SELECT *, unnest(range(1, length(cdr3) + 1)) AS i FROM lab))"""


def attributions(spark, sf):
    rows = labelled(spark, sf).select("doc_id", F.posexplode(F.split("cdr3", "")).alias("i", "feature")).where("feature <> ''")
    return rows.select("feature", (F.col("i") + 1).alias("pos"), (((F.col("doc_id") * 17 + (F.col("i") + 1) * 31) % 200 - 100) / 100).alias("value"))


@query("attribution_ranking", f"WITH {LABELLED_SQL}, {ATTRIBUTION_SQL} SELECT feature, round(avg(abs(value)), 6) AS importance FROM att GROUP BY 1 ORDER BY avg(abs(value)) DESC, feature LIMIT 12")
def attribution_ranking(spark, sf):
    return explain.attribution_ranking(attributions(spark, sf), "feature", "value", 12).withColumn("importance", r6("importance"))


@query("position_attribution", f"WITH {LABELLED_SQL}, {ATTRIBUTION_SQL} SELECT CAST(pos AS INTEGER) AS pos, round(avg(abs(value)), 6) AS importance, count(*) AS n FROM att GROUP BY 1")
def position_attribution(spark, sf):
    return explain.position_attribution(attributions(spark, sf), "pos", "value").withColumn("importance", r6("importance"))


@query("isolation_forest", f"WITH {CLONES_SQL} SELECT barcode, true AS valid, true AS tells, true AS at_quantile FROM clones")
def isolation_forest(spark, sf):
    df = kmer_l2_vectors(enriched(spark, sf), "cdr3", "v")
    scored = anomaly.one_class_score(df, "v", "barcode", "positive", "train")
    rows = cut_lineage(scored.select("barcode", "score", (F.col("train") & (F.col("positive") == 1)).alias("known")))
    share = F.avg(F.when(F.col("known"), (F.col("score") > 0).cast("int")))  # a tenth of the known rows lie above 0, ties left out
    whole = rows.agg((F.count_distinct(F.round("score", 9)) > 10).alias("tells"), share.between(0.0, 0.1001).alias("at_quantile"))
    valid = (F.col("score").isNotNull() & ~F.isnan("score")).alias("valid")
    return join_small(rows, whole, []).select("barcode", valid, "tells", "at_quantile")


@query("hit_expansion", f"WITH {CLONES_SQL} SELECT barcode, true AS valid FROM clones")
def hit_expansion(spark, sf):
    from .jobs import expand_hits

    out = expand_hits(clones(spark, sf).drop("score"), previous(spark, sf), min_score=0.5, min_cpm=100)
    sound = F.col("score").between(0, 1) & (~F.col("selected") | (F.col("score") >= 0.5))  # what is selected scores high
    return out.select("barcode", F.coalesce(sound, F.lit(False)).alias("valid"))


@query("registered_model", f"WITH {LABELLED_SQL} SELECT barcode, true AS valid, true AS learned, 0.4::DOUBLE AS threshold FROM lab")
def registered_model(spark, sf):
    from ..models.registry import Registry
    from ..session import shared_folder

    df = labelled(spark, sf)
    registry = Registry(spark, shared_folder(spark, "registry"))
    path = registry.save(M.DevelopabilityModel(PROPERTIES, FOREST).fit(df, "quality"), "quality", "biophysical", "demo")
    registry.set_threshold(path, 0.4)
    row = registry.find("quality", "biophysical", "random_forest")
    stored = registry.load(row["path"], row["threshold"])
    return valid_probability(stored.score(df, "prob")).withColumn("threshold", F.lit(stored.threshold))
