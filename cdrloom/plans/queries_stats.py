"""Queries over statistics, curves, correlations and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import training as M
from ..operators import correlation as R, ordered as O, sampling as P, statistics as S, thresholds as T
from .catalog import query
from .inputs import (
    ANTIBODIES_SQL, ASSAYS_SQL, CLONES_SQL, CURVE_SQL, LABELLED_SQL, antibodies, assays, clones, curve, labelled, r6, table,
)


def rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


TAIL_STEPS = 8000


def tail_sql(t: str, dof: str) -> str:
    """Two-sided Student tail by Simpson's rule over the angle: 2 / B(dof/2, 1/2) times the integral of cos^(dof-1)."""
    start, width = f"atan(abs({t}) / sqrt({dof}))", f"((pi() / 2 - atan(abs({t}) / sqrt({dof}))) / {TAIL_STEPS})"
    weight = f"CASE WHEN k = 0 OR k = {TAIL_STEPS} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    points = f"list_sum(list_transform(range({TAIL_STEPS + 1}), lambda k: ({weight}) * power(greatest(cos({start} + k * {width}), 0), ({dof}) - 1)))"
    return f"(2 * exp(lgamma((({dof}) + 1) / 2.0) - lgamma(({dof}) / 2.0) - lgamma(0.5)) * {width} / 3 * {points})"


def corr_tail_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation of n pairs."""
    return f"CASE WHEN abs({r}) >= 1 THEN 0 ELSE {tail_sql(f'({r} * sqrt(({n} - 2) / (1 - {r} * {r})))', f'({n} - 2)')} END"


def stars_sql(p: str) -> str:
    return f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE 'ns' END"


# --- ordered primitives ----------------------------------------------------

@query("average_ranks", f"""WITH {LABELLED_SQL}, r AS (SELECT score, rank() OVER (ORDER BY score) AS lo, count(*) OVER (PARTITION BY score) AS n FROM lab)
SELECT DISTINCT score, n, lo + (n - 1) / 2 AS avg_rank FROM r""")
def average_ranks(spark, sf):
    return O.average_ranks(labelled(spark, sf).select("score"), "score")


@query("prefix_sum", """WITH c AS (SELECT l_extendedprice AS price, count(*) AS n FROM lineitem GROUP BY 1)
SELECT price, n, CAST(sum(n) OVER (ORDER BY price) AS BIGINT) AS running FROM c""")
def prefix_sum(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_extendedprice").alias("price")).agg(F.count("*").alias("n"))
    return O.prefix_sum(counts, "price", ["n"]).withColumnRenamed("cum_n", "running")


ROC_SQL = f"""WITH {LABELLED_SQL}, c AS (SELECT {{by}}score, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS neg FROM lab GROUP BY ALL),
p AS (SELECT *, sum(pos) OVER (w ORDER BY score DESC) AS tp, sum(neg) OVER (w ORDER BY score DESC) AS fp, sum(pos) OVER w AS np, sum(neg) OVER w AS nn,
        lead(pos) OVER (w ORDER BY score DESC) AS pos2, lead(neg) OVER (w ORDER BY score DESC) AS neg2 FROM c WINDOW w AS ({{part}}))"""


@query("roc_curve", ROC_SQL.format(by="", part="").replace("(w ORDER", "(ORDER").replace("OVER w ", "OVER () ").replace("WINDOW w AS ()", "") + """
SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / np, 6) AS tpr, round(fp / nn, 6) AS fpr, round(tp / (tp + fp), 6) AS precision,
  (tp = pos AND fp = neg) OR pos2 IS NULL OR pos2 <> pos OR neg2 <> neg AS corner FROM p""")
def roc_curve(spark, sf):
    out = O.roc_points(labelled(spark, sf), "score", "quality").select("score", "tp", "fp", "tpr", "fpr", "precision", "corner")
    return rounded(out, ["tpr", "fpr", "precision"])


@query("curve_areas", f"""WITH {LABELLED_SQL}, c AS (SELECT fold, score, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS neg FROM lab GROUP BY ALL),
p AS (SELECT *, sum(pos) OVER (PARTITION BY fold ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY fold ORDER BY score DESC) AS fp FROM c),
q AS (SELECT *, coalesce(lag(tp) OVER (PARTITION BY fold ORDER BY score DESC), 0) AS tp0, coalesce(lag(fp) OVER (PARTITION BY fold ORDER BY score DESC), 0) AS fp0 FROM p)
SELECT fold, round(sum((fp - fp0) * (tp + tp0) / 2) / (sum(pos) * sum(neg)), 6) AS auc_roc,
  round(sum((tp - tp0) * (tp / (tp + fp) + CASE WHEN tp0 + fp0 > 0 THEN tp0 / (tp0 + fp0) ELSE 1 END) / 2) / sum(pos), 6) AS auc_pr FROM q GROUP BY 1""")
def curve_areas(spark, sf):
    out = O.curve_areas(O.roc_points(labelled(spark, sf), "score", "quality", ["fold"]), ["fold"])
    return rounded(out.select("fold", "auc_roc", "auc_pr"), ["auc_roc", "auc_pr"])


FOLD_ROC_SQL = f"""WITH {LABELLED_SQL}, c AS (SELECT fold, score, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS neg FROM lab GROUP BY ALL),
p AS (SELECT fold, sum(pos) OVER (PARTITION BY fold ORDER BY score DESC) / sum(pos) OVER (PARTITION BY fold) AS tpr,
             sum(neg) OVER (PARTITION BY fold ORDER BY score DESC) / sum(neg) OVER (PARTITION BY fold) AS fpr FROM c),
g AS (SELECT fold, step, step / 99 AS x FROM (SELECT DISTINCT fold FROM p), (SELECT unnest(range(0, 100)) AS step)),
b AS (SELECT g.fold, step, x, max(CASE WHEN fpr <= x THEN struct_pack(f := fpr, t := tpr) END) AS lo, min(CASE WHEN fpr > x THEN struct_pack(f := fpr, t := tpr) END) AS hi
      FROM g JOIN p ON p.fold = g.fold GROUP BY ALL),
i AS (SELECT fold, step, x AS fpr, CASE WHEN step = 0 THEN 0 WHEN hi IS NULL THEN lo.t
        ELSE coalesce(lo.t, 0) + (x - coalesce(lo.f, 0)) * (hi.t - coalesce(lo.t, 0)) / (hi.f - coalesce(lo.f, 0)) END AS tpr FROM b)"""


@query("fold_roc_interpolated", FOLD_ROC_SQL + " SELECT fold, CAST(step AS INTEGER) AS step, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM i")
def fold_roc_interpolated(spark, sf):
    points = O.roc_points(labelled(spark, sf), "score", "quality", ["fold"])
    return rounded(O.roc_on_grid(points, ["fold"]), ["fpr", "tpr"])


@query("mean_roc", FOLD_ROC_SQL + """, m AS (SELECT step, fpr, CASE WHEN step = 99 THEN 1 ELSE avg(tpr) END AS mean_tpr, stddev_pop(tpr) AS std_tpr FROM i GROUP BY 1, 2)
SELECT CAST(step AS INTEGER) AS step, round(fpr, 6) AS fpr, round(mean_tpr, 6) AS mean_tpr, round(std_tpr, 6) AS std_tpr,
  round((SELECT sum(mean_tpr * CASE WHEN step IN (0, 99) THEN 0.5 ELSE 1 END) / 99 FROM m), 6) AS mean_auc FROM m""")
def mean_roc(spark, sf):
    preds = labelled(spark, sf).select("fold", F.col("quality").alias("true"), F.col("score").alias("prob"))
    return rounded(M.mean_curve_auc(preds), ["fpr", "mean_tpr", "std_tpr", "mean_auc"])


# --- summary statistics ----------------------------------------------------

@query("target_stats", "SELECT round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, min(n_chars) AS min, max(n_chars) AS max FROM documents")
def target_stats(spark, sf):
    return rounded(S.target_stats(table(spark, sf, "documents"), "n_chars"), ["mean", "std"])


CONFUSION_SQL = """count(*) FILTER (quality = 0 AND score < 0.5) AS tn, count(*) FILTER (quality = 0 AND score >= 0.5) AS fp,
count(*) FILTER (quality = 1 AND score < 0.5) AS fn, count(*) FILTER (quality = 1 AND score >= 0.5) AS tp"""


@query("confusion_counts", f"WITH {LABELLED_SQL} SELECT fold, {CONFUSION_SQL} FROM lab GROUP BY 1")
def confusion_counts(spark, sf):
    return T.confusion(labelled(spark, sf), "score", "quality", 0.5, ["fold"])


METRIC_SQL = """coalesce(tp / nullif(tp + fn, 0), 0) AS sensitivity, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(tp / nullif(tp + fp, 0), 0) AS precision"""
F_SQL = """coalesce(2 * precision * sensitivity / nullif(precision + sensitivity, 0), 0) AS f1, coalesce(5 * precision * sensitivity / nullif(4 * precision + sensitivity, 0), 0) AS f2"""


@query("metrics_at", f"""WITH {LABELLED_SQL}, c AS (SELECT {CONFUSION_SQL} FROM lab), m AS (SELECT *, {METRIC_SQL} FROM c), f AS (SELECT *, {F_SQL} FROM m)
SELECT 0.5::DOUBLE AS threshold, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round(f1, 4) AS f1, round(f2, 4) AS f2, round(precision, 4) AS precision,
  round(sensitivity, 4) AS sensitivity, round(specificity, 4) AS specificity, round(sensitivity, 4) AS recall_pass, round(specificity, 4) AS recall_fail,
  round((tp + fp) / (tp + tn + fp + fn), 4) AS pos_rate FROM f""")
def metrics_at(spark, sf):
    out = T.metrics_at(labelled(spark, sf), "score", "quality", 0.5)
    return rounded(out, [c for c in out.columns if c != "threshold"], 4)


FOLD_METRICS_SQL = f"""WITH {LABELLED_SQL}, ok AS (SELECT fold FROM lab GROUP BY 1 HAVING count(DISTINCT quality) = 2),
a AS (SELECT x.fold, avg(CASE WHEN x.score > y.score THEN 1.0::DOUBLE WHEN x.score = y.score THEN 0.5::DOUBLE ELSE 0 END) AS auc
      FROM lab x JOIN lab y ON x.fold = y.fold AND x.quality = 1 AND y.quality = 0 GROUP BY 1),
c AS (SELECT fold, {CONFUSION_SQL} FROM lab GROUP BY 1), m AS (SELECT *, {METRIC_SQL} FROM c), f AS (SELECT *, {F_SQL} FROM m),
fm AS (SELECT fold, auc, (tp + tn) / (tp + tn + fp + fn) AS acc, f1, precision, sensitivity AS recall, specificity AS rec_fail, tp, fp, tn, fn FROM f JOIN a USING (fold) JOIN ok USING (fold))"""


def fold_preds(spark, sf):
    return labelled(spark, sf).select("barcode", "fold", F.col("quality").alias("true"), F.col("score").alias("prob"))


@query("fold_metrics", FOLD_METRICS_SQL + " SELECT fold, round(auc, 6) AS auc, round(acc, 6) AS acc, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall, round(rec_fail, 6) AS rec_fail FROM fm")
def fold_metrics(spark, sf):
    out = M.fold_metrics(fold_preds(spark, sf))
    return rounded(out, [c for c in out.columns if c != "fold"])


@query("fold_metrics_weighted", FOLD_METRICS_SQL + """, z AS (SELECT *, coalesce(tn / nullif(tn + fn, 0), 0) AS p0 FROM fm),
y AS (SELECT *, coalesce(2 * p0 * rec_fail / nullif(p0 + rec_fail, 0), 0) AS f0, tp + fp + tn + fn AS n FROM z)
SELECT fold, round(auc, 6) AS auc, round(acc, 6) AS acc, round(((tp + fn) * f1 + (tn + fp) * f0) / n, 6) AS f1,
  round(((tp + fn) * precision + (tn + fp) * p0) / n, 6) AS precision, round(((tp + fn) * recall + (tn + fp) * rec_fail) / n, 6) AS recall, round(rec_fail, 6) AS rec_fail FROM y""")
def fold_metrics_weighted(spark, sf):
    out = M.fold_metrics(fold_preds(spark, sf), "weighted")
    return rounded(out, [c for c in out.columns if c != "fold"])


CV_COLS = ("auc", "acc", "f1", "precision", "recall", "rec_fail")


@query("cv_summary", FOLD_METRICS_SQL + " SELECT " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(stddev_pop({c}), 6) AS std_{c}" for c in CV_COLS)
       + ", (SELECT fold FROM fm ORDER BY auc DESC, fold LIMIT 1) AS best_fold, count(*) AS n_folds FROM fm")
def cv_summary(spark, sf):
    out = M.cv_summary(M.fold_metrics(fold_preds(spark, sf)))
    return rounded(out, [c for c in out.columns if c.startswith(("mean", "std"))])


@query("best_fold", FOLD_METRICS_SQL + " SELECT fold FROM fm ORDER BY auc DESC, fold LIMIT 1")
def best_fold(spark, sf):
    return M.best_fold(M.fold_metrics(fold_preds(spark, sf)))


@query("score_histogram", f"""WITH {LABELLED_SQL}, h AS (SELECT quality AS class, CAST(least(floor(score * 25), 24) AS INTEGER) AS bin, count(*) AS n FROM lab WHERE score BETWEEN 0 AND 1 GROUP BY ALL),
s AS (SELECT quality AS class, avg(score) AS mean, median(score) AS median FROM lab GROUP BY 1)
SELECT class, bin, n, round(n / max(n) OVER (PARTITION BY class), 6) AS height, round(mean, 6) AS mean, round(median, 6) AS median FROM h JOIN s USING (class)""")
def score_histogram(spark, sf):
    return rounded(S.score_histogram(labelled(spark, sf), "score", "quality"), ["height", "mean", "median"])


@query("score_kde", f"""WITH {LABELLED_SQL}, w AS (SELECT quality AS class, power(count(*)::DOUBLE, -0.2::DOUBLE) * stddev_samp(score) AS h FROM lab GROUP BY 1),
d AS (SELECT quality AS class, score, count(*) AS n FROM lab GROUP BY ALL), g AS (SELECT unnest(range(0, 500)) AS step),
k AS (SELECT class, step, sum(n * exp(-power((step / 499 - score) / h, 2) / 2)) AS k FROM d JOIN w USING (class), g GROUP BY ALL)
SELECT class, CAST(step AS INTEGER) AS step, round(step / 499, 6) AS x, round(k / max(k) OVER (PARTITION BY class), 6) AS density FROM k""")
def score_kde(spark, sf):
    return rounded(S.score_kde(labelled(spark, sf), "score", "quality"), ["x", "density"])


ASSAY_COLS = ("psr_norm_insulin", "psr_norm_dna", "psr_norm_smp", "psr_norm_avidin")
LONG_ASSAY_SQL = " UNION ALL ".join(f"SELECT '{c}' AS assay, quality, score, {c} AS v FROM assay WHERE {c} IS NOT NULL" for c in ASSAY_COLS)


@query("box_stats", f"""WITH {ASSAYS_SQL}, l AS ({LONG_ASSAY_SQL}),
b AS (SELECT assay, quality, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY 1, 2)
SELECT assay, quality, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_low,
  round(max(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_high,
  count(*) FILTER (NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM l JOIN b USING (assay, quality) GROUP BY ALL""")
def box_stats(spark, sf):
    out = S.box_stats(assays(spark, sf), list(ASSAY_COLS), "quality")
    return rounded(out, ["q1", "median", "q3", "whisker_low", "whisker_high"])


@query("welch_ttest", f"""WITH {ASSAYS_SQL}, l AS ({LONG_ASSAY_SQL}), s AS (SELECT assay, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n2,
  avg(v) FILTER (quality = 1) AS m1, avg(v) FILTER (quality = 0) AS m2, var_samp(v) FILTER (quality = 1) AS v1, var_samp(v) FILTER (quality = 0) AS v2 FROM l GROUP BY 1),
w AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS dof FROM s),
p AS (SELECT *, {tail_sql("t", "dof")} AS p FROM w)
SELECT assay, n1, n2, round(m1, 6) AS m1, round(m2, 6) AS m2, round(t, 6) AS t, round(dof, 4) AS dof, round(p, 6) AS p_value, {stars_sql("p")} AS significance FROM p""")
def welch_ttest(spark, sf):
    long = assays(spark, sf).select("quality", F.explode(F.array(*[
        F.struct(F.lit(c).alias("assay"), F.col(c).alias("v")) for c in ASSAY_COLS])).alias("p")).select("quality", "p.*")
    out = S.welch_ttest(long, "v", "quality", 1, 0, ["assay"]).select("assay", "n1", "n2", "m1", "m2", "t", "dof", "p_value", "significance")
    return rounded(out, ["m1", "m2", "t", "p_value"]).withColumn("dof", F.round("dof", 4))


@query("pearson", f"""WITH {ASSAYS_SQL}, r AS (SELECT count(*) AS n, corr(score, psr_norm_avidin) AS r FROM assay WHERE psr_norm_avidin IS NOT NULL)
SELECT n, round(r, 6) AS pearson, round({corr_tail_sql("r", "n")}, 6) AS pearson_p FROM r""")
def pearson(spark, sf):
    return rounded(R.pearson(assays(spark, sf), "score", "psr_norm_avidin").select("n", "pearson", "pearson_p"), ["pearson", "pearson_p"])


@query("spearman", f"""WITH {ASSAYS_SQL}, k AS (SELECT score AS x, psr_norm_avidin AS y FROM assay WHERE psr_norm_avidin IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM k),
c AS (SELECT count(*) AS n, corr(rx, ry) AS rho FROM r)
SELECT n, round(rho, 6) AS spearman, round({corr_tail_sql("rho", "n")}, 6) AS spearman_p FROM c""")
def spearman(spark, sf):
    return rounded(R.spearman(assays(spark, sf), "score", "psr_norm_avidin").select("n", "spearman", "spearman_p"), ["spearman", "spearman_p"])


PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS score_col, '{a}' AS assay_col, {e} AS x, {a} AS y FROM assay WHERE {a} IS NOT NULL"
    for s, e in (("score", "score"), ("toxic_score", "(score * (1 - toxic))")) for a in ASSAY_COLS
)
CORRELATED_SQL = f"""WITH {ASSAYS_SQL}, l AS ({PAIRS_SQL}),
r AS (SELECT *, rank() OVER (PARTITION BY score_col, assay_col ORDER BY x) + (count(*) OVER (PARTITION BY score_col, assay_col, x) - 1) / 2 AS rx,
        rank() OVER (PARTITION BY score_col, assay_col ORDER BY y) + (count(*) OVER (PARTITION BY score_col, assay_col, y) - 1) / 2 AS ry FROM l)"""


def scored_assays(spark, sf):
    return assays(spark, sf).withColumn("toxic_score", F.col("score") * (1 - F.col("toxic")))


BOTH_TAILS_SQL = (f"n, round(rho, 4) AS spearman_rho, round({corr_tail_sql('rho', 'n')}, 4) AS spearman_p, {stars_sql(corr_tail_sql('rho', 'n'))} AS significance, "
                  f"round(lin, 4) AS pearson_r, round({corr_tail_sql('lin', 'n')}, 4) AS pearson_p FROM c")
BOTH_TAILS = ["n", "spearman_rho", "spearman_p", "significance", "pearson_r", "pearson_p"]
BOTH_FIGURES = ["spearman_rho", "spearman_p", "pearson_r", "pearson_p"]


@query("score_assay_correlations", CORRELATED_SQL + f""", c AS (SELECT score_col, assay_col, count(*) AS n, corr(rx, ry) AS rho, corr(x, y) AS lin FROM r GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT score_col, assay_col, {BOTH_TAILS_SQL}""")
def score_assay_correlations(spark, sf):
    out = R.score_assay_correlations(scored_assays(spark, sf), ["score", "toxic_score"], list(ASSAY_COLS))
    return rounded(out.select("score_col", "assay_col", *BOTH_TAILS), BOTH_FIGURES, 4)


@query("correlations_over_files", f"""WITH {ASSAYS_SQL},
k AS (SELECT score, score * (1 - toxic) AS toxic_score, psr_norm_dna, psr_norm_avidin FROM assay WHERE score IS NOT NULL AND psr_norm_dna IS NOT NULL AND psr_norm_avidin IS NOT NULL),
l AS (SELECT 'first.csv' AS file, 'rf_demo_ab_score' AS score_col, 'psr_norm_dna' AS assay_col, score AS x, psr_norm_dna AS y FROM k
  UNION ALL SELECT 'first.csv', 'rf_demo_ab_score', 'psr_norm_avidin', score, psr_norm_avidin FROM k
  UNION ALL SELECT 'second.csv', 'xgb_demo_score', 'psr_norm_dna', toxic_score, psr_norm_dna FROM k
  UNION ALL SELECT 'second.csv', 'xgb_demo_score', 'psr_norm_avidin', toxic_score, psr_norm_avidin FROM k),
r AS (SELECT *, rank() OVER (PARTITION BY score_col, assay_col ORDER BY x) + (count(*) OVER (PARTITION BY score_col, assay_col, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY score_col, assay_col ORDER BY y) + (count(*) OVER (PARTITION BY score_col, assay_col, y) - 1) / 2.0 AS ry FROM l),
c AS (SELECT file, score_col, assay_col, count(*) AS n, corr(rx, ry) AS rho, corr(x, y) AS lin FROM r GROUP BY 1, 2, 3)
SELECT file, score_col, assay_col, {BOTH_TAILS_SQL}""")
def correlations_over_files(spark, sf):
    df = scored_assays(spark, sf).withColumnsRenamed({"score": "rf_demo_ab_score", "toxic_score": "xgb_demo_score"})
    first = df.drop("xgb_demo_score")
    out = R.correlations_over_files({"first.csv": first, "second.csv": df}, ["PSR_NORM_DNA", "psr_norm_avidin"])
    return rounded(out.select("file", "score_col", "assay_col", *BOTH_TAILS), BOTH_FIGURES, 4)


COMPLETE_SQL = f"k AS (SELECT * FROM assay WHERE psr_norm_insulin IS NOT NULL AND psr_norm_dna IS NOT NULL AND psr_norm_smp IS NOT NULL AND psr_norm_avidin IS NOT NULL)"
MATRIX_COLS = ("psr_norm_insulin", "psr_norm_dna", "psr_norm_smp", "psr_norm_avidin", "score")


def sql_matrix(source: str) -> str:
    cells = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({'1.0::DOUBLE' if a == b else f'corr({a}, {b})'}, 4) AS r, count(*) AS n FROM {source}" for a in MATRIX_COLS for b in MATRIX_COLS]
    return " UNION ALL ".join(cells)


@query("correlation_matrix_pearson", f"WITH {ASSAYS_SQL}, {COMPLETE_SQL} {sql_matrix('k')}")
def correlation_matrix_pearson(spark, sf):
    return R.correlation_matrix(assays(spark, sf), list(MATRIX_COLS), "pearson").withColumn("r", F.round("r", 4))


RANKED_SQL = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in MATRIX_COLS)


@query("correlation_matrix_spearman", f"WITH {ASSAYS_SQL}, {COMPLETE_SQL}, q AS (SELECT {RANKED_SQL} FROM k) {sql_matrix('q')}")
def correlation_matrix_spearman(spark, sf):
    return R.correlation_matrix(assays(spark, sf), list(MATRIX_COLS)).withColumn("r", F.round("r", 4))


@query("regression_metrics", f"""WITH {ASSAYS_SQL}, k AS (SELECT fold, psr_norm_avidin AS y, score AS p FROM assay WHERE psr_norm_avidin IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY y) + (count(*) OVER (PARTITION BY fold, y) - 1) / 2 AS ry,
        rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2 AS rp, avg(y) OVER (PARTITION BY fold) AS m FROM k)
SELECT fold, count(*) AS n, round(1 - sum(power(y - p, 2)) / sum(power(y - m, 2)), 6) AS r2, round(avg(abs(y - p)), 6) AS mae,
  round(corr(y, p), 6) AS pearson, round(corr(ry, rp), 6) AS spearman FROM r GROUP BY 1""")
def regression_metrics(spark, sf):
    out = S.regression_metrics(assays(spark, sf), "psr_norm_avidin", "score", ["fold"])
    return rounded(out, ["r2", "mae", "pearson", "spearman"])


@query("external_matrix", CORRELATED_SQL + """, y AS (SELECT *, CASE WHEN y < 0.27 THEN 1 ELSE 0 END AS c FROM r),
a AS (SELECT score_col, assay_col, x, count(*) FILTER (c = 1) AS pos, count(*) FILTER (c = 0) AS neg FROM y GROUP BY ALL),
b AS (SELECT *, sum(neg) OVER (PARTITION BY score_col, assay_col ORDER BY x) AS below FROM a),
u AS (SELECT score_col, assay_col, CASE WHEN sum(pos) >= 5 AND sum(neg) >= 5 THEN round(sum(pos * (below - neg / 2)) / (sum(pos) * sum(neg)), 6) END AS auc FROM b GROUP BY 1, 2)
SELECT score_col, assay_col, any_value(auc) AS auc, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(corr(rx, ry), 6) END AS rho FROM r JOIN u USING (score_col, assay_col) GROUP BY 1, 2""")
def external_matrix(spark, sf):
    return rounded(R.external_matrix(scored_assays(spark, sf), ["score", "toxic_score"], list(ASSAY_COLS)), ["auc", "rho"])


@query("describe_columns", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min,
  round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM lineitem""" for c in ("l_quantity", "l_discount")))
def describe_columns(spark, sf):
    out = S.describe_columns(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])
    return rounded(out, ["mean", "std", "q25", "q50", "q75"])


@query("correlation_to", " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(corr({c}, l_extendedprice), 6) AS pearson FROM lineitem""" for c in ("l_quantity", "l_tax")))
def correlation_to(spark, sf):
    return rounded(S.correlation_to(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice"), ["pearson"])


@query("score_spread", f"""WITH {LABELLED_SQL}, l AS (SELECT 'score' AS score_col, score AS v FROM lab UNION ALL SELECT 'tenth', score / 10 FROM lab)
SELECT score_col, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, stddev_samp(v) < 0.15 AS narrow FROM l GROUP BY 1""")
def score_spread(spark, sf):
    df = labelled(spark, sf).withColumn("tenth", F.col("score") / 10)
    return rounded(S.score_spread(df, ["score", "tenth"]), ["min", "max", "mean", "std"])


@query("class_balance", f"""WITH {LABELLED_SQL}, s AS (SELECT count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0 FROM lab)
SELECT n1, n0, round(least(n1, n0) / (n1 + n0), 6) AS minority_rate, round(n0 / n1, 6) AS scale_pos_weight,
  CASE WHEN least(n1, n0) / (n1 + n0) > 0.35 THEN 'youden' WHEN least(n1, n0) / (n1 + n0) > 0.15 THEN 'f2' ELSE 'cost' END AS threshold_rule FROM s""")
def class_balance(spark, sf):
    return rounded(S.class_balance(labelled(spark, sf), "quality"), ["minority_rate", "scale_pos_weight"])


# --- learning curves -------------------------------------------------------

@query("auc_difference", f"WITH {CURVE_SQL} SELECT CAST(sample_size AS BIGINT) AS sample_size, round(auc - lag(auc) OVER (ORDER BY sample_size), 6) AS auc_diff FROM curve")
def auc_difference(spark, sf):
    return rounded(S.consecutive_difference(curve(spark, sf), "sample_size", "auc", "auc_diff").select("sample_size", "auc_diff"), ["auc_diff"])


@query("rolling_auc", f"WITH {CURVE_SQL} SELECT CAST(sample_size AS BIGINT) AS sample_size, round(avg(auc) OVER (ORDER BY sample_size ROWS 4 PRECEDING), 6) AS rolling FROM curve")
def rolling_auc(spark, sf):
    return rounded(S.rolling_mean(curve(spark, sf), "sample_size", "auc", "rolling").select("sample_size", "rolling"), ["rolling"])


@query("bucket_means", f"""WITH {CURVE_SQL} SELECT CASE WHEN sample_size <= 3000 THEN 'low' WHEN sample_size <= 9000 THEN 'mid' ELSE 'high' END AS bucket,
round(avg(auc), 6) AS mean, round(stddev_samp(auc), 6) AS std, count(*) AS n FROM curve GROUP BY 1""")
def bucket_means(spark, sf):
    return rounded(S.bucket_means(curve(spark, sf), "sample_size", "auc", 3000, 9000), ["mean", "std"])


@query("bucket_ttest", f"""WITH {CURVE_SQL}, b AS (SELECT CASE WHEN sample_size <= 3000 THEN 'low' WHEN sample_size <= 9000 THEN 'mid' ELSE 'high' END AS bucket, auc AS v FROM curve),
s AS (SELECT count(*) FILTER (bucket = 'low') AS n1, count(*) FILTER (bucket = 'mid') AS n2, avg(v) FILTER (bucket = 'low') AS m1, avg(v) FILTER (bucket = 'mid') AS m2,
  var_samp(v) FILTER (bucket = 'low') AS v1, var_samp(v) FILTER (bucket = 'mid') AS v2 FROM b),
w AS (SELECT n1, n2, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS dof FROM s)
SELECT n1, n2, round(t, 6) AS t, round(dof, 4) AS dof, round({tail_sql("t", "dof")}, 6) AS p_value, {stars_sql(tail_sql("t", "dof"))} AS significance FROM w""")
def bucket_ttest(spark, sf):
    df = curve(spark, sf).withColumn("bucket", S.size_bucket(F.col("sample_size"), 3000, 9000))
    out = S.welch_ttest(df, "auc", "bucket", "low", "mid").select("n1", "n2", "t", "dof", "p_value", "significance")
    return rounded(out, ["t", "p_value"]).withColumn("dof", F.round("dof", 4))


@query("scaling_linear", f"""WITH {CURVE_SQL}, l AS (SELECT 'auc' AS metric, sample_size AS x, auc AS y FROM curve UNION ALL SELECT 'recall', sample_size, recall FROM curve), f AS (SELECT metric, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icpt, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM l GROUP BY 1),
t AS (SELECT *, slope / sqrt((1 - r2) * syy / (n - 2) / sxx) AS t FROM f), p AS (SELECT *, {tail_sql("t", "(n - 2)")} AS p FROM t)
SELECT metric, n, round(slope, 12) AS slope, round(icpt, 6) AS intercept, round(r2, 6) AS r_squared, round(t, 4) AS t, round(p, 6) AS p_value, slope > 0 AND p < 0.05 AS positive_scaling FROM p""")
def scaling_linear(spark, sf):
    out = S.scaling_linear(curve(spark, sf), "sample_size", ["auc", "recall"])
    return rounded(out, ["intercept", "r_squared", "p_value"]).withColumns({"slope": F.round("slope", 12), "t": F.round("t", 4)})


@query("scaling_quadratic", f"""WITH {CURVE_SQL},
l AS (SELECT m.metric, sample_size::DOUBLE AS x, CASE m.metric WHEN 'auc' THEN auc WHEN 'accuracy' THEN accuracy ELSE recall END AS y FROM curve, (SELECT unnest(['auc', 'accuracy', 'recall']) AS metric) m),
st AS (SELECT metric, avg(x) AS m, stddev_pop(x) AS d FROM l GROUP BY 1),
z AS (SELECT metric, m, d, (x - m) / d AS z, y FROM l JOIN st USING (metric)),
f AS (SELECT metric, regr_slope(z * z, z) AS g, regr_intercept(z * z, z) AS h, regr_slope(y, z) AS p, regr_intercept(y, z) AS q FROM z GROUP BY 1),
e AS (SELECT metric, m, d, g, h, p, q, y, z * z - h - g * z AS e, y - q - p * z AS w FROM z JOIN f USING (metric)),
k AS (SELECT metric, m, d, g, h, p, q, count(*) AS n, sum(e * w) / sum(e * e) AS c2, sum(w * w) - sum(e * w) * sum(e * w) / sum(e * e) AS sse, var_pop(y) * count(*) AS sst FROM e GROUP BY ALL),
c AS (SELECT *, c2 / (d * d) AS quad, (p - c2 * g) / d - 2 * m * c2 / (d * d) AS lin, (q - c2 * h) - (p - c2 * g) * m / d + c2 * m * m / (d * d) AS icpt FROM k)
SELECT metric, n, round(icpt, 6) AS intercept, round(lin * 1e6, 4) AS slope_linear, round(quad * 1e12, 3) AS coeff_quadratic, round(1 - sse / sst, 6) AS r_squared FROM c""")
def scaling_quadratic(spark, sf):
    out = S.scaling_quadratic(curve(spark, sf), "sample_size", ["auc", "accuracy", "recall"])
    return out.select("metric", "n", r6("intercept").alias("intercept"), F.round(F.col("slope_linear") * 1e6, 4).alias("slope_linear"),
                      F.round(F.col("coeff_quadratic") * 1e12, 3).alias("coeff_quadratic"), r6("r_squared").alias("r_squared"))


# --- thresholds ------------------------------------------------------------

SWEEP_SQL = f"""WITH {LABELLED_SQL}, e AS ({{source}}), s AS (SELECT {{by}}min(score) + 1e-6 AS lo, max(score) - 1e-6 AS hi FROM e {{group}}),
g AS (SELECT s.*, step, CASE WHEN step = 499 THEN hi ELSE lo + step * ((hi - lo) / 499) END AS threshold FROM s, (SELECT unnest(range(0, 500)) AS step)),
c AS (SELECT {{gby}}step, threshold, count(*) FILTER (quality = 1 AND score >= threshold) AS tp, count(*) FILTER (quality = 0 AND score >= threshold) AS fp,
  count(*) FILTER (quality = 0 AND score < threshold) AS tn, count(*) FILTER (quality = 1 AND score < threshold) AS fn FROM g {{join}} GROUP BY ALL),
m AS (SELECT *, {METRIC_SQL} FROM c), sweep AS (SELECT *, {F_SQL}, sensitivity + specificity - 1 AS youden FROM m)"""
POOLED = SWEEP_SQL.format(source="SELECT quality, score FROM lab", by="", group="", gby="", join=", e")
BY_FOLD = SWEEP_SQL.format(source="SELECT fold, quality, score FROM lab WHERE fold IN (SELECT fold FROM lab GROUP BY 1 HAVING count(DISTINCT quality) = 2)",
                           by="fold, ", group="GROUP BY fold", gby="g.fold, ", join="JOIN e ON e.fold = g.fold")
SWEEP_OUT = "round(threshold, 6) AS threshold, tp, fp, tn, fn, " + ", ".join(f"round({m}, 6) AS {m}" for m in T.METRICS)


@query("threshold_sweep", POOLED + f" SELECT CAST(step AS INTEGER) AS step, {SWEEP_OUT} FROM sweep")
def threshold_sweep(spark, sf):
    return rounded(T.threshold_sweep(labelled(spark, sf), "score", "quality"), ["threshold", *T.METRICS])


PICK = "FROM sweep ORDER BY {metric} DESC, step {way} LIMIT 1"


@query("find_threshold_youden", POOLED + f" SELECT 'youden' AS method, {SWEEP_OUT} " + PICK.format(metric="youden", way="ASC"))
def find_threshold_youden(spark, sf):
    return rounded(T.find_threshold(labelled(spark, sf), "score", "quality", "youden"), ["threshold", *T.METRICS])


AUTO_SQL = """CASE WHEN minority > 0.35 THEN 'youden' WHEN minority > 0.15 THEN 'f2' ELSE 'cost' END"""
AUTO_METRIC = """CASE WHEN minority > 0.35 THEN youden WHEN minority > 0.15 THEN f2 ELSE -(fp * 1.0::DOUBLE + fn * {fn}::DOUBLE) END"""


@query("find_threshold_auto", POOLED + f""", a AS (SELECT *, least(tp + fn, tn + fp) / (tp + fn + tn + fp) AS minority FROM sweep)
SELECT {AUTO_SQL} AS method, {SWEEP_OUT} FROM a ORDER BY {AUTO_METRIC.format(fn=2)} DESC, step LIMIT 1""")
def find_threshold_auto(spark, sf):
    return rounded(T.find_threshold(labelled(spark, sf), "score", "quality"), ["threshold", *T.METRICS])


FB = "(1 + {b2}) * precision * sensitivity / ({b2} * precision + sensitivity + 1e-12)"
REPORT_RULES = {
    "auto": AUTO_METRIC.format(fn=3) + " DESC, step", "youden": "youden DESC, step", "f1": "f1 DESC, step", "f2": "f2 DESC, step",
    "f0.5": FB.format(b2="0.25::DOUBLE") + " DESC, step", "f2.0": FB.format(b2="4.0::DOUBLE") + " DESC, step",
    "recall_at_90": "sensitivity >= 0.9 DESC, CASE WHEN sensitivity >= 0.9 THEN 0 ELSE sensitivity END DESC, CASE WHEN sensitivity >= 0.9 THEN -step ELSE step END",
    "precision_at_80": "precision >= 0.8 DESC, CASE WHEN precision >= 0.8 THEN 0 ELSE precision END DESC, step",
    "cost": "fp + 3 * fn ASC, step",
}


@query("threshold_report", POOLED + ", a AS (SELECT *, least(tp + fn, tn + fp) / (tp + fn + tn + fp) AS minority FROM sweep) "
       + " UNION ALL ".join(f"(SELECT '{n}' AS label, {SWEEP_OUT} FROM a ORDER BY {rule} LIMIT 1)" for n, rule in REPORT_RULES.items()))
def threshold_report(spark, sf):
    out = T.threshold_report(labelled(spark, sf), "score", "quality").select("label", "threshold", "tp", "fp", "tn", "fn", *T.METRICS)
    return rounded(out, ["threshold", *T.METRICS])


@query("threshold_by_fold", BY_FOLD + f""", a AS (SELECT *, least(tp + fn, tn + fp) / (tp + fn + tn + fp) AS minority FROM sweep)
SELECT fold, {AUTO_SQL} AS method, {SWEEP_OUT} FROM a QUALIFY row_number() OVER (PARTITION BY fold ORDER BY {AUTO_METRIC.format(fn=3)} DESC, step) = 1""")
def threshold_by_fold(spark, sf):
    return rounded(T.threshold_by_fold(fold_preds(spark, sf)), ["threshold", *T.METRICS])


@query("threshold_stability", BY_FOLD + f""", a AS (SELECT *, least(tp + fn, tn + fp) / (tp + fn + tn + fp) AS minority FROM sweep),
b AS (SELECT fold, threshold FROM a QUALIFY row_number() OVER (PARTITION BY fold ORDER BY {AUTO_METRIC.format(fn=3)} DESC, step) = 1)
SELECT round(avg(threshold), 6) AS mean_threshold, round(stddev_pop(threshold), 6) AS std_threshold, count(*) AS n_folds,
  CASE WHEN stddev_pop(threshold) < 0.05 THEN 'stable' WHEN stddev_pop(threshold) < 0.1 THEN 'moderate' ELSE 'unstable' END AS stability FROM b""")
def threshold_stability(spark, sf):
    out = T.threshold_stability(fold_preds(spark, sf)).drop("pooled_threshold")
    return rounded(out, ["mean_threshold", "std_threshold"])


EVAL_SQL = ROC_SQL.format(by="", part="").replace("(w ORDER", "(ORDER").replace("OVER w ", "OVER () ").replace("WINDOW w AS ()", "") + """,
k AS (SELECT score, tp / np AS tpr, fp / nn AS fpr, np / (np + nn) AS rate FROM p WHERE (tp = pos AND fp = neg) OR pos2 IS NULL OR pos2 <> pos OR neg2 <> neg
      UNION ALL SELECT 'inf'::DOUBLE, 0, 0, max(np / (np + nn)) FROM p),
g AS (SELECT step, CASE WHEN step = 999 THEN 0.999::DOUBLE ELSE 0.001::DOUBLE + step * ((0.999::DOUBLE - 0.001::DOUBLE) / 999) END AS threshold FROM (SELECT unnest(range(0, 1000)) AS step)),
c2 AS (SELECT step, threshold, count(*) FILTER (quality = 1 AND score >= threshold) AS tp, count(*) FILTER (quality = 0 AND score >= threshold) AS fp, count(*) FILTER (quality = 1 AND score < threshold) AS fn
       FROM g, (SELECT quality, score FROM lab) GROUP BY ALL),
f AS (SELECT step, threshold, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c2),
th AS (SELECT (SELECT score FROM k ORDER BY tpr - fpr DESC, score DESC LIMIT 1) AS youden,
  (SELECT score FROM k ORDER BY 1.0::DOUBLE * fpr * (1 - rate) + 3.0::DOUBLE * (1 - tpr) * rate, score DESC LIMIT 1) AS cost,
  (SELECT threshold FROM f ORDER BY coalesce(2 * p * r / nullif(p + r, 0), 0) DESC, step LIMIT 1) AS f1,
  (SELECT threshold FROM f ORDER BY coalesce(5 * p * r / nullif(4 * p + r, 0), 0) DESC, step LIMIT 1) AS f2,
  (SELECT threshold FROM f ORDER BY coalesce(1.25::DOUBLE * p * r / nullif(0.25::DOUBLE * p + r, 0), 0) DESC, step LIMIT 1) AS f05,
  (SELECT max(score) FROM k WHERE tpr >= 0.9) AS sens90, (SELECT max(score) FROM k WHERE tpr >= 0.95) AS sens95)"""


@query("eval_thresholds", EVAL_SQL + " SELECT round(youden, 6) AS youden, round(cost, 6) AS cost, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f05, 6) AS f05, round(sens90, 6) AS sens90, round(sens95, 6) AS sens95 FROM th")
def eval_thresholds(spark, sf):
    out = T.evaluation_thresholds(labelled(spark, sf), "score", "quality")
    return rounded(out, out.columns)


@query("apply_threshold", f"""WITH {LABELLED_SQL} SELECT barcode, CAST(score >= 0.42 AS INTEGER) AS given, CAST(score >= 0.3 AS INTEGER) AS stored, CAST(score >= 0.5 AS INTEGER) AS plain, score AS copied FROM lab""")
def apply_threshold(spark, sf):
    df = T.apply_threshold(labelled(spark, sf), "score", "given", 0.42, 0.3)
    df = T.apply_threshold(T.apply_threshold(df, "score", "stored", None, 0.3), "score", "plain")
    return T.apply_threshold(df, "score", "copied", task="regression").select("barcode", "given", "stored", "plain", "copied")


@query("optimal_label_columns", EVAL_SQL + ", z AS (SELECT barcode, CASE WHEN tile % 9 = 4 THEN NULL ELSE score END AS s FROM lab) SELECT barcode, "
       + ", ".join(f"CAST(coalesce(s, 0) >= {rule} AS INTEGER) AS rf_demo_{suffix}" for suffix, rule in T.LABEL_SUFFIXES.items()) + " FROM z, th")
def optimal_label_columns(spark, sf):
    df = labelled(spark, sf)
    thresholds = T.evaluation_thresholds(df, "score", "quality")
    holes = df.select("barcode", F.when(F.col("tile") % 9 != 4, F.col("score")).alias("rf_demo_score"))
    return T.with_optimal_labels(holes, "rf_demo_score", thresholds).drop("rf_demo_score")


@query("evaluate_summary", EVAL_SQL + """, u AS (SELECT sum(pos * (nn - fp + neg / 2)) / max(np * nn) AS auc FROM p)
SELECT count(*) AS n, round(avg(quality), 6) AS pos_rate, count(*) FILTER (quality = 1) AS class_1_n, count(*) FILTER (quality = 0) AS class_0_n, min(score) AS score_min, max(score) AS score_max,
  round(avg(score), 6) AS score_mean, round(any_value(auc), 6) AS auc_roc, round(any_value(youden), 6) AS threshold_youden, round(any_value(cost), 6) AS threshold_cost,
  round(any_value(f1), 6) AS threshold_f1, round(any_value(f2), 6) AS threshold_f2 FROM lab, u, th""")
def evaluate_summary(spark, sf):
    out = T.evaluate(labelled(spark, sf), "score", "quality")["summary"]
    return rounded(out, ["pos_rate", "score_mean", "auc_roc", "threshold_youden", "threshold_cost", "threshold_f1", "threshold_f2"])


@query("evaluate_metrics", EVAL_SQL + f""", n AS (SELECT 't=0.5' AS method, 0.5::DOUBLE AS threshold UNION ALL SELECT 'youden', youden FROM th UNION ALL SELECT 'cost', cost FROM th UNION ALL SELECT 'f1', f1 FROM th
  UNION ALL SELECT 'f2', f2 FROM th UNION ALL SELECT 'f05', f05 FROM th UNION ALL SELECT 'sens90', sens90 FROM th UNION ALL SELECT 'sens95', sens95 FROM th),
x AS (SELECT method, threshold, count(*) FILTER (quality = 1 AND score >= threshold) AS tp, count(*) FILTER (quality = 0 AND score >= threshold) AS fp,
  count(*) FILTER (quality = 0 AND score < threshold) AS tn, count(*) FILTER (quality = 1 AND score < threshold) AS fn FROM n, lab GROUP BY ALL), m AS (SELECT *, {METRIC_SQL} FROM x), y AS (SELECT *, {F_SQL} FROM m)
SELECT method, round(threshold, 6) AS threshold, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(f1, 6) AS f1, round(f2, 6) AS f2, round(precision, 6) AS precision,
  round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round((tp + fp) / (tp + tn + fp + fn), 6) AS pos_rate FROM y""")
def evaluate_metrics(spark, sf):
    out = T.evaluate(labelled(spark, sf), "score", "quality")["metrics"]
    return rounded(out, [c for c in out.columns if c != "method"])


# --- sampling --------------------------------------------------------------

@query("top_n", f"WITH {CLONES_SQL} SELECT barcode, score FROM clones ORDER BY score DESC, barcode LIMIT 50")
def top_n(spark, sf):
    return P.top_n(clones(spark, sf).select("barcode", "score"), "score", 50, "barcode")


@query("top_features", f"WITH {LABELLED_SQL} SELECT barcode, score - 0.5 AS x FROM lab ORDER BY abs(score - 0.5) DESC, barcode LIMIT 30")
def top_features(spark, sf):
    return P.top_by_magnitude(labelled(spark, sf).select("barcode", (F.col("score") - 0.5).alias("x")), "x", 30, "barcode")


@query("first_n", f"WITH {ANTIBODIES_SQL} SELECT barcode FROM ab ORDER BY row_id LIMIT 40")
def first_n(spark, sf):
    return P.first_n(antibodies(spark, sf).select("barcode", "row_id"), "row_id", 40).select("barcode")


@query("balanced_sample", f"""WITH {LABELLED_SQL} SELECT barcode, quality FROM lab
QUALIFY row_number() OVER (PARTITION BY quality ORDER BY md5(barcode || ':42'), barcode) <= 100""")
def balanced_sample(spark, sf):
    return P.balanced_sample(labelled(spark, sf).select("barcode", "quality"), "quality", "barcode", 200)


@query("random_subsample", f"WITH {LABELLED_SQL} SELECT barcode, quality FROM lab ORDER BY md5(barcode || ':42'), barcode LIMIT 500")
def random_subsample(spark, sf):
    return P.random_subsample(labelled(spark, sf).select("barcode", "quality"), "barcode", 500)


@query("size_ladder", f"""WITH {LABELLED_SQL}, n AS (SELECT count(*) AS n FROM lab), s AS (SELECT unnest(range(500, n + 1, 1000)) AS size, n FROM n)
SELECT size FROM s UNION SELECT n FROM n""")
def size_ladder(spark, sf):
    return P.size_ladder(labelled(spark, sf), 500, 1000, True)


@query("total_normalised", f"""WITH {CLONES_SQL} SELECT barcode, round(macs / sum(macs) OVER (), 9) AS freq, round(facs1 * 1e6 / sum(facs1) OVER (), 4) AS cpm FROM clones""")
def total_normalised(spark, sf):
    from ..operators.ngs import counts_per_million

    df = counts_per_million(clones(spark, sf), "facs1")
    total = df.agg(F.sum("macs").alias("t")).scalar()
    return df.select("barcode", F.round(F.col("macs") / total, 9).alias("freq"), F.round("cpm", 4).alias("cpm"))
