"""Queries over cleaning, projections, joins and set operations."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleaning as C, joins as J, thresholds as H
from ..operators.correlation import detect_score_columns
from ..session import shared_folder
from ..sources import tables as S
from .catalog import query
from .inputs import (
    ANTIBODIES_SQL, ASSAYS_SQL, EMBEDDINGS_SQL, LABELLED_SQL, PREVIOUS_SQL, antibodies, assays, embeddings, labelled,
    previous, r6, table,
)

CDR3_STRICT = "regexp_extract_all(h, 'C([A-Z]{3,30}?)WG[A-Z]G', 1)"
CDR3_LOOSE = "regexp_extract_all(h, 'C([A-Z]{3,35}?)WG', 1)"
EXTRACTED_SQL = f"""
found AS (
  SELECT *, CASE WHEN length(trim(hseq)) < 20 THEN ''
                 ELSE coalesce({CDR3_STRICT}[-1], {CDR3_LOOSE}[-1], '') END AS loop
  FROM (SELECT *, regexp_replace(upper(hseq), '[- ]', '', 'g') AS h FROM ab))"""


@query("read_antibodies", f"WITH {ANTIBODIES_SQL} SELECT barcode, hseq, nullif(lseq, '') AS lseq, nullif(cdr3, '') AS cdr3, antigen FROM ab")
def read_antibodies(spark, sf):
    """All antibodies written as CSV under the usual upper-case names, then read."""
    path = f"{shared_folder(spark, 'antibodies')}/ab.csv"
    ab = antibodies(spark, sf).select(F.col("barcode").alias("BARCODE"), F.col("hseq").alias("HSEQ"), F.col("lseq").alias("LSEQ"), F.col("cdr3").alias("CDR3"), "antigen")
    S.write_table(ab, path)
    return S.read_antibodies(spark, path, target="antigen", need_cdr3=True)


def wide_embeddings(spark, sf, folder):
    """Embedding files of two models in the usual wide CSV form."""
    dims = [F.get("embedding", F.lit(i)).alias(str(i)) for i in range(64)]
    wide = embeddings(spark, sf).select(F.concat(F.lit(" "), "barcode").alias("BARCODE"), *dims)
    for name in ("demo.first.emb.csv", "demo.second.emb.csv", "other.first.emb.csv"):
        S.write_table(wide, f"{folder}/{name}")


@query("read_embeddings", f"""WITH {EMBEDDINGS_SQL}
SELECT barcode, 'first' AS lm, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM emb""")
def read_embeddings(spark, sf):
    folder = shared_folder(spark, "embeddings")
    wide_embeddings(spark, sf, folder)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    return S.read_embeddings(spark, f"{folder}/demo.first.emb.csv", "first").select("barcode", "lm", F.size("embedding").alias("dim"), F.round(total, 4).alias("total"))


@query("discover_embeddings", """SELECT unnest(['first', 'second']) AS lm, count(*) AS n FROM embeddings""")
def discover_embeddings(spark, sf):
    """Every embedding file of one database is found and read under its model's name."""
    folder = shared_folder(spark, "embeddings")
    wide_embeddings(spark, sf, folder)
    found = S.discover_embeddings(spark, folder, "demo").collect()
    parts = [S.read_embeddings(spark, r["path"], r["lm"]).groupBy("lm").agg(F.count("*").alias("n")) for r in found]
    return J.concat_rows(parts)


@query("write_evaluation", f"""WITH {LABELLED_SQL} SELECT 'metrics' AS part, count(*) AS n, 0::BIGINT AS positives FROM (SELECT unnest(range(8)))
UNION ALL SELECT 'predictions', count(*), count(*) FILTER (score >= 0.5) FROM lab UNION ALL SELECT 'summary', 1, 0""")
def write_evaluation(spark, sf):
    """The three tables of an evaluation, written and read again."""
    folder = shared_folder(spark, "evaluation")
    S.write_evaluation(H.evaluate(labelled(spark, sf), "score", "quality"), folder)
    rows = {name: S.read_table(spark, f"{folder}/{name}") for name in ("metrics", "predictions", "summary")}
    positives = {"predictions": F.count_if(F.col("score") >= 0.5)}
    parts = [t.agg(F.count("*").alias("n"), positives.get(name, F.lit(0).cast("long")).alias("positives")).withColumn("part", F.lit(name)) for name, t in rows.items()]
    return J.concat_rows(parts).select("part", "n", "positives")


@query("write_fold_predictions", f"WITH {LABELLED_SQL} SELECT barcode, fold, quality AS true, round(score, 6) AS prob FROM lab")
def write_fold_predictions(spark, sf):
    folder = shared_folder(spark, "folds")
    S.write_fold_predictions(labelled(spark, sf).select("barcode", "fold", F.col("quality").alias("true"), "score"), folder)
    return S.read_table(spark, folder).select("barcode", "fold", "true", r6("score").alias("prob"))


@query("normalize_barcode", f"""WITH {ANTIBODIES_SQL} SELECT barcode, trim('  ' || barcode || ' ') AS key FROM ab""")
def normalize_barcode(spark, sf):
    ab = antibodies(spark, sf).select("barcode", F.concat(F.lit("  "), "barcode", F.lit(" ")).alias("key"))
    return C.normalize_barcode(ab, "key")


@query("surrogate_barcode", f"""WITH {ANTIBODIES_SQL}
SELECT count(*) AS n, count(*) AS n_ids, 0 AS lo, count(*) - 1 AS hi FROM ab""")
def surrogate_barcode(spark, sf):
    ids = C.normalize_barcode(antibodies(spark, sf).select("hseq"), "barcode")
    n = F.col("barcode").cast("long")
    return ids.agg(F.count("*").alias("n"), F.count_distinct("barcode").alias("n_ids"), F.min(n).alias("lo"), F.max(n).alias("hi"))


@query("null_like_to_empty", f"""WITH {ANTIBODIES_SQL}, m AS (
  SELECT barcode, CASE WHEN cdr3 = '' THEN NULL WHEN tile % 3 = 0 THEN ' NaN ' WHEN tile % 3 = 1 THEN 'n/a' ELSE cdr3 END AS c FROM ab)
SELECT barcode, CASE WHEN c IS NULL OR lower(trim(c)) IN ('nan','none','null','n/a','na','') THEN '' ELSE c END AS c FROM m""")
def null_like_to_empty(spark, sf):
    t = F.col("tile") % 3
    messy = F.when(F.col("cdr3") == "", None).when(t == 0, " NaN ").when(t == 1, "n/a").otherwise(F.col("cdr3"))
    return C.clean_nulls(antibodies(spark, sf).select("barcode", messy.alias("c")), ["c"])


@query("require_columns", f"""WITH {ASSAYS_SQL} SELECT barcode, psr_norm_avidin FROM assay
WHERE psr_norm_insulin IS NOT NULL AND psr_norm_avidin IS NOT NULL""")
def require_columns(spark, sf):
    kept = C.require_columns(assays(spark, sf), ["barcode", "psr_norm_insulin", "psr_norm_avidin"])
    return kept.select("barcode", "psr_norm_avidin")


@query("extract_cdr3_regex", f"WITH {ANTIBODIES_SQL}, {EXTRACTED_SQL} SELECT barcode, loop FROM found")
def extract_cdr3_regex(spark, sf):
    return antibodies(spark, sf).select("barcode", T.cdr3_from_heavy_chain(F.col("hseq")).alias("loop"))


@query("ensure_cdr3", f"""WITH {ANTIBODIES_SQL}, {EXTRACTED_SQL}
SELECT barcode, CASE WHEN lower(trim(cdr3)) IN ('nan','none','null','n/a','na','') THEN loop ELSE cdr3 END AS cdr3 FROM found""")
def ensure_cdr3(spark, sf):
    return C.ensure_cdr3(antibodies(spark, sf)).select("barcode", "cdr3")


@query("cdr3_fill_counts", f"""WITH {ANTIBODIES_SQL}, {EXTRACTED_SQL}
SELECT CASE WHEN lower(trim(cdr3)) NOT IN ('nan','none','null','n/a','na','') THEN 'given' WHEN loop <> '' THEN 'extracted' ELSE 'failed' END AS method,
       count(*) AS n FROM found GROUP BY 1""")
def cdr3_fill_counts(spark, sf):
    return C.cdr3_fill_counts(antibodies(spark, sf))


@query("fix_c_prefix", f"""WITH {ANTIBODIES_SQL}
SELECT barcode, CASE WHEN cdr3 <> '' AND cdr3 NOT LIKE 'C%' THEN 'C' || cdr3 ELSE cdr3 END AS cdr3 FROM ab""")
def fix_c_prefix(spark, sf):
    return C.fix_c_prefix(antibodies(spark, sf)).select("barcode", "cdr3")


@query("strip_leading_c_auto", f"""WITH {ANTIBODIES_SQL}, p AS (
  SELECT barcode, CASE WHEN cdr3 <> '' THEN 'C' || cdr3 ELSE cdr3 END AS c FROM ab),
s AS (SELECT avg(CASE WHEN c LIKE 'C%' THEN 1 ELSE 0 END) AS share FROM p)
SELECT barcode, CASE WHEN share > 0.9 AND c LIKE 'C%' THEN substr(c, 2) ELSE c END AS cdr3 FROM p, s""")
def strip_leading_c_auto(spark, sf):
    prefixed = F.when(F.col("cdr3") != "", F.concat(F.lit("C"), "cdr3")).otherwise(F.col("cdr3"))
    return C.strip_leading_c(antibodies(spark, sf).select("barcode", prefixed.alias("cdr3")))


@query("strip_leading_c_always", f"""WITH {ANTIBODIES_SQL}
SELECT barcode, CASE WHEN cdr3 LIKE 'C%' THEN substr(cdr3, 2) ELSE cdr3 END AS cdr3 FROM ab""")
def strip_leading_c_always(spark, sf):
    return C.strip_leading_c(antibodies(spark, sf), mode="always").select("barcode", "cdr3")


@query("strip_cdr3_loop", f"""WITH {ANTIBODIES_SQL}
SELECT barcode, regexp_replace(regexp_replace(cdr3, '^(CAR|C)', ''), '.D[YW]$', '') AS loop FROM ab""")
def strip_cdr3_loop(spark, sf):
    return antibodies(spark, sf).select("barcode", T.hypervariable_loop(F.col("cdr3")).alias("loop"))


@query("one_hot_ready", f"""WITH {ANTIBODIES_SQL} SELECT barcode, hseq, lseq FROM ab WHERE length(trim(hseq)) >= 5""")
def one_hot_ready(spark, sf):
    return C.one_hot_ready(antibodies(spark, sf)).select("barcode", "hseq", "lseq")


@query("one_hot_ready_report", f"""WITH {ANTIBODIES_SQL} SELECT count(*) AS n, count(*) FILTER (lseq = '') AS empty_lseq,
count(*) FILTER (length(trim(hseq)) < 5) AS dropped, count(*) FILTER (length(trim(hseq)) >= 5) AS kept FROM ab""")
def one_hot_ready_report(spark, sf):
    return C.one_hot_ready_report(antibodies(spark, sf))


@query("denoise_elisa", f"""WITH {ASSAYS_SQL} SELECT barcode, psr_filter, id2 FROM assay
WHERE psr_norm_insulin IS NOT NULL AND psr_norm_dna IS NOT NULL AND psr_norm_smp IS NOT NULL AND psr_norm_avidin IS NOT NULL
  AND psr_filter = psr_rf_elisa AND lower(antigen) NOT LIKE '%src1%' AND id2 > 8700""")
def denoise_elisa(spark, sf):
    named = assays(spark, sf).withColumn("antigen", F.regexp_replace("antigen", "src1", "TeSt1"))
    return C.denoise_elisa(named).select("barcode", "psr_filter", "id2")


@query("derive_spr_label", f"""WITH {LABELLED_SQL}, n AS (
  SELECT barcode, CASE (doc_id + tile) % 5 WHEN 0 THEN 'premium' WHEN 1 THEN 'strong, later fail' WHEN 2 THEN 'weak' WHEN 3 THEN 'fail' ELSE 'unclear' END AS note FROM lab)
SELECT barcode, CASE WHEN note LIKE '%fail%' THEN 0 WHEN regexp_matches(note, 'premium|strong|weak') THEN 1 END AS label FROM n""")
def derive_spr_label(spark, sf):
    notes = F.array(*[F.lit(x) for x in ("premium", "strong, later fail", "weak", "fail", "unclear")])
    note = F.element_at(notes, ((F.col("doc_id") + F.col("tile")) % 5 + 1).cast("int"))
    return labelled(spark, sf).select("barcode", T.spr_label(note).alias("label"))


CHARGE2_SQL = """(length(cdr3) - length(translate(cdr3, 'RKH', ''))) - (length(cdr3) - length(translate(cdr3, 'DE', '')))"""


@query("trainset_exclusions", f"""WITH {ASSAYS_SQL}, q AS (SELECT *, {CHARGE2_SQL} AS charge2,
  (psr_norm_insulin + psr_norm_dna + psr_norm_smp + psr_norm_avidin) / 4 AS psr_mean FROM assay
  WHERE psr_norm_insulin IS NOT NULL AND psr_norm_dna IS NOT NULL AND psr_norm_smp IS NOT NULL AND psr_norm_avidin IS NOT NULL),
s1 AS (SELECT * FROM q WHERE barcode NOT IN (SELECT barcode FROM q WHERE charge2 > 2 AND psr_filter = 1)),
s2 AS (SELECT * FROM s1 WHERE barcode NOT IN (SELECT barcode FROM s1 WHERE charge2 < 0 AND psr_filter = 0 AND psr_mean < 1)),
s3 AS (SELECT * FROM s2 WHERE barcode NOT IN (SELECT barcode FROM s2 WHERE psr_filter = 1 AND psr_norm_insulin > 0.3 AND charge2 > 1))
SELECT barcode, charge2, psr_filter FROM s3 WHERE id2 > 8763""")
def trainset_exclusions(spark, sf):
    from ..functions.sequence import simple_charge

    table_ = C.with_assay_mean(assays(spark, sf)).withColumn("charge2", simple_charge(F.col("cdr3"), histidine=True))
    return C.trainset_exclusions(table_).select("barcode", "charge2", "psr_filter")


@query("assay_mean", f"""WITH {ASSAYS_SQL} SELECT barcode,
  round((psr_norm_insulin + psr_norm_dna + psr_norm_smp + psr_norm_avidin) / 4, 9) AS psr_mean FROM assay
WHERE psr_norm_insulin IS NOT NULL AND psr_norm_dna IS NOT NULL AND psr_norm_smp IS NOT NULL AND psr_norm_avidin IS NOT NULL""")
def assay_mean(spark, sf):
    return C.with_assay_mean(assays(spark, sf)).select("barcode", F.round("psr_mean", 9).alias("psr_mean"))


@query("label_to_text", f"""WITH {LABELLED_SQL} SELECT barcode, CASE quality WHEN 1 THEN 'PASS' ELSE 'FAIL' END AS label FROM lab""")
def label_to_text(spark, sf):
    return labelled(spark, sf).select("barcode", T.label_text(F.col("quality")).alias("label"))


@query("cdr3_length_filter", f"WITH {ANTIBODIES_SQL} SELECT barcode, length(lseq) AS n FROM ab WHERE length(lseq) < 120")
def cdr3_length_filter(spark, sf):
    return C.cdr3_shorter_than(antibodies(spark, sf), "lseq", 120).select("barcode", F.length("lseq").alias("n"))


@query("cutoff_label", f"""WITH {ASSAYS_SQL} SELECT barcode, CASE WHEN psr_norm_avidin < 0.27 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM assay""")
def cutoff_label(spark, sf):
    return assays(spark, sf).select("barcode", T.below_cutoff(F.col("psr_norm_avidin")).alias("label"))


@query("logit_score", f"""WITH {LABELLED_SQL}, p AS (SELECT barcode, least(greatest(score, 1e-6), 1 - 1e-6) AS p FROM lab)
SELECT barcode, round(ln(p / (1 - p)), 6) AS logit FROM p""")
def logit_score(spark, sf):
    return labelled(spark, sf).select("barcode", r6(T.logit(F.col("score"))).alias("logit"))


IN_RANGE = "min({c}) >= -0.01 AND max({c}) <= 1.01"


@query("detect_score_columns", f"""WITH {LABELLED_SQL}, r AS (SELECT {IN_RANGE.format(c='score')} AS plain, {IN_RANGE.format(c='score * 3')} AS wide FROM lab)
SELECT 'rf_demo_ab_score' AS score_col, 'random_forest' AS model FROM r WHERE plain UNION ALL SELECT 'xgb_wide_score', 'xgboost' FROM r WHERE wide
UNION ALL SELECT 'transformer_lm_demo_score', 'transformer_lm' FROM r WHERE plain""")
def detect_scores(spark, sf):
    df = labelled(spark, sf).select(
        F.col("score").alias("rf_demo_ab_score"), (F.col("score") * 3).alias("xgb_wide_score"),
        F.col("score").alias("transformer_lm_demo_score"), F.col("quality").alias("rf_demo_ab_label"), "barcode",
    )
    return spark.createDataFrame(detect_score_columns(df), "score_col string, model string")


@query("detect_task", f"""WITH {LABELLED_SQL}
SELECT 'quality' AS target, 'classification' AS task, count(*) AS n FROM lab
UNION ALL SELECT 'score', 'regression', count(*) FROM lab""")
def detect_task(spark, sf):
    df = labelled(spark, sf)
    one = lambda t: C.detect_task(df, t).withColumn("target", F.lit(t))
    return one("quality").unionByName(one("score"))


@query("coerce_numeric", f"""WITH {ANTIBODIES_SQL}
SELECT barcode, try_cast(barcode AS DOUBLE) AS number, coalesce(try_cast(substr(barcode, 1, 1) AS DOUBLE), 0) AS first_digit FROM ab""")
def coerce_numeric(spark, sf):
    return antibodies(spark, sf).select(
        "barcode", T.number_or_null(F.col("barcode")).alias("number"),
        T.number_or_zero(F.substring("barcode", 1, 1)).alias("first_digit"),
    )


@query("validate_dataset", f"""WITH {LABELLED_SQL}, s AS (SELECT count(*) AS n, sum(quality)::BIGINT AS n1, (count(*) - sum(quality))::BIGINT AS n0 FROM lab)
SELECT n, least(n1, n0) AS min_class, round(least(n1, n0) / n, 6) AS min_rate, least(n, 256) AS safe_batch,
  CAST(greatest(2, least(CASE WHEN n < 500 THEN 3 WHEN n < 1000 THEN 5 ELSE 10 END, least(n1, n0), n // 2)) AS INTEGER) AS safe_kfold,
  n < 100 AS warn_small, least(n1, n0) / n < 0.05 AS warn_imbalance,
  greatest(2, least(CASE WHEN n < 500 THEN 3 WHEN n < 1000 THEN 5 ELSE 10 END, least(n1, n0), n // 2)) < 5 AS warn_few_folds,
  n < 500 AS warn_wide_embedding FROM s""")
def validate_dataset(spark, sf):
    return C.validate_dataset(labelled(spark, sf), "quality", 1024).withColumn("min_rate", r6("min_rate"))


# --- joins ----------------------------------------------------------------

@query("align_embedding", f"""WITH {LABELLED_SQL}, {EMBEDDINGS_SQL}
SELECT barcode, quality, len(embedding) AS dim FROM lab JOIN emb USING (barcode)""")
def align_embedding(spark, sf):
    return J.align_embedding(labelled(spark, sf), embeddings(spark, sf)).select("barcode", "quality", F.size("embedding").alias("dim"))


@query("alignment_report", f"""WITH {LABELLED_SQL}, {EMBEDDINGS_SQL}
SELECT count(*) AS n, count(e.barcode) AS matched, count(*) - count(e.barcode) AS excluded,
       round((count(*) - count(e.barcode)) / count(*), 6) AS excluded_share
FROM lab LEFT JOIN (SELECT DISTINCT barcode FROM emb) e USING (barcode)""")
def alignment_report(spark, sf):
    return J.alignment_report(labelled(spark, sf), embeddings(spark, sf)).withColumn("excluded_share", r6("excluded_share"))


@query("split_embedding", f"""WITH {LABELLED_SQL}, {EMBEDDINGS_SQL}
SELECT CASE WHEN fold = 0 THEN 'val' ELSE 'train' END AS side, count(e.barcode) AS found, count(*) - count(e.barcode) AS missing
FROM lab LEFT JOIN emb e USING (barcode) GROUP BY 1""")
def split_embedding(spark, sf):
    df = labelled(spark, sf)
    return J.split_embedding_counts(embeddings(spark, sf), df.where("fold <> 0"), df.where("fold = 0"))


@query("split_embedding_rows", f"""WITH {LABELLED_SQL}, {EMBEDDINGS_SQL}
SELECT barcode, CASE WHEN fold = 0 THEN 'val' ELSE 'train' END AS side FROM emb JOIN lab USING (barcode)""")
def split_embedding_rows(spark, sf):
    df = labelled(spark, sf)
    train, val = J.split_embedding(embeddings(spark, sf), df.where("fold <> 0"), df.where("fold = 0"))
    side = lambda t, s: t.select("barcode", F.lit(s).alias("side"))
    return side(train, "train").unionByName(side(val, "val"))


@query("multi_model_scores", f"""WITH {LABELLED_SQL}, {EMBEDDINGS_SQL}
SELECT lab.barcode, score AS rf_score, CAST(score >= 0.5 AS INTEGER) AS rf_label, CAST(score >= 0.5 AS INTEGER) AS rf_optimallabel,
  CASE WHEN e.barcode IS NOT NULL THEN score / 2 END AS lm_score,
  CASE WHEN e.barcode IS NOT NULL THEN CAST(score / 2 >= 0.3 AS INTEGER) END AS lm_label,
  CASE WHEN e.barcode IS NOT NULL THEN CAST(score / 2 >= 0.3 AS INTEGER) END AS lm_optimallabel
FROM lab LEFT JOIN emb e USING (barcode)""")
def multi_model_scores(spark, sf):
    df = labelled(spark, sf)

    def broken():
        raise RuntimeError("no stored model")

    wide, failed = J.multi_model_scores(
        df.select("barcode"),
        {
            "rf": lambda: df.select("barcode", "score"),
            "lm": lambda: J.align_embedding(df, embeddings(spark, sf)).select("barcode", (F.col("score") / 2).alias("score")),
            "broken": broken,
        },
        {"lm": 0.3},
    )
    assert list(failed) == ["broken"]
    return wide


@query("merge_score_files", f"""WITH {LABELLED_SQL}
SELECT coalesce(a.barcode, b.barcode) AS barcode, a.score AS s1, a.toxic AS toxic, b.s2 AS s2
FROM (SELECT barcode, score, toxic FROM lab WHERE fold < 3) a
FULL JOIN (SELECT barcode, 1 - score AS s2 FROM lab WHERE fold > 1) b USING (barcode)""")
def merge_score_files(spark, sf):
    df = labelled(spark, sf)
    first = df.where("fold < 3").select("barcode", F.col("score").alias("s1"), "toxic")
    second = df.where("fold > 1").select("barcode", (1 - F.col("score")).alias("s2"), F.col("toxic") + 5)
    return J.merge_score_files([first, second.withColumnRenamed("(toxic + 5)", "toxic")])


@query("exclude_ids", f"WITH {LABELLED_SQL} SELECT barcode FROM ab WHERE barcode NOT IN (SELECT barcode FROM lab)")
def exclude_ids(spark, sf):
    return J.exclude_ids(antibodies(spark, sf), labelled(spark, sf)).select("barcode")


@query("compare_tables", f"""WITH {ANTIBODIES_SQL}, b AS (
  SELECT barcode, CASE WHEN doc_id % 7 = 0 THEN lseq ELSE hseq END AS hseq, CASE WHEN doc_id % 7 = 0 THEN hseq ELSE lseq END AS lseq, cdr3 FROM ab)
SELECT count(*) AS n_shared, count(*) FILTER (ab.hseq = b.hseq) AS hseq_match, count(*) FILTER (ab.lseq = b.lseq) AS lseq_match,
  count(*) FILTER (ab.cdr3 = b.cdr3) AS cdr3_match, count(*) FILTER (ab.hseq = b.lseq AND ab.lseq = b.hseq) AS swapped, 'mixed' AS verdict
FROM ab JOIN b USING (barcode)""")
def compare_tables(spark, sf):
    ab = antibodies(spark, sf)
    swap = F.col("doc_id") % 7 == 0
    other = ab.select(
        "barcode", F.when(swap, F.col("lseq")).otherwise(F.col("hseq")).alias("hseq"),
        F.when(swap, F.col("hseq")).otherwise(F.col("lseq")).alias("lseq"), "cdr3",
    )
    return J.compare_tables(ab, other)


@query("overlap_scores", f"""WITH {LABELLED_SQL}, m AS (SELECT count(*) AS n_shared, avg(score) AS mean_a, avg(score * quality) AS mean_b FROM lab WHERE fold < 4)
SELECT n_shared, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(abs(mean_a - mean_b), 6) AS gap, abs(mean_a - mean_b) > 0.1 AS drift FROM m""")
def overlap_scores(spark, sf):
    df = labelled(spark, sf)
    other = df.where("fold < 4").select("barcode", (F.col("score") * F.col("quality")).alias("score"))
    out = J.overlap_scores(df, other, "score")
    return out.withColumns({c: r6(c) for c in ("mean_a", "mean_b", "gap")})


@query("length_qc", f"""WITH {LABELLED_SQL}, x AS (
  SELECT 'all' AS "table", cdr3, lseq FROM ab UNION ALL SELECT 'labelled', cdr3, lseq FROM lab)
SELECT "table", count(*) AS n, min(length(cdr3)) AS min_len, round(avg(length(cdr3)), 6) AS mean_len, max(length(cdr3)) AS max_len,
  round(avg(CASE WHEN length(cdr3) > 14 THEN 1 ELSE 0 END), 6) AS long_share, round(avg(length(lseq)), 6) AS mean_lseq,
  round(avg(CASE WHEN lseq = '' THEN 1 ELSE 0 END), 6) AS empty_lseq_share, round(avg(CASE WHEN lseq = 'nan' THEN 1 ELSE 0 END), 6) AS nan_lseq_share
FROM x GROUP BY 1""")
def length_qc(spark, sf):
    out = J.length_qc({"all": antibodies(spark, sf), "labelled": labelled(spark, sf)}, 14)
    return out.withColumns({c: r6(c) for c in ("mean_len", "long_share", "mean_lseq", "empty_lseq_share", "nan_lseq_share")})


@query("calibration_probe", f"""WITH {LABELLED_SQL}, f AS (SELECT quality AS class, score AS s FROM lab
  QUALIFY row_number() OVER (PARTITION BY quality ORDER BY row_id) <= 20)
SELECT class, count(*) AS n, round(avg(s), 6) AS mean, min(s) AS min, max(s) AS max,
  round(avg(CASE WHEN s >= 0.5 THEN 1 ELSE 0 END), 6) AS share_above FROM f GROUP BY 1""")
def calibration_probe(spark, sf):
    out = J.calibration_probe(labelled(spark, sf), "score", "quality", "row_id", 0.5)
    return out.withColumns({"mean": r6("mean"), "share_above": r6("share_above")})


# --- set operations and loaders -------------------------------------------

@query("union_distinct", f"WITH {LABELLED_SQL} SELECT cdr3 FROM ab UNION SELECT cdr3 FROM lab UNION SELECT germline FROM ab")
def union_distinct(spark, sf):
    ab = antibodies(spark, sf)
    return J.union_distinct([ab.select("cdr3"), labelled(spark, sf).select("cdr3"), ab.select(F.col("germline").alias("cdr3"))])


@query("common_keys", f"WITH {LABELLED_SQL}, {EMBEDDINGS_SQL} SELECT barcode FROM lab INTERSECT SELECT barcode FROM emb")
def common_keys(spark, sf):
    return J.common_keys(labelled(spark, sf), embeddings(spark, sf))


@query("except_keys", f"WITH {LABELLED_SQL}, {EMBEDDINGS_SQL} SELECT barcode FROM emb EXCEPT SELECT barcode FROM lab")
def except_keys(spark, sf):
    return J.exclude_ids(embeddings(spark, sf), labelled(spark, sf)).select("barcode")


@query("concat_rows", f"""WITH {LABELLED_SQL}
SELECT barcode, quality, NULL::DOUBLE AS score FROM lab UNION ALL SELECT barcode, NULL, score FROM lab""")
def concat_rows(spark, sf):
    df = labelled(spark, sf)
    return J.concat_rows([df.select("barcode", "quality"), df.select("barcode", "score")])


@query("load_previous", f"WITH {LABELLED_SQL}, {PREVIOUS_SQL} SELECT cdr3 FROM prev")
def load_previous(spark, sf):
    folder = shared_folder(spark, "previous")
    loops = previous(spark, sf)
    S.write_table(loops.select(F.concat(F.lit(" "), "cdr3").alias("cdr3")), f"{folder}/a.parquet")
    S.write_table(loops, f"{folder}/b.csv")
    S.write_table(loops.select(F.col("cdr3").alias("other")), f"{folder}/c.parquet")
    names = ("a.parquet", "b.csv", "c.parquet", "absent.csv")
    return S.load_previous(spark, [os.path.join(folder, n) for n in names])[0]


@query("previous_manifest", f"""WITH {LABELLED_SQL}, {PREVIOUS_SQL}, n AS (SELECT count(*) AS n FROM prev)
SELECT 'a' AS source, 'read' AS status, n AS rows, 0::BIGINT AS corrupt, '' AS missing FROM n UNION ALL SELECT 'b', 'read', n, count(*), '' FROM n, prev WHERE cdr3 LIKE '%A%' GROUP BY n
UNION ALL SELECT 'c', 'missing columns', n, 0, 'cdr3' FROM n UNION ALL SELECT 'absent', 'unreadable', NULL, NULL, NULL""")
def previous_manifest(spark, sf):
    """What became of every file of earlier loops: rows read, rows that do not fit the header, columns that lack."""
    folder = shared_folder(spark, "previous")
    loops = previous(spark, sf)
    S.write_table(loops, f"{folder}/a.parquet")
    ragged = F.when(F.col("cdr3").contains("A"), F.concat("cdr3", F.lit(",more"))).otherwise(F.col("cdr3"))
    loops.select(ragged.alias("value")).coalesce(1).write.text(f"{folder}/rows")
    header = loops.limit(0).select(F.lit("cdr3").alias("value")).unionByName(spark.sql("SELECT 'cdr3' AS value"))
    header.unionByName(spark.read.text(f"{folder}/rows")).coalesce(1).write.text(f"{folder}/b.csv")
    S.write_table(loops.select(F.col("cdr3").alias("other")), f"{folder}/c.parquet")
    _, manifest = S.load_previous(spark, [f"{folder}/{n}" for n in ("a.parquet", "b.csv", "c.parquet", "absent.csv")])
    source = F.regexp_extract("file", r"/(a|b|c|absent)\.(?:parquet|csv)", 1)
    out = manifest.groupBy(source.alias("source"), "status").agg(F.sum("rows").alias("rows"), F.sum("corrupt").alias("corrupt"), F.max(F.array_join("missing", ",")).alias("missing"))
    return out.select("source", "status", "rows", "corrupt", "missing")


@query("load_scored", f"""WITH {ASSAYS_SQL} SELECT 'rf_demo_score' AS score_col, count(*) AS n FROM assay
WHERE score IS NOT NULL AND psr_norm_insulin IS NOT NULL AND psr_norm_avidin IS NOT NULL""")
def load_scored(spark, sf):
    df = assays(spark, sf).withColumnRenamed("score", "rf_demo_score")
    loaded = S.load_scored(df, ["PSR_NORM_INSULIN", "psr_norm_avidin", "unknown"])
    parts = [t.agg(F.count("*").alias("n")).withColumn("score_col", F.lit(name)) for name, t in loaded.items()]
    return J.concat_rows(parts)


@query("load_benchmark_sheet", """
WITH f AS (SELECT item_id, last_value(CASE WHEN item_id % 4 = 0 THEN 'g' || (item_id % 3) END IGNORE NULLS) OVER (ORDER BY item_id) AS Architecture,
  CASE WHEN item_id % 5 <> 2 THEN 'lm' || (item_id % 7) END AS LM, length(text) AS F1 FROM benchmark)
SELECT item_id, Architecture, LM, F1, CASE Architecture WHEN 'g0' THEN 'zero' WHEN 'g1' THEN 'one' END AS cond FROM f WHERE LM IS NOT NULL""")
def load_benchmark_sheet(spark, sf):
    i = F.col("item_id")
    sheet = table(spark, sf, "benchmark").select(
        "item_id", F.when(i % 4 == 0, F.concat(F.lit("g"), (i % 3).cast("string"))).alias(" Architecture "),
        F.when(i % 5 != 2, F.concat(F.lit("lm"), (i % 7).cast("string"))).alias("Language Model"),
        F.length("text").alias("F1-Score"),
    )
    return S.load_benchmark_sheet(sheet, "Architecture", "item_id", {"g0": "zero", "g1": "one"})
