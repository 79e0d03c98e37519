"""Decision thresholds: sweeps, selection rules, reports, stability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .ordered import curve_areas, join_small, roc_points

METRICS = ("sensitivity", "specificity", "precision", "f1", "f2", "youden")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b2 = beta * beta
    return ratio((1 + b2) * precision * recall, b2 * precision + recall)


def confusion(df: DataFrame, score: str, label: str, threshold: Column | float,
              by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp at ``score >= threshold`` in one pass."""
    up = F.col(score) >= threshold
    pos, neg = F.col(label) == 1, F.col(label) == 0
    return df.groupBy(*(by or [])).agg(
        F.count_if(neg & ~up).alias("tn"), F.count_if(neg & up).alias("fp"),
        F.count_if(pos & ~up).alias("fn"), F.count_if(pos & up).alias("tp"),
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    """Sensitivity, specificity, precision, F1, F2 and Youden from four counts."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    sens, spec, prec = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp)
    return counts.select(
        "*", sens.alias("sensitivity"), spec.alias("specificity"), prec.alias("precision"),
        f_beta(prec, sens, 1).alias("f1"), f_beta(prec, sens, 2).alias("f2"),
        (sens + spec - 1).alias("youden"),
    )


def metrics_at(df: DataFrame, score: str, label: str, threshold: float,
               by: list[str] | None = None) -> DataFrame:
    """All point metrics at one threshold, with accuracy and predicted-positive rate."""
    counts = with_metrics(confusion(df, score, label, threshold, by))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return counts.select(
        *(by or []), F.lit(float(threshold)).alias("threshold"),
        ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"),
        "f1", "f2", "precision", "sensitivity", "specificity",
        F.col("sensitivity").alias("recall_pass"), F.col("specificity").alias("recall_fail"),
        ratio(F.col("tp") + F.col("fp"), n).alias("pos_rate"),
    )


def counts_on_grid(df: DataFrame, score: str, label: str, lo: Column, hi: Column, steps: int,
                   by: list[str] | None = None) -> DataFrame:
    """Confusion counts at ``steps`` even thresholds from ``lo`` to ``hi``.

    One pass: each score becomes the number of grid values it reaches, the
    counts per number are summed map-side, and a running sum over at most
    ``steps`` rows per group turns them into counts per threshold.
    """
    by = list(by or [])
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *by, F.col(score).cast("double").alias("_s"), F.col(label).alias("_y")
    )
    span = known.groupBy(*by).agg(
        lo.cast("double").alias("_lo"), hi.cast("double").alias("_hi"),
        F.count_if(F.col("_y") == 1).alias("_p"), F.count_if(F.col("_y") == 0).alias("_n"),
    )
    width = (F.col("_hi") - F.col("_lo")) / (steps - 1)

    def grid(i: Column) -> Column:
        inner = F.col("_lo") + i * width
        return F.when(i == steps - 1, F.col("_hi")).otherwise(inner)

    guess = F.least(F.greatest(
        F.floor(F.coalesce(F.try_divide(F.col("_s") - F.col("_lo"), width), F.lit(0.0))), F.lit(-1)
    ), F.lit(steps - 1)).cast("int")
    reached = F.when((guess >= 0) & (grid(guess) > F.col("_s")), guess - 1).when(
        (guess < steps - 1) & (grid(guess + 1) <= F.col("_s")), guess + 1
    ).otherwise(guess)
    cells = join_small(known, span, by).groupBy(*by, reached.alias("step")).agg(
        F.count_if(F.col("_y") == 1).alias("_cp"), F.count_if(F.col("_y") == 0).alias("_cn")
    )
    axis = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    down = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.col("step").desc())
    tp = F.sum(F.coalesce("_cp", F.lit(0))).over(down)
    fp = F.sum(F.coalesce("_cn", F.lit(0))).over(down)
    return axis.join(cells, [*by, "step"], "left").select(
        *by, "step", grid(F.col("step")).alias("threshold"),
        tp.alias("tp"), fp.alias("fp"), (F.col("_n") - fp).alias("tn"), (F.col("_p") - tp).alias("fn"),
    )


def threshold_sweep(df: DataFrame, score: str, label: str, steps: int = 500,
                    by: list[str] | None = None) -> DataFrame:
    """Metrics at even thresholds just inside the observed score range."""
    counts = counts_on_grid(
        df, score, label, F.min("_s") + 1e-6, F.max("_s") - 1e-6, steps, by
    )
    return with_metrics(counts)


def _pick(metric: Column, prefer_low: bool = True) -> Column:
    """Sweep row with the largest metric; ties go to one end of the grid."""
    tie = -F.col("step") if prefer_low else F.col("step")
    row = F.struct(*[F.col(c) for c in ("threshold", "tp", "fp", "tn", "fn", *METRICS)])
    return F.max_by(row, F.struct(metric, tie))


def _rule(method: str, beta: float, cost_fp: float, cost_fn: float, precision_target: float,
          recall_target: float) -> Column:
    if method in ("youden", "f1", "f2"):
        return _pick(F.col(method))
    if method == "fbeta":
        b2 = beta * beta
        p, r = F.col("precision"), F.col("sensitivity")
        return _pick((1 + b2) * p * r / (b2 * p + r + 1e-12))
    if method == "cost":
        return _pick(-(F.col("fp") * cost_fp + F.col("fn") * cost_fn))
    if method == "precision_at":
        ok = F.col("precision") >= precision_target
        return _pick(F.when(ok, F.lit(2.0)).otherwise(F.col("precision")))
    if method == "recall_at":
        # met: highest threshold; never met: lowest threshold of the best recall
        ok = F.col("sensitivity") >= recall_target
        met, best = _pick(ok.cast("int"), prefer_low=False), _pick(F.col("sensitivity"))
        return F.when(F.bool_or(ok), met).otherwise(best)
    raise ValueError(f"unknown method: {method}")


def find_threshold(df: DataFrame, score: str, label: str, method: str = "auto", *, beta: float = 1.0,
                   cost_fp: float = 1.0, cost_fn: float = 2.0, precision_target: float = 0.8,
                   recall_target: float = 0.8, steps: int = 500, by: list[str] | None = None,
                   sweep: DataFrame | None = None) -> DataFrame:
    """Best sweep row per group by one rule.

    'auto' looks at the minority share of each group: above 35% Youden, above
    15% F2, else cost.
    """
    by = list(by or [])
    table = sweep if sweep is not None else threshold_sweep(df, score, label, steps, by)
    rule = lambda m: _rule(m, beta, cost_fp, cost_fn, precision_target, recall_target)
    if method != "auto":
        best = table.groupBy(*by).agg(rule(method).alias("b")).withColumn("method", F.lit(method))
    else:
        pos, neg = F.max(F.col("tp") + F.col("fn")), F.max(F.col("tn") + F.col("fp"))
        minority = F.least(pos, neg) / (pos + neg)
        chosen = F.when(minority > 0.35, "youden").when(minority > 0.15, "f2").otherwise("cost")
        best = table.groupBy(*by).agg(
            chosen.alias("method"),
            F.when(minority > 0.35, rule("youden")).when(minority > 0.15, rule("f2"))
            .otherwise(rule("cost")).alias("b"),
        )
    return best.select(*by, "method", "b.*")


def threshold_report(df: DataFrame, score: str, label: str, cost_fp: float = 1.0,
                     cost_fn: float = 3.0, steps: int = 500) -> DataFrame:
    """Nine selection rules side by side with the curve areas."""
    sweep = cut_lineage(threshold_sweep(df, score, label, steps))  # ``steps`` rows, read by every rule
    runs = [
        ("auto", "auto", dict(cost_fp=cost_fp, cost_fn=cost_fn)),
        ("youden", "youden", {}),
        ("f1", "f1", {}),
        ("f2", "f2", {}),
        ("f0.5", "fbeta", dict(beta=0.5)),
        ("f2.0", "fbeta", dict(beta=2.0)),
        ("recall_at_90", "recall_at", dict(recall_target=0.9)),
        ("precision_at_80", "precision_at", dict(precision_target=0.8)),
        ("cost", "cost", dict(cost_fp=cost_fp, cost_fn=cost_fn)),
    ]
    rows = [
        find_threshold(df, score, label, method, sweep=sweep, **options).withColumn("label", F.lit(name))
        for name, method, options in runs
    ]
    report = reduce(DataFrame.unionByName, rows)
    areas = curve_areas(roc_points(df, score, label)).select("auc_roc", "auc_pr")
    return join_small(report, areas, [])


def two_class_groups(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Rows of groups that hold both classes."""
    both = df.groupBy(*by).agg(F.count_distinct(label).alias("_k")).where("_k >= 2").select(*by)
    return df.join(both, by, "left_semi")


def threshold_by_fold(preds: DataFrame, method: str = "auto", cost_fp: float = 1.0,
                      cost_fn: float = 3.0) -> DataFrame:
    """Best threshold of every fold that holds both classes."""
    usable = two_class_groups(preds, "true", ["fold"])
    return find_threshold(usable, "prob", "true", method, cost_fp=cost_fp, cost_fn=cost_fn, by=["fold"])


def threshold_stability(preds: DataFrame, method: str = "auto", cost_fp: float = 1.0,
                        cost_fn: float = 3.0) -> DataFrame:
    """Spread of fold thresholds next to the threshold of all rows together."""
    folds = threshold_by_fold(preds, method, cost_fp, cost_fn).agg(
        F.avg("threshold").alias("mean_threshold"),
        F.stddev_pop("threshold").alias("std_threshold"),
        F.count("*").alias("n_folds"),
    )
    pooled = find_threshold(preds, "prob", "true", method, cost_fp=cost_fp, cost_fn=cost_fn).select(
        F.col("threshold").alias("pooled_threshold")
    )
    spread = F.col("std_threshold")
    verdict = F.when(spread < 0.05, "stable").when(spread < 0.10, "moderate").otherwise("unstable")
    return join_small(folds, pooled, []).withColumn("stability", verdict)


def evaluation_thresholds(df: DataFrame, score: str, label: str, cost_fp: float = 1.0,
                          cost_fn: float = 3.0) -> DataFrame:
    """Named thresholds of an evaluation: four on ROC corners, three on a fixed grid.

    ROC rules take the highest tied threshold, grid rules the lowest.  The
    origin of the curve (nothing predicted) stands for an infinite threshold.
    """
    corners = roc_points(df, score, label).where("corner").select(
        "score", "tpr", "fpr", (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("rate")
    )
    tpr, fpr, rate, s = F.col("tpr"), F.col("fpr"), F.col("rate"), F.col("score")
    cost = cost_fp * fpr * (1 - rate) + cost_fn * (1 - tpr) * rate
    infinite = F.lit(float("inf"))
    youden = F.max(F.struct((tpr - fpr).alias("m"), s.alias("t")))
    cheapest = F.max(F.struct((-cost).alias("m"), s.alias("t")))
    t_youden = F.when(youden["m"] > 0, youden["t"]).otherwise(infinite)
    t_cost = F.when(cheapest["m"] > -cost_fn * F.max(rate), cheapest["t"]).otherwise(infinite)
    t_at = lambda floor: F.coalesce(F.max(F.when(tpr >= floor, s)), t_youden)
    roc = corners.agg(
        t_youden.alias("youden"), t_cost.alias("cost"),
        t_at(0.90).alias("sens90"), t_at(0.95).alias("sens95"),
    )
    grid = with_metrics(counts_on_grid(df, score, label, F.lit(0.001), F.lit(0.999), 1000))
    p, r = F.col("precision"), F.col("sensitivity")
    lowest = lambda beta: F.max_by("threshold", F.struct(f_beta(p, r, beta), -F.col("step")))
    dense = grid.agg(lowest(1.0).alias("f1"), lowest(2.0).alias("f2"), lowest(0.5).alias("f05"))
    return join_small(roc, dense, []).select("youden", "cost", "f1", "f2", "f05", "sens90", "sens95")


LABEL_SUFFIXES = {
    "optimallabel": "youden", "costlabel": "cost", "f1label": "f1", "f2label": "f2",
    "f05label": "f05", "sens90label": "sens90",
}


def with_optimal_labels(df: DataFrame, score: str, thresholds: DataFrame) -> DataFrame:
    """Six label columns, one per rule; a missing score counts as 0."""
    stem = score.removesuffix("_score")
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    joined = join_small(df, thresholds.select(*[F.col(t).alias(f"_t_{t}") for t in thresholds.columns]), [])
    return joined.select(
        *df.columns,
        *[(value >= F.col(f"_t_{rule}")).cast("int").alias(f"{stem}_{suffix}")
          for suffix, rule in LABEL_SUFFIXES.items()],
    )


def apply_threshold(df: DataFrame, score: str, label_name: str, threshold: float | None = None,
                    stored: float | None = None, task: str = "classification") -> DataFrame:
    """Label column from a score: given threshold, else the stored one, else 0.5."""
    if task == "regression":
        return df.withColumn(label_name, F.col(score))
    cut = threshold if threshold is not None else stored if stored is not None else 0.5
    return df.withColumn(label_name, (F.col(score) >= cut).cast("int"))


def evaluate(df: DataFrame, score: str, target: str, test_target: str | None = None,
             cost_fp: float = 1.0, cost_fn: float = 3.0) -> dict[str, DataFrame]:
    """Summary, metrics per named threshold, and predictions with labels.

    ``test_target`` wins over ``target`` as ground truth.  One class only is an
    error, raised when the summary is computed.
    """
    label = test_target or target
    if label not in df.columns:
        raise ValueError(f"no ground-truth column: {label}")
    known = df.select(F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s")).na.drop()
    thresholds = evaluation_thresholds(known, "s", "y", cost_fp, cost_fn)
    named = thresholds.select(
        F.explode(F.array(
            F.struct(F.lit("t=0.5").alias("method"), F.lit(0.5).alias("threshold")),
            *[F.struct(F.lit(c).alias("method"), F.col(c).alias("threshold")) for c in thresholds.columns],
        )).alias("m")
    ).select("m.*")
    packed = named.agg(F.collect_list(F.struct("method", "threshold"))).scalar()  # 8 rows
    per_rule = known.select("y", "s", F.explode(packed).alias("m")).select("y", "s", "m.*")
    counts = with_metrics(confusion(per_rule, "s", "y", F.col("threshold"), ["method", "threshold"]))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    metrics = counts.select(
        "method", "threshold", ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"), "f1", "f2",
        "precision", "sensitivity", "specificity", ratio(F.col("tp") + F.col("fp"), n).alias("pos_rate"),
    )
    areas = curve_areas(roc_points(known, "s", "y")).select("auc_roc")
    summary = known.agg(
        F.count("*").alias("n"), F.avg("y").alias("pos_rate"),
        F.count_if(F.col("y") == 1).alias("class_1_n"), F.count_if(F.col("y") == 0).alias("class_0_n"),
        F.min("s").alias("score_min"), F.max("s").alias("score_max"), F.avg("s").alias("score_mean"),
    )
    one_class = (F.col("class_1_n") == 0) | (F.col("class_0_n") == 0)
    summary = join_small(summary, areas, []).withColumn(
        "auc_roc", F.when(one_class, F.raise_error(F.lit("only one class present")).cast("double"))
        .otherwise(F.col("auc_roc"))
    )
    return {
        "summary": join_small(summary, thresholds.select(
            *[F.col(c).alias(f"threshold_{c}") for c in ("youden", "cost", "f1", "f2")]), []),
        "metrics": metrics,
        "predictions": with_optimal_labels(df, score, thresholds),
    }
