"""Summary statistics, distributions and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.special import t_p_value
from ..functions.text import stars
from .ordered import join_small, quantiles


def target_stats(df: DataFrame, col: str) -> DataFrame:
    """Mean, population spread and range of a target."""
    return df.agg(
        F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    )


def _long(df: DataFrame, cols: list[str], keep: list[str], name: str, value: str) -> DataFrame:
    """One row per (row, column) of the numeric columns, nulls dropped."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).try_cast("double").alias(value)) for c in cols
    ])).alias("_p")
    return df.select(*keep, pairs).select(*keep, "_p.*").where(F.col(value).isNotNull())


def describe_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample spread, quartiles and range per column."""
    long = _long(df, cols, [], "column", "v")
    plain = long.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    q = quantiles(long, "v", [0.25, 0.5, 0.75], ["column"])
    return plain.join(q, "column").select(
        "column", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max"
    )


def correlation_to(df: DataFrame, cols: list[str], to: str) -> DataFrame:
    """Pearson correlation of each column with one column."""
    pairs = _long(df.withColumn("_to", F.col(to).cast("double")), cols, ["_to"], "column", "v")
    return pairs.groupBy("column").agg(F.corr("v", "_to").alias("pearson"))


def score_spread(df: DataFrame, scores: list[str], narrow: float = 0.15) -> DataFrame:
    """Mean and sample spread per score, flagged when the spread is narrow."""
    return _long(df, scores, [], "score_col", "v").groupBy("score_col").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        (F.stddev_samp("v") < narrow).alias("narrow"),
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Class counts, minority share, positive weight and the rules they trigger."""
    n1, n0 = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    stats = df.agg(n1.alias("n1"), n0.alias("n0"))
    minority = F.try_divide(F.least("n1", "n0"), F.col("n1") + F.col("n0"))
    return stats.select(
        "n1", "n0", minority.alias("minority_rate"),
        F.try_divide(F.col("n0"), F.col("n1")).alias("scale_pos_weight"),
        F.when(minority > 0.35, "youden").when(minority > 0.15, "f2").otherwise("cost").alias("threshold_rule"),
    )


def equal_width_bin(value: Column, lo: float, hi: float, bins: int) -> Column:
    """0-based bin; the last bin includes its right edge, outside is null."""
    inside = (value >= lo) & (value <= hi)
    raw = F.floor((value - lo) * bins / (hi - lo)).cast("int")
    return F.when(inside, F.least(raw, F.lit(bins - 1)))


def score_histogram(df: DataFrame, score: str, label: str, bins: int = 25) -> DataFrame:
    """Per class: counts on [0, 1], scaled to a largest bar of 1, with mean and median."""
    known = df.select(F.col(label).alias("class"), F.col(score).cast("double").alias("s")).na.drop()
    middle = quantiles(known, "s", [0.5], ["class"]).select("class", F.col("q")[0].alias("median"))
    centre = known.groupBy("class").agg(F.avg("s").alias("mean")).join(middle, "class")
    counts = (
        known.groupBy("class", equal_width_bin(F.col("s"), 0.0, 1.0, bins).alias("bin"))
        .agg(F.count("*").alias("n")).where("bin is not null")
    )
    height = F.col("n") / F.max("n").over(Window.partitionBy("class"))
    return counts.select("class", "bin", "n", height.alias("height")).join(centre, "class")


def score_kde(df: DataFrame, score: str, label: str, points: int = 500) -> DataFrame:
    """Per class Gaussian density on [0, 1], scaled to a peak of 1.

    The bandwidth h is ``n ** -0.2`` times the sample spread.  Scores are
    summed up in cells a quarter of h wide: the powers 0 to 8 of their distance
    from the cell's centre are all a grid point needs of them (the expansion in
    Hermite polynomials is exact to about 1e-13).  Cells beyond 39 h from the
    grid add exactly 0 and are left out, and a cell meets only the grid points
    within 39 h, so the rows formed do not depend on the number of scores.
    """
    order, reach = 8, 39.0
    known = df.select(F.col(label).alias("class"), F.col(score).cast("double").alias("s")).na.drop()
    width = known.groupBy("class").agg(
        (F.pow(F.count("*").cast("double"), F.lit(-0.2)) * F.stddev_samp("s")).alias("h"),
        F.count("*").alias("n_class"),
    ).where("n_class >= 2 and h > 0").drop("n_class")
    placed = known.join(width, "class").withColumn("cell", F.floor(F.col("s") * 4 / F.col("h")))
    centre = (F.col("cell") + 0.5) * F.col("h") / 4
    u = (F.col("s") - centre) / F.col("h")
    cells = placed.where(F.col("s").between(-reach * F.col("h"), 1 + reach * F.col("h")))
    cells = cells.groupBy("class", "h", "cell").agg(*[F.sum(F.pow(u, F.lit(k))).alias(f"m{k}") for k in range(order + 1)])
    last = float(points - 1)
    low = F.greatest(F.lit(0), F.ceil((centre - reach * F.col("h")) * last))
    high = F.least(F.lit(points - 1), F.floor((centre + reach * F.col("h")) * last))
    met = cells.withColumns({"low": low.cast("int"), "high": high.cast("int")}).where("low <= high")
    met = met.withColumn("step", F.explode(F.sequence("low", "high")))
    met = met.withColumn("t", (F.col("step") / F.lit(last) - centre) / F.col("h"))
    hermite, factor = [F.lit(1.0), F.col("t")], 1.0
    for k in range(1, order):
        hermite.append(F.col("t") * hermite[k] - k * hermite[k - 1])
    total = F.col("m0")
    for k in range(1, order + 1):
        factor *= k
        total = total + F.col(f"m{k}") * hermite[k] / factor
    sums = met.groupBy("class", "step").agg(F.sum(F.exp(-F.col("t") * F.col("t") / 2) * total).alias("k"))
    grid = width.select("class", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step"))
    sums = grid.join(sums, ["class", "step"], "left").withColumn("k", F.coalesce("k", F.lit(0.0)))
    peak = F.max("k").over(Window.partitionBy("class"))
    return sums.select("class", "step", (F.col("step") / (points - 1)).alias("x"), F.try_divide(F.col("k"), peak).alias("density"))


def class_density(df: DataFrame, label: str, panels: list[tuple[str, str, str]],
                  where: dict[str, Column] | None = None) -> DataFrame:
    """Density histograms per panel and class.

    ``panels`` is (panel, column, kind): kind 'unit' uses unit-wide bins centred
    on integers, 'edges_1_11' the ten bins between 1 and 11, the last one
    closed.  ``where`` restricts single panels.  Density is share over width.
    """
    where = where or {}
    values = []
    for panel, column, kind in panels:
        v = F.col(column).cast("double")
        if kind == "unit":
            bin_ = F.floor(v + 0.5)
        else:
            bin_ = F.when((v >= 1) & (v <= 11), F.least(F.floor(v), F.lit(10)))
        if panel in where:
            bin_ = F.when(where[panel], bin_)
        values.append(F.struct(F.lit(panel).alias("panel"), bin_.cast("long").alias("bin")))
    long = df.select(F.col(label).alias("class"), F.explode(F.array(*values)).alias("p")).select("class", "p.*")
    counts = long.where("bin is not null and class is not null").groupBy("panel", "class", "bin").agg(
        F.count("*").alias("n")
    )
    total = F.sum("n").over(Window.partitionBy("panel", "class"))
    return counts.select("panel", "class", "bin", "n", (F.col("n") / total).alias("density"))


def box_stats(df: DataFrame, assays: list[str], label: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier counts per assay and class."""
    long = _long(df.where(F.col(label).isNotNull()), assays, [label], "assay", "v")
    box = quantiles(long, "v", [0.25, 0.5, 0.75], ["assay", label]).select(
        "assay", label, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    fenced = long.join(box, ["assay", label])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    return fenced.groupBy("assay", label, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def _welch(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> tuple[Column, Column]:
    a, b = v1 / n1, v2 / n2
    t = F.try_divide(m1 - m2, F.sqrt(a + b))
    dof = F.try_divide((a + b) * (a + b), F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1))
    return t, dof


def welch_ttest(df: DataFrame, value: str, group: str, first, second, by: list[str] | None = None) -> DataFrame:
    """Unequal-variance t test of ``first`` against ``second``."""
    by = list(by or [])

    def side(g, tag):
        v = F.when(F.col(group) == F.lit(g), F.col(value).cast("double"))
        return [F.avg(v).alias(f"m{tag}"), F.var_samp(v).alias(f"v{tag}"), F.count(v).alias(f"n{tag}")]

    sums = df.groupBy(*by).agg(*side(first, 1), *side(second, 2))
    t, dof = _welch(*[F.col(c) for c in ("m1", "v1", "n1", "m2", "v2", "n2")])
    out = sums.select(*by, "n1", "n2", "m1", "m2", t.alias("t"), dof.alias("dof"))
    out = out.withColumn("p_value", t_p_value(F.col("t"), F.col("dof")))
    return out.withColumn("significance", stars(F.col("p_value")))


def regression_metrics(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """R2, mean absolute error and both correlations; null with two rows or fewer."""
    from .correlation import spearman

    by = list(by or [])
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    known = df.where(y.isNotNull() & p.isNotNull())
    sums = known.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        (1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count("*"))).alias("r2"),
        F.corr(y, p).alias("pearson"),
    )
    ranks = spearman(known, truth, pred, by).select(*by, "spearman")
    joined = sums.join(ranks, by, "left") if by else join_small(sums, ranks, [])
    enough = F.col("n") > 2
    return joined.select(
        *by, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("r2", "mae", "pearson", "spearman")]
    )


# --- learning curves ------------------------------------------------------

def consecutive_difference(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Difference to the previous row of a learning curve (a short table)."""
    w = Window.orderBy(order)
    return df.withColumn(name, F.col(value) - F.lag(value).over(w))


def rolling_mean(df: DataFrame, order: str, value: str, name: str, width: int = 5) -> DataFrame:
    """Mean of the last ``width`` rows of a learning curve, fewer at its start."""
    w = Window.orderBy(order).rowsBetween(-(width - 1), 0)
    return df.withColumn(name, F.avg(value).over(w))


def size_bucket(size: Column, low: float, mid: float) -> Column:
    return F.when(size <= low, "low").when(size <= mid, "mid").otherwise("high")


def bucket_means(df: DataFrame, size: str, value: str, low: float, mid: float) -> DataFrame:
    """Mean and sample spread of a metric in three size buckets."""
    return df.groupBy(size_bucket(F.col(size), low, mid).alias("bucket")).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")
    )


def scaling_linear(df: DataFrame, size: str, metrics: list[str], alpha: float = 0.05) -> DataFrame:
    """Straight-line fit per metric: slope, intercept, R2, slope p, verdict."""
    long = _long(df.withColumn("_x", F.col(size).cast("double")), metrics, ["_x"], "metric", "v")
    fit = long.groupBy("metric").agg(
        F.count("v").alias("n"), F.regr_slope("v", "_x").alias("slope"),
        F.regr_intercept("v", "_x").alias("intercept"), F.regr_r2("v", "_x").alias("r_squared"),
        F.regr_sxx("v", "_x").alias("_sxx"), F.regr_syy("v", "_x").alias("_syy"),
    )
    residual = F.greatest((1 - F.col("r_squared")) * F.col("_syy"), F.lit(0.0))
    error = F.sqrt(F.try_divide(F.try_divide(residual, F.col("n") - 2), F.col("_sxx")))
    out = fit.withColumn("t", F.try_divide(F.col("slope"), error))
    out = out.withColumn("p_value", t_p_value(F.col("t"), F.col("n") - 2))
    positive = (F.col("slope") > 0) & (F.col("p_value") < alpha)
    return out.select("metric", "n", "slope", "intercept", "r_squared", "t", "p_value",
                      positive.alias("positive_scaling"))


def scaling_quadratic(df: DataFrame, size: str, metrics: list[str]) -> DataFrame:
    """Quadratic fit per metric from one pass of power sums.

    Sizes are centred and scaled by their mean before the sums, which keeps the
    normal equations well conditioned; coefficients are mapped back after.
    """
    x = F.col(size).cast("double")
    scale = df.agg(F.avg(x).alias("_m"), F.coalesce(F.stddev_pop(x), F.lit(1.0)).alias("_d"))
    z = (x - F.col("_m")) / F.col("_d")
    long = join_small(df, scale, []).select(
        "_m", "_d", z.alias("z"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"))
                            for m in metrics])).alias("_p"),
    ).select("_m", "_d", "z", "_p.*").na.drop()
    Z, V = F.col("z"), F.col("v")
    # Orthogonal basis 1, z - a, z^2 - b z - c: its sums are plain moments.
    s = long.groupBy("metric", "_m", "_d").agg(
        F.count("*").alias("n"), F.avg(Z).alias("a1"), F.avg(Z * Z).alias("a2"),
        F.avg(Z * Z * Z).alias("a3"), F.avg(Z * Z * Z * Z).alias("a4"),
        F.avg(V).alias("b0"), F.avg(Z * V).alias("b1"), F.avg(Z * Z * V).alias("b2"),
        F.var_pop(V).alias("vv"),
    )
    c = F.col
    s11 = c("a2") - c("a1") * c("a1")
    s12 = c("a3") - c("a1") * c("a2")
    s22 = c("a4") - c("a2") * c("a2")
    r1 = c("b1") - c("a1") * c("b0")
    r2 = c("b2") - c("a2") * c("b0")
    det = s11 * s22 - s12 * s12
    q1 = F.try_divide(r1 * s22 - r2 * s12, det)
    q2 = F.try_divide(r2 * s11 - r1 * s12, det)
    solved = s.select("*", q1.alias("q1"), q2.alias("q2"), s11.alias("s11"), s12.alias("s12"),
                      s22.alias("s22"), det.alias("det"), r1.alias("r1"), r2.alias("r2"))
    explained = c("q1") * c("r1") + c("q2") * c("r2")
    noise = F.try_divide(F.greatest(c("vv") - explained, F.lit(0.0)) * c("n"), c("n") - 3)
    quad = c("q2") / (c("_d") * c("_d"))
    lin = c("q1") / c("_d") - 2 * c("_m") * quad
    icpt = c("b0") - c("q1") * c("a1") - c("q2") * c("a2") - c("q1") * c("_m") / c("_d") + quad * c("_m") * c("_m")
    var_q1 = noise * c("s22") / (c("det") * c("n"))
    var_q2 = noise * c("s11") / (c("det") * c("n"))
    cov = -noise * c("s12") / (c("det") * c("n"))
    # lin = q1/d - 2 m q2/d^2
    k1, k2 = 1 / c("_d"), -2 * c("_m") / (c("_d") * c("_d"))
    var_lin = k1 * k1 * var_q1 + k2 * k2 * var_q2 + 2 * k1 * k2 * cov
    out = solved.select(
        "metric", "n", icpt.alias("intercept"), lin.alias("slope_linear"), quad.alias("coeff_quadratic"),
        F.try_divide(explained, c("vv")).alias("r_squared"),
        F.try_divide(lin, F.sqrt(var_lin)).alias("t_linear"),
        F.try_divide(c("q2"), F.sqrt(var_q2)).alias("t_quadratic"),
    )
    return out.select(
        "*", t_p_value(c("t_linear"), c("n") - 3).alias("p_linear"),
        t_p_value(c("t_quadratic"), c("n") - 3).alias("p_quadratic"),
    )
