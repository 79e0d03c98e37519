"""Running sums, row numbers, ranks and ROC curves without a one-task sort.

A running total over a whole table is split in two: rows are bucketed by
approximate quantiles of the key, each bucket is summed on its own, and the
short list of bucket totals supplies the offsets.  Rows with equal keys must be
merged before (``groupBy(key)``), so one hot value is one row, not one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

def bucket_count(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_key_bucket(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """Bucket number of a numeric key by approximate quantiles of the table."""
    n = buckets or bucket_count(df)
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    bounds = df.agg(F.percentile_approx(F.col(key), shares, 20 * n)).scalar()
    marked = df.withColumn("_bounds", F.coalesce(bounds, F.array(F.lit(None))))
    passed = F.size(F.filter("_bounds", lambda b: b < F.col(key)))
    return marked.withColumn(name, passed).drop("_bounds")


def join_small(df: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Attach one row of totals per group; a single overall row needs no join key."""
    if by:
        return df.join(totals, by)
    names = totals.columns
    packed = totals.select(F.struct(*names)).scalar()
    return df.withColumn("_totals", packed).select(
        *df.columns, *[F.col("_totals")[n].alias(n) for n in names]
    )


def prefix_sum(
    df: DataFrame,
    key: str,
    sums: list[str],
    by: list[str] | None = None,
    descending: bool = False,
    following: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` (inclusive) for each of ``sums`` along ``key``.

    ``df`` has one row per (by, key).  ``following`` also adds ``next_<c>``, the
    value in the next row of the order.  The merged rows are written once, as
    bounds, totals and sums all read them; the source behind them is read once.
    """
    by = list(by or [])
    df = cut_lineage(df)
    split = with_key_bucket(df, key, "_bucket", buckets)
    order = F.col(key).desc() if descending else F.col(key).asc()
    edge = F.max_by if descending else F.min_by

    totals = split.groupBy(*by, "_bucket").agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in sums],
        edge(F.struct(*sums), F.col(key)).alias("_head"),
    )
    across = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    across = across.orderBy(F.col("_bucket").desc() if descending else F.col("_bucket").asc())
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums],
        F.lead("_head").over(across).alias("_next_head"),
    )
    if not by:
        offsets = F.broadcast(offsets)  # one row per bucket

    local = Window.partitionBy(*by, "_bucket").orderBy(order)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = split.join(offsets, [*by, "_bucket"])
    added = [(F.sum(c).over(running) + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in sums]
    if following:
        added += [
            F.coalesce(F.lead(c).over(local), F.col("_next_head")[c]).alias(f"next_{c}") for c in sums
        ]
    return out.select(*df.columns, *added)


def with_row_ids(df: DataFrame, name: str) -> DataFrame:
    """Consecutive ids 0..n-1 in scan order: per-partition counts plus offsets.

    The id of a row is its place in its partition plus the rows of earlier
    partitions; the offsets table has one row per partition and no data moves.
    ``df`` is read twice, so its partitions have to be fixed: pass a
    checkpointed table.
    """
    marked = df.withColumn("_mono", F.monotonically_increasing_id())
    part = F.shiftright("_mono", 33)
    counts = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        marked.withColumn("_part", part)
        .join(offsets, "_part")
        .select((F.col("_off") + place).alias(name), *df.columns)
    )


def with_sorted_ids(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Consecutive ids 0..n-1 along a full ordering, ties split by its last key.

    The sort range-partitions on all keys together, so equal leading values
    spread over partitions; the sorted table is written once, which fixes the
    partitions the ids are counted in.
    """
    return with_row_ids(cut_lineage(df.orderBy(*order)), name)


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """One row per distinct value with its count and tie-averaged rank.

    ``weight`` is how often a row counts, for input that is merged already.
    """
    by = list(by or [])
    count = F.sum(weight) if weight else F.count("*")
    counts = df.groupBy(*by, value).agg(count.alias("n"))
    ranked = prefix_sum(counts, value, ["n"], by)
    return ranked.select(*by, value, "n", (F.col("cum_n") - (F.col("n") - 1) / 2).alias("avg_rank"))


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact interpolated quantiles per group: columns ``by``, ``n`` and the array ``q``.

    Equal values are merged and ranked by running sums, so no task holds the
    values of a group; a quantile reads the one or two rows around its place.
    """
    by = list(by or [])
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = cut_lineage(prefix_sum(counts, value, ["n"], by))
    sizes = ranked.groupBy(*by).agg(F.max("cum_n").alias("_size"))
    rows = join_small(ranked, sizes, by)

    def at(index: Column) -> Column:
        holds = (F.col("cum_n") > index) & (F.col("cum_n") - F.col("n") <= index)
        return F.max(F.when(holds, F.col(value).cast("double")))

    found = []
    for share in shares:
        place = F.lit(share) * (F.col("_size") - 1)
        low = at(F.floor(place))
        found.append((low + (at(F.ceil(place)) - low) * F.max(place - F.floor(place))))
    return rows.groupBy(*by).agg(F.max("_size").alias("n"), F.array(*found).alias("q"))


# --- ROC and precision/recall --------------------------------------------

def score_counts(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score (nulls dropped)."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*(by or []), F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def roc_points(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """One row per distinct score, from high to low: counts at ``>= score``.

    ``corner`` marks the points that are not on a straight run between their
    neighbours (the first and last point always count as corners).
    """
    by = list(by or [])
    counts = cut_lineage(score_counts(df, score, label, by))
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    points = prefix_sum(counts, "score", ["pos", "neg"], by, descending=True, following=True)
    points = join_small(points, totals, by)
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    last = F.col("next_pos").isNull()
    bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return points.select(
        *by, "score", "pos", "neg", "n_pos", "n_neg", tp.alias("tp"), fp.alias("fp"),
        F.try_divide(tp, F.col("n_pos")).alias("tpr"),
        F.try_divide(fp, F.col("n_neg")).alias("fpr"),
        (tp / (tp + fp)).alias("precision"),
        (first | last | bend).alias("corner"),
    )


def curve_areas(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ROC and precision/recall areas of ``roc_points``; null for one class."""
    pos, neg, tp, fp = (F.col(c) for c in ("pos", "neg", "tp", "fp"))
    p, n = F.col("n_pos"), F.col("n_neg")
    before = tp - pos + fp - neg
    precision_before = F.when(before > 0, (tp - pos) / before).otherwise(F.lit(1.0))
    return points.groupBy(*(by or [])).agg(
        F.try_divide(F.sum(pos * (n - fp + neg / 2)), F.max(p.cast("double") * n)).alias("auc_roc"),
        F.try_divide(
            F.sum(pos * (F.col("precision") + precision_before) / 2), F.max(p)
        ).alias("auc_pr"),
        F.max(p).alias("n_pos"),
        F.max(n).alias("n_neg"),
    )


def roc_on_grid(points: DataFrame, by: list[str], steps: int = 100) -> DataFrame:
    """True-positive rate of each curve at ``steps`` even false-positive rates."""
    cells = steps - 1
    guess = F.ceil(F.col("fpr") * cells)
    at = lambda i: i / F.lit(float(cells))
    cell = F.when(at(guess - 1) >= F.col("fpr"), guess - 1).when(
        at(guess) < F.col("fpr"), guess + 1
    ).otherwise(guess)
    point = F.struct(F.col("fpr").alias("x"), F.col("tpr").alias("y"))
    hits = points.withColumn("cell", cell.cast("int")).groupBy(*by, "cell").agg(
        F.max(point).alias("low"), F.min(point).alias("high")
    )
    grid = points.groupBy(*by).agg(F.lit(1).alias("_one")).select(
        *by, F.explode(F.sequence(F.lit(0), F.lit(cells))).alias("cell")
    )
    w = Window.partitionBy(*by).orderBy("cell")
    joined = grid.join(hits, [*by, "cell"], "left").select(
        *by,
        "cell",
        F.max("low").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("low"),
        F.min("high").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("high"),
    )
    x = at(F.col("cell"))
    lx, ly = F.coalesce(F.col("low.x"), F.lit(0.0)), F.coalesce(F.col("low.y"), F.lit(0.0))
    slope = (F.col("high.y") - ly) / (F.col("high.x") - lx)
    tpr = F.when(F.col("cell") == 0, F.lit(0.0)).when(F.col("high").isNull(), ly).otherwise(
        ly + (x - lx) * slope
    )
    return joined.select(*by, F.col("cell").alias("step"), x.alias("fpr"), tpr.alias("tpr"))


def mean_roc(grid: DataFrame, steps: int = 100) -> DataFrame:
    """Mean curve over folds with population spread; the last mean is 1."""
    mean = F.when(F.col("step") == steps - 1, F.lit(1.0)).otherwise(F.avg("tpr"))
    return grid.groupBy("step", "fpr").agg(
        mean.alias("mean_tpr"), F.stddev_pop("tpr").alias("std_tpr")
    )
