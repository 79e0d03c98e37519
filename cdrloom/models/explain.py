"""Which features drive a model: exact linear parts, permutation, rankings."""

from __future__ import annotations

from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import curve_areas, roc_points, with_sorted_ids
from ..operators.sampling import hash_order, top_by_magnitude
from ..session import cut_lineage
from .training import scored


def attribution_ranking(df: DataFrame, feature: str, value: str, n: int = 50) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    mean = df.groupBy(feature).agg(F.avg(F.abs(value)).alias("importance"))
    return top_by_magnitude(mean, "importance", n, feature)


def position_attribution(df: DataFrame, pos: str, value: str) -> DataFrame:
    """Mean attribution per position over the sequences long enough to have it."""
    return df.groupBy(pos).agg(F.avg(F.abs(value)).alias("importance"), F.count("*").alias("n"))


def linear_contributions(df: DataFrame, model, names: list[str], key: str, keep: list[int]) -> DataFrame:
    """Long (key, feature, value): coefficient times centred value of a linear model.

    The zeros of a sparse row contribute through the centre alone, so every
    kept feature gets a value per row; all others leave the vector in the JVM.
    """
    weights = model.coefficients.toArray()
    table = df.sparkSession.createDataFrame(
        [(i, names[i], float(weights[i])) for i in keep], "i int, feature string, w double"
    )
    narrow = VectorSlicer(inputCol="features", outputCol="_kept", indices=keep).transform(df.select(key, "features"))
    places = F.array(*[F.lit(i) for i in keep])
    long = narrow.select(key, F.posexplode(vector_to_array("_kept")).alias("k", "x")).select(key, F.get(places, F.col("k")).alias("i"), "x")
    long = long.join(F.broadcast(table), "i")
    mean = long.groupBy("i").agg(F.avg("x").alias("m"))
    return long.join(F.broadcast(mean), "i").select(key, "feature", (F.col("w") * (F.col("x") - F.col("m"))).alias("value"))


def permutation_importance(df: DataFrame, model, label: str, names: list[str], keep: list[int], key: str = "barcode",
                           repeats: int = 3, seed: int = 42) -> DataFrame:
    """Loss of AUC when one feature is shuffled, over all rows.

    The table is copied once per (feature, repeat) with that feature taken from
    another row: rows are numbered once in a shuffled order, and a copy takes
    the value that stands a shift of its own further on.  All copies are scored
    in one bulk transform.
    """
    rows = df.select(key, label, vector_to_array("features").alias("x"))
    base = cut_lineage(with_sorted_ids(rows, [hash_order(key, seed), F.col(key)], "_id"))
    n = base.count()
    slots = F.array(*[F.lit(i) for i in keep])
    task = F.explode(F.sequence(F.lit(0), F.lit(len(keep) * repeats - 1))).alias("_task")
    copies = base.select("_id", label, "x", task).select(  # rows x features x repeats
        "_id", label, "x", F.element_at(slots, F.col("_task") % len(keep) + 1).alias("i"),
        F.floor(F.col("_task") / len(keep)).alias("repeat"),
    )
    shift = 1 + F.pmod(F.xxhash64("i", "repeat", F.lit(seed)), F.lit(max(1, n - 1)))
    donors = base.select(F.col("_id").alias("_donor"), F.col("x").alias("_other"))
    swapped = copies.withColumn("_donor", (F.col("_id") + shift) % F.lit(max(1, n))).join(donors, "_donor")
    swapped = swapped.withColumn("_new", F.element_at("_other", F.col("i") + 1))
    changed = F.transform("x", lambda v, j: F.when(j == F.col("i"), F.col("_new")).otherwise(v))
    vectors = swapped.select("i", "repeat", label, array_to_vector(changed).alias("features"))
    after = scored(model, vectors, "classification", "prob")
    areas = curve_areas(roc_points(after, "prob", label, ["i", "repeat"]), ["i", "repeat"])
    before = scored(model, base.select(label, array_to_vector("x").alias("features")), "classification", "prob")
    whole = curve_areas(roc_points(before, "prob", label)).select("auc_roc").scalar()
    table = df.sparkSession.createDataFrame([(i, names[i]) for i in keep], "i int, feature string")
    mean = areas.groupBy("i").agg(F.avg("auc_roc").alias("_a")).join(F.broadcast(table), "i")
    return mean.select("feature", (whole - F.col("_a")).alias("importance"))
