"""Selection-round counts: enrichment, position profiles, fold changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import AMINO_ACIDS
from ..functions.text import number_or_zero
from ..session import cut_lineage
from .ordered import join_small

FIRST_POSITION = 105
TINY = 1e-10


def enrichment_labels(df: DataFrame, before: str = "macs", after: str = "facs1", min_count: float = 5,
                      min_fold: float = 1.5) -> DataFrame:
    """Frequencies, fold change, positive flag and training mask per clone."""
    clean = df.withColumns({c: number_or_zero(F.col(c)) for c in (before, after)})
    totals = clean.agg(F.sum(before).alias("_tb"), F.sum(after).alias("_ta"))
    wide = join_small(clean, totals, [])
    share = lambda c, t: F.when(F.col(t) > 0, F.col(c) / F.col(t)).otherwise(F.lit(0.0))
    out = wide.withColumns({"freq_before": share(before, "_tb"), "freq_after": share(after, "_ta")})
    rich = (F.col(after) > min_count) & (F.col("freq_after") >= F.col("freq_before") * min_fold)
    train = (F.col(before) > 0) | (F.col(after) > 0)
    out = out.withColumns({
        "fold_change": F.col("freq_after") / (F.col("freq_before") + 1e-8),
        "positive": rich.cast("int"), "train": train,
    })
    return out.drop("_tb", "_ta")


def counts_per_million(df: DataFrame, count: str, name: str = "cpm") -> DataFrame:
    total = df.agg(F.sum(count).alias("t")).scalar()
    return df.withColumn(name, F.try_divide(F.col(count) * 1e6, total))


def fold_change_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """log10 fold change of enriched-at-all clones in equal bins over their range."""
    logs = df.where("fold_change > 0").select(F.log10(F.col("fold_change") + 1e-8).alias("v"))
    span = logs.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    wide = join_small(logs, span, [])
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))
    return wide.groupBy(F.coalesce(place, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def position_counts(df: DataFrame, seq: str, by: list[str] | None = None) -> DataFrame:
    """Residue counts per position with the share among known residues there."""
    by = list(by or [])
    rows = df.where(F.col(seq).isNotNull()).select(*by, F.posexplode(F.split(F.trim(seq), "")).alias("pos", "aa"))
    rows = rows.where((F.length("aa") == 1) & (F.position("aa", F.lit(AMINO_ACIDS)) > 0))
    counts = rows.groupBy(*by, "pos", "aa").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by, "pos"))  # at most 20 rows each
    return counts.select(*by, "pos", "aa", "n", (F.col("n") / total).alias("prob"))


# Groups of clones whose position profiles are compared.
def profile_groups(score: Column, before: str = "macs", after: str = "facs1") -> Column:
    """Array of group names a clone belongs to."""
    enriched = (F.col(after) > 5) & (F.col("freq_after") >= F.col("freq_before") * 1.5)
    return F.array_compact(F.array(
        F.when(F.col(before) > 0, "baseline"), F.when(enriched, "positive"), F.when(score > 0.8, "high"),
    ))


def _profiles(df: DataFrame, seq: str, score: str, before: str, after: str) -> DataFrame:
    grouped = df.select(F.col(seq), F.explode(profile_groups(F.col(score), before, after)).alias("group"))
    return position_counts(grouped, seq, ["group"])


def position_entropy(df: DataFrame, seq: str, score: str, before: str = "macs", after: str = "facs1") -> DataFrame:
    """Entropy (bits) and most frequent residue per group and numbered position."""
    return _entropy(_profiles(df, seq, score, before, after))


def _entropy(stats: DataFrame) -> DataFrame:
    top = F.max(F.struct(F.col("n"), -F.position("aa", F.lit(AMINO_ACIDS)), F.col("aa")))
    return stats.groupBy("group", (F.col("pos") + FIRST_POSITION).alias("position")).agg(
        (-F.sum(F.col("prob") * F.log2("prob"))).alias("entropy"), top["aa"].alias("top_aa"),
        (F.max("n") / F.sum("n")).alias("top_share"),
    )


def position_divergence(df: DataFrame, seq: str, score: str, before: str = "macs", after: str = "facs1") -> DataFrame:
    """Per position and residue: contribution to KL(high || baseline).

    Zero shares become 1e-10 without renormalising, on all 20 residues.
    """
    return _divergence(_profiles(df, seq, score, before, after))


def _divergence(stats: DataFrame) -> DataFrame:
    shares = stats.groupBy("pos", "aa").agg(
        F.max(F.when(F.col("group") == "high", F.col("prob"))).alias("p"),
        F.max(F.when(F.col("group") == "baseline", F.col("prob"))).alias("q"),
    )
    grid = shares.select("pos").distinct().withColumn("aa", F.explode(F.array(*[F.lit(x) for x in AMINO_ACIDS])))
    full = grid.join(shares, ["pos", "aa"], "left")
    floor = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) > 0, F.col(c)).otherwise(F.lit(TINY))
    p, q = floor("p"), floor("q")
    return full.select((F.col("pos") + FIRST_POSITION).alias("position"), "aa", (p * F.log2(p / q)).alias("contribution"))


def position_stats(df: DataFrame, seq: str, score: str, before: str = "macs", after: str = "facs1") -> DataFrame:
    """One row per position: entropies, KL divergence and entropy drop."""
    stats = cut_lineage(_profiles(df, seq, score, before, after))  # groups x positions x 20 rows
    entropy = _entropy(stats).groupBy("position").pivot(
        "group", ["baseline", "positive", "high"]
    ).agg(F.first("entropy"))
    kl = _divergence(stats).groupBy("position").agg(F.sum("contribution").alias("kl"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return entropy.join(kl, "position").select(
        "position", zero("baseline").alias("entropy_baseline"), zero("positive").alias("entropy_positive"),
        zero("high").alias("entropy_high"), "kl", (zero("baseline") - zero("high")).alias("entropy_delta"),
    )
