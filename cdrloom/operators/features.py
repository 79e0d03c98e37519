"""Feature tables and vectors: k-mers, one-hot, standardising, PCA, builder."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import CountVectorizerModel, Normalizer, PCA, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import AMINO_ACIDS, BLOSUM62, triangle
from ..functions.sequence import biophysical_feature, feature_text, neighbour_sum
from ..functions.vectors import kmer_tokens, kmer_vocabulary, one_hot_names, one_hot_tokens, windows
from .ordered import join_small

UNKNOWN = "<other>"


# --- long forms -----------------------------------------------------------

def _counted(tokens: Column) -> Column:
    """(token, n) of an array column without a shuffle: counts inside the row."""
    return F.transform(
        F.array_distinct(tokens),
        lambda t: F.struct(t.alias("kmer"), F.size(F.filter(tokens, lambda x: x == t)).alias("n")),
    )


def kmer_table(df: DataFrame, key: str, seq: Column, k_list: list[int], normalize: bool = True) -> DataFrame:
    """Long (key, k, kmer, value); shares are over all windows of one k.

    Windows with unknown letters stay in the denominator but give no row.
    """
    base = df.select(key, feature_text(seq).alias("_t"))
    per_k = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), windows(F.col("_t"), k).alias("w")) for k in k_list]))
    rows = base.select(key, per_k.alias("p")).select(key, "p.k", "p.w").withColumn("total", F.size("w"))
    # the outer form keeps the optimizer from filtering on (and so recomputing) the array
    rows = rows.select(key, "k", "total", F.explode_outer(_counted(F.col("w"))).alias("c"))
    known = F.length(F.translate("c.kmer", AMINO_ACIDS, "")) == 0
    value = F.col("c.n") / F.col("total") if normalize else F.col("c.n").cast("double")
    return rows.where(known).select(key, "k", F.col("c.kmer").alias("kmer"), value.alias("value"))


def kmer_l2_table(df: DataFrame, key: str, cdr3: str) -> DataFrame:
    """Long (key, kmer, value) of 1/2/3-mers of C+loop+W, unit length per row."""
    loop = F.coalesce(F.col(cdr3), F.lit(""))
    letters = F.regexp_replace(F.concat(F.lit("C"), loop, F.lit("W")), f"[^{AMINO_ACIDS}]", "")
    base = df.where(F.length(loop) >= 4).select(key, kmer_tokens(letters, [1, 2, 3]).alias("_w"))
    rows = base.select(key, _counted(F.col("_w")).alias("c"))
    square = F.aggregate("c", F.lit(0.0), lambda acc, t: acc + t["n"] * t["n"])
    # the outer form keeps the optimizer from filtering on (and so recomputing) the array
    opened = rows.select(key, F.sqrt(square).alias("norm"), F.explode_outer("c").alias("t")).where("t is not null")
    return opened.select(key, F.col("t.kmer").alias("kmer"), (F.col("t.n") / F.col("norm")).alias("value"))


def one_hot_table(df: DataFrame, key: str, seq: Column, max_len: int) -> DataFrame:
    """Long (key, pos, aa) of the known residues within ``max_len``."""
    text = F.substring(feature_text(seq), 1, max_len)
    rows = df.select(key, F.posexplode(windows(text, 1)).alias("_i", "aa"))
    return rows.where(F.position("aa", F.lit(AMINO_ACIDS)) > 0).select(key, (F.col("_i") + 1).alias("pos"), "aa")


def max_lengths(df: DataFrame, columns: dict[str, str], caps: dict[str, int] | None = None) -> DataFrame:
    """Largest length per named column; a positive cap replaces it."""
    caps = caps or {}
    return df.agg(*[
        (F.lit(caps[name]) if caps.get(name, 0) > 0 else F.max(F.length(F.coalesce(F.col(c), F.lit(""))))).alias(name)
        for name, c in columns.items()
    ])


def truncated_counts(df: DataFrame, columns: dict[str, str], fitted: dict[str, int]) -> DataFrame:
    """Rows longer than the fitted length, per named column."""
    return df.agg(*[F.count_if(F.length(F.col(c)) > fitted[name]).alias(name) for name, c in columns.items()])


# --- vectors --------------------------------------------------------------

def _sparse(df: DataFrame, tokens: Column, vocabulary: list[str], name: str, binary: bool = False) -> DataFrame:
    """Token array to a sparse count vector in vocabulary order."""
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_tok", outputCol=name)
    model = model.setBinary(binary).setMinTF(0.0)
    return model.transform(df.withColumn("_tok", tokens)).drop("_tok")


def _without_last(df: DataFrame, name: str, size: int) -> DataFrame:
    slicer = VectorSlicer(inputCol="_full", outputCol=name, indices=list(range(size)))
    return slicer.transform(df.withColumnRenamed(name, "_full")).drop("_full")


def kmer_vectors(df: DataFrame, seq: Column, k_list: list[int], name: str, normalize: bool = True) -> DataFrame:
    """Sparse k-mer shares, one block per k; unknown windows only dilute."""
    blocks = []
    text = feature_text(seq)
    for k in k_list:
        vocabulary = kmer_vocabulary([k]) + [UNKNOWN]
        known = lambda w: F.when(F.length(F.translate(w, AMINO_ACIDS, "")) == 0, w).otherwise(F.lit(UNKNOWN))
        df = _sparse(df, F.transform(windows(text, k), known), vocabulary, f"_{name}{k}")
        if normalize:
            df = Normalizer(p=1.0, inputCol=f"_{name}{k}", outputCol="_share").transform(df)
            df = df.drop(f"_{name}{k}").withColumnRenamed("_share", f"_{name}{k}")
        df = _without_last(df, f"_{name}{k}", len(vocabulary) - 1)
        blocks.append(f"_{name}{k}")
    return VectorAssembler(inputCols=blocks, outputCol=name).transform(df).drop(*blocks)


def kmer_l2_vectors(df: DataFrame, cdr3: str, name: str, use_blosum: bool = False) -> DataFrame:
    """Unit-length 8,420-dim k-mer vector, optionally with residue shares and BLOSUM62."""
    loop = F.coalesce(F.col(cdr3), F.lit(""))
    letters = F.regexp_replace(F.concat(F.lit("C"), loop, F.lit("W")), f"[^{AMINO_ACIDS}]", "")
    df = df.withColumn("_s", F.when(F.length(loop) >= 4, letters).otherwise(F.lit("")))
    counts = _sparse(df, kmer_tokens(F.col("_s"), [1, 2, 3]), kmer_vocabulary([1, 2, 3]), "_k")
    unit = Normalizer(p=2.0, inputCol="_k", outputCol=name if not use_blosum else "_ku").transform(counts).drop("_k")
    if not use_blosum:
        return unit.drop("_s")
    singles = _sparse(unit, windows(F.col("_s"), 1), list(AMINO_ACIDS), "_a")
    singles = Normalizer(p=2.0, inputCol="_a", outputCol="_au").transform(singles)
    pairs = F.length("_s") - 1
    mean = F.when(pairs >= 1, neighbour_sum(F.col("_s"), triangle(BLOSUM62), -4) / pairs).otherwise(F.lit(0.0))
    wide = singles.withColumn("_b", mean)
    wide = VectorAssembler(inputCols=["_ku", "_au", "_b"], outputCol="_all").transform(wide)
    return Normalizer(p=2.0, inputCol="_all", outputCol=name).transform(wide).drop("_s", "_ku", "_a", "_au", "_b", "_all")


def one_hot_vectors(df: DataFrame, segments: list[tuple[Column, int, str]], name: str) -> DataFrame:
    """Sparse one-hot of one or more (sequence, length, prefix) segments."""
    tokens = F.flatten(F.array(*[one_hot_tokens(seq, n, prefix) for seq, n, prefix in segments]))
    names = [x for _, n, prefix in segments for x in one_hot_names(prefix, n)]
    return _sparse(df, tokens, names, name, binary=True)


def two_branch_vectors(df: DataFrame, heavy: str = "hseq", light: str = "lseq", cdr3: str = "cdr3",
                       heavy_len: int = 135, light_len: int = 135, cdr3_len: int = 25, heavy_only: bool = False) -> DataFrame:
    """Whole-chain branch and loop branch of the one-hot models."""
    chain = [(F.col(heavy), heavy_len, "oh_vh")]
    if not heavy_only:
        chain.append((F.col(light), light_len, "oh_vl"))
    out = one_hot_vectors(df, chain, "chain_features")
    return one_hot_vectors(out, [(F.col(cdr3), cdr3_len, "oh_hcdr3")], "cdr3_features")


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """z-scores with population spread; a constant column is only centred."""
    stats = df.agg(*[f(F.col(c)).alias(f"_{n}{i}") for i, c in enumerate(cols)
                     for n, f in (("m", F.avg), ("d", F.stddev_pop))])
    wide = join_small(df, stats, [])
    spread = lambda i: F.when(F.col(f"_d{i}") > 0, F.col(f"_d{i}")).otherwise(F.lit(1.0))
    z = {c: (F.col(c) - F.col(f"_m{i}")) / spread(i) for i, c in enumerate(cols)}
    return wide.select(*[z[c].alias(c) if c in z else F.col(c) for c in df.columns])


def standardize_vectors(df: DataFrame, vec: str, key: str) -> DataFrame:
    """z-scored array column (population spread) via one aggregate per dimension."""
    long = df.select(key, F.posexplode(vec).alias("d", "x"))
    stats = long.groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    ordered = stats.agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m", "s"))),
                                    lambda t: F.struct(t["m"].alias("m"), t["s"].alias("s"))).alias("_stats"))
    unit = lambda x, t: (x - t["m"]) / F.when(t["s"] > 0, t["s"]).otherwise(F.lit(1.0))
    wide = join_small(df, ordered, [])
    return wide.withColumn(vec, F.zip_with(F.col(vec), F.col("_stats"), unit)).drop("_stats")


def pca_scores(df: DataFrame, vec: str, key: str, k: int | None = None) -> DataFrame:
    """Principal component scores of standardised vectors, at most 50 components."""
    row = df.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d")).first()
    size = min(k or 50, row["d"], row["n"] - 1)
    scaled = standardize_vectors(df, vec, key).withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    fitted = PCA(k=size, inputCol="_v", outputCol="_pc").fit(scaled)
    return fitted.transform(scaled).select(*[c for c in df.columns if c != vec], vector_to_array("_pc").alias("components"))


@dataclass(frozen=True)
class FeatureConfig:
    """Which blocks a model sees, in fixed order: embedding, k-mer, biophysical, one-hot."""

    embedding: bool = False
    kmer: bool = False
    biophysical: bool = True
    onehot: bool = False
    kmer_sequence: str = "CDR3"
    kmer_k: tuple[int, ...] = (1, 2)
    kmer_normalize: bool = True
    features: tuple[str, ...] = ("length", "pi", "charge_ph7", "hydrophobicity", "R", "D", "W")
    onehot_sequence: str = "HCDR3"
    max_lengths: dict = field(default_factory=dict)

    def __post_init__(self):
        if not (self.embedding or self.kmer or self.biophysical or self.onehot):
            raise ValueError("enable at least one feature block")
        if self.kmer_sequence not in ("CDR3", "VH", "VHVL"):
            raise ValueError(f"unknown k-mer sequence: {self.kmer_sequence}")
        if self.onehot_sequence not in ("HCDR3", "VH", "VHVL"):
            raise ValueError(f"unknown one-hot sequence: {self.onehot_sequence}")

    @property
    def learns(self) -> bool:
        """Do vectors depend on the rows that the builder was fitted on?"""
        return self.embedding or self.onehot


class FeatureBuilder:
    """Fits lengths and dimensions on one table, builds vectors on any other."""

    SEGMENTS = {"HCDR3": [("cdr3", "oh_hcdr3")], "VH": [("hseq", "oh_vh")],
                "VHVL": [("hseq", "oh_vh"), ("lseq", "oh_vl")]}

    def __init__(self, config: FeatureConfig, embedding_col: str = "embedding"):
        self.config = config
        self.embedding_col = embedding_col
        self.lengths: dict[str, int] = {}
        self.feature_names: list[str] = []

    def fit(self, df: DataFrame) -> "FeatureBuilder":
        cfg, names = self.config, []
        sizes = []
        if cfg.embedding:
            if self.embedding_col not in df.columns:
                raise ValueError("the embedding block needs an embedding column")
            sizes.append(F.max(F.size(self.embedding_col)).alias("_emb"))
        segments = self.SEGMENTS[cfg.onehot_sequence] if cfg.onehot else []
        sizes += [F.max(F.length(F.coalesce(F.col(c), F.lit("")))).alias(c) for c, _ in segments]
        row = df.agg(*sizes).first().asDict() if sizes else {}
        if cfg.embedding:
            names += [f"emb_{i}" for i in range(row["_emb"])]
        if cfg.kmer:
            names += [f"{len(w)}mer_{w}" for w in kmer_vocabulary(list(cfg.kmer_k))]
        if cfg.biophysical:
            names += [self._property_name(f) for f in cfg.features]
        for column, prefix in segments:
            cap = cfg.max_lengths.get({"hseq": "vh", "lseq": "vl", "cdr3": "hcdr3"}[column], 0)
            self.lengths[column] = cap if cap > 0 else row[column]
            names += one_hot_names(prefix, self.lengths[column])
        self.feature_names = names
        return self

    @staticmethod
    def _property_name(feature: str) -> str:
        short = feature.replace("count_", "").replace("_ph7", "")
        return short if short.startswith(("vh_", "cdr3_")) else f"cdr3_{short}"

    @property
    def interpretable(self) -> list[int]:
        """Indices of everything but embedding dimensions."""
        return [i for i, n in enumerate(self.feature_names) if not n.startswith("emb_")]

    def transform(self, df: DataFrame, name: str = "features") -> DataFrame:
        cfg, blocks, out = self.config, [], df
        if cfg.embedding:
            out = out.withColumn("_e", array_to_vector(F.transform(self.embedding_col, lambda x: x.cast("double"))))
            blocks.append("_e")
        if cfg.kmer:
            text = lambda c: F.coalesce(F.col(c), F.lit(""))
            source = {"CDR3": lambda: text("cdr3"), "VH": lambda: text("hseq"),
                      "VHVL": lambda: F.concat(text("hseq"), text("lseq"))}[cfg.kmer_sequence]()
            out = kmer_vectors(out, source, list(cfg.kmer_k), "_kmer", cfg.kmer_normalize)
            blocks.append("_kmer")
        if cfg.biophysical:
            # texts are columns of their own: features refer to them dozens of times
            sources = {"_bp_loop": "cdr3"} | ({"_bp_vh": "hseq"} if any(f.startswith("vh_") for f in cfg.features) else {})
            out = out.withColumns({name: feature_text(F.col(c)) for name, c in sources.items()})
            cols = {f"_bp{i}": biophysical_feature(f, F.col("_bp_loop"), F.col("_bp_vh"), cleaned=True) for i, f in enumerate(cfg.features)}
            out = out.withColumns(cols).drop(*sources)
            blocks += list(cols)
        if cfg.onehot:
            segments = [(F.col(c), self.lengths[c], p) for c, p in self.SEGMENTS[cfg.onehot_sequence]]
            out = one_hot_vectors(out, segments, "_oh")
            blocks.append("_oh")
        return VectorAssembler(inputCols=blocks, outputCol=name).transform(out).drop(*blocks)
