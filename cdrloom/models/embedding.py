"""Sequence embeddings from a user-supplied batch function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.text import null_like_to_empty, paired_text
from ..functions.vectors import average_chains

MODES = ("VHVL", "VH")


def hashed_kmer_model(dim: int) -> Callable:
    """Deterministic stand-in for a language model: signed k-mer hashing."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        import zlib

        def embed(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for row, text in enumerate(texts):
                flat = str(text).replace(" ", "")
                for i in range(len(flat) - 2):
                    h = zlib.crc32(flat[i:i + 3].encode())
                    out[row, h % dim] += 1.0 if h & 1 << 20 else -1.0
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm > 0, norm, 1)

        return embed

    return make


def batch_embedder(make_model: Callable, dim: int, batch_size: int = 64) -> Callable[[Column], Column]:
    """Arrow-batched embedding of a text column; a failing batch gives zeros."""

    def make():
        embed = make_model()

        def safe(texts: np.ndarray) -> np.ndarray:
            try:
                return np.asarray(embed(texts), dtype=np.float32)
            except Exception:  # one bad batch must not stop the job
                return np.zeros((len(texts), dim), dtype=np.float32)

        return safe

    return predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch_size)


def embed_sequences(df: DataFrame, make_model: Callable, dim: int, lm: str, mode: str = "VHVL", style: str = "double_cls",
                    average: bool = False, existing: DataFrame | None = None, key: str = "barcode",
                    batch_size: int = 64) -> DataFrame:
    """(key, lm, embedding) for the rows that have none yet.

    ``average`` embeds the chains apart and takes their mean (heavy chain only
    where the light one is empty); else a pair is one text.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    todo = df if existing is None else df.join(existing.where(F.col("lm") == lm).select(key), key, "left_anti")
    heavy, light = null_like_to_empty(F.col("hseq")), null_like_to_empty(F.col("lseq"))
    embed = batch_embedder(make_model, dim, batch_size)
    if mode == "VH":
        vector = embed(heavy)
    elif average:
        second = F.when(light != "", embed(light))
        vector = average_chains(embed(heavy), second)
    else:
        vector = embed(F.when(light != "", paired_text(heavy, light, style)).otherwise(heavy))
    return todo.select(key, F.lit(lm).alias("lm"), vector.cast("array<float>").alias("embedding"))
