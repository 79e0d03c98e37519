"""Bounded samples of labelled documents, for models that are fitted in the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


#: Texts above this share of the byte bound are long, unless a size is given.
LONG = 1 / 64


def whole_texts(places: np.ndarray, sizes: np.ndarray, room: int, long: int) -> np.ndarray:
    """Flags of the texts to take, in the order of ``places``, within ``room`` bytes.

    A text that does not fit in what is left is passed over, those behind it
    are not. Texts of more than ``long`` bytes first get half of the room, and
    at the end what the others have left.
    """
    taken = np.zeros(len(sizes), bool)
    order = np.argsort(places, kind="stable")
    big = sizes[order] > long
    for some, bound in ((order[big], room // 2), (order[~big], room), (order[big], room)):
        left = bound - int(sizes[taken].sum())
        for i in some:
            if not taken[i] and sizes[i] <= left:
                taken[i] = True
                left -= int(sizes[i])
    return taken


def held_back(labels: np.ndarray) -> np.ndarray:
    """Flags of every fifth row of each class, for calibration: the first four of a class are always learned."""
    held = np.zeros(len(labels), bool)
    for label in (0, 1):
        held[np.flatnonzero(labels == label)[4::5]] = True
    return held


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, rows: int, text_bytes: int | tuple[int, int], where: Column | None = None,
    long_bytes: int | None = None, id_column: str = "doc_id", text_column: str = "text",
) -> pd.DataFrame:
    """At most ``rows`` labelled rows per class in an order fixed by id, and at most ``text_bytes`` of text per class (one bound, or
    one for label 0 and one for label 1).

    Columns id, text, label (0 or 1). Rows without label, id or text are left
    out. ``where`` may restrict the rows by the column ``id``. Whole texts of
    every length, see ``whole_texts`` (long: more than ``long_bytes``, or else
    the share ``LONG`` of the bound): a text that does not fit is left out alone. An id counts once, with the text of
    the least digest if it has several. It is an error if there are labelled texts of both classes but the sample has none
    of one.
    """
    marks = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    marks = marks.where("id is not null and label in (0, 1)")
    marks = (marks if where is None else marks.where(where)).groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.col("id").cast("string"))
    # a share of the hash range that holds enough rows of each class, so that the window sees about ``rows`` of them
    share = (F.lit(rows) + 8 * F.sqrt(F.lit(rows)) + 50) / F.count("*")
    shares = {r["label"]: r["share"] for r in marks.groupBy("label").agg(share.alias("share")).collect()}
    least = F.when(F.col("label") == 0, F.lit(shares.get(0, 1.0))).otherwise(F.lit(shares.get(1, 1.0)))
    few = marks.where(order / float(1 << 64) + 0.5 <= least)
    chosen = few.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(order, "id"))).where(F.col("place") <= rows)
    texts = documents.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).where("text is not null")
    # the chosen ids are bounded by `rows`, so they can be sent to all tasks
    found = texts.join(F.broadcast(chosen), "id").withColumn("size", F.octet_length("text")).withColumn("digest", F.xxhash64("text"))
    # one text per chosen id, so the driver gets at most ``rows`` lines per class
    first = found.groupBy("id", "label", "place").agg(F.min(F.struct("digest", "size")).alias("first"))
    sizes = first.select("id", "label", "place", "first.digest", "first.size")
    kind = sizes.schema
    sizes = sizes.toPandas().sort_values(["label", "place", "digest"]).reset_index(drop=True)
    bounds = text_bytes if isinstance(text_bytes, tuple) else (text_bytes, text_bytes)
    taken = np.zeros(len(sizes), bool)
    for mark, most in enumerate(bounds):
        own = np.flatnonzero(sizes["label"] == mark)
        taken[own] = whole_texts(sizes["place"].to_numpy()[own], sizes["size"].to_numpy()[own], most, long_bytes or int(most * LONG))
    counts = np.bincount(sizes["label"][taken], minlength=2)
    if counts.min() == 0 and len(shares) == 2:
        with_text = marks.join(texts.select("id"), "id", "left_semi").groupBy("label").count().collect()
        if len(with_text) == 2:
            raise ValueError(f"labelled texts of both classes of {label} exist, but the sample of {rows} rows and {bounds} bytes has none of class {int(counts.argmin())}")
    fitting = documents.sparkSession.createDataFrame(sizes[taken], kind)
    parts = texts.join(F.broadcast(fitting), "id").where(F.xxhash64("text") == F.col("digest"))
    frame = parts.select("id", "text", "label", "place", "digest").distinct().toPandas()
    return frame.sort_values(["label", "place", "digest"]).drop(columns="digest").reset_index(drop=True)
