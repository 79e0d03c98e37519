"""Reading and writing antibody, embedding, score and benchmark tables."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import barcode_key
from ..operators.correlation import detect_score_columns, resolve_columns
from ..operators.ordered import with_sorted_ids

CORE = ("barcode", "hseq", "lseq")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV or Parquet by suffix; anything else is an error."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.csv(path)
    if suffix in (".parquet", ""):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def read_antibodies(spark: SparkSession, path: str, target: str | None = None, schema: str | None = None,
                    need_cdr3: bool = False) -> DataFrame:
    """Antibody table with lower-case core columns; missing ones are an error."""
    df = read_table(spark, path, schema)
    core = {"barcode", "hseq", "lseq", "cdr3"}
    df = df.select(*[F.col(f"`{c}`").alias(c.lower() if c.lower() in core else c) for c in df.columns])
    required = [*CORE, *(["cdr3"] if need_cdr3 else []), *([target] if target else [])]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def read_embeddings(spark: SparkSession, path: str, lm: str, key: str = "BARCODE") -> DataFrame:
    """Wide CSV (key, 0..d-1) as (barcode, lm, embedding array)."""
    df = spark.read.option("header", True).csv(path)
    dims = [c for c in df.columns if c != key]
    vector = F.array(*[F.col(f"`{c}`").cast("float") for c in dims])
    return df.select(barcode_key(F.col(key)).alias("barcode"), F.lit(lm).alias("lm"), vector.alias("embedding"))


def lm_tag(file_name: Column) -> Column:
    """Model tag of ``{db}.{lm}.emb.csv``."""
    return F.regexp_extract(file_name, r"\.([^./]+)\.emb\.csv(?:/[^/]*)?$", 1)


def discover_embeddings(spark: SparkSession, folder: str, db: str) -> DataFrame:
    """(path, lm) of every embedding file, or folder of part files, of a database."""
    files = spark.read.format("binaryFile").load(f"{folder}/{db}.*.emb.csv").select("path", lm_tag(F.col("path")).alias("lm"))
    return files.select(F.regexp_extract("path", r"^(.*\.emb\.csv)", 1).alias("path"), "lm").distinct()


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """CSV (with header) or Parquet by suffix."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    elif path.endswith(".parquet") or "." not in os.path.basename(path):
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported file type: {path}")


MANIFEST = "file string, status string, rows long, corrupt long, missing array<string>"
_CORRUPT = "_corrupt_record"


def _with_origin(spark: SparkSession, path: str) -> DataFrame:
    """Table with ``_file`` and, of CSV rows that do not fit the header, ``_corrupt_record``."""
    df = read_table(spark, path)
    if not path.rstrip("/").lower().endswith(".csv"):
        return df.select("*", F.col("_metadata.file_path").alias("_file"), F.lit(None).cast("string").alias(_CORRUPT))
    schema = ", ".join(f"`{c}` string" for c in df.columns) + f", `{_CORRUPT}` string"
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
    return reader.schema(schema).csv(path).select("*", F.col("_metadata.file_path").alias("_file"))


def read_with_manifest(spark: SparkSession, paths: list[str], columns: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """Rows (``columns`` as strings) of all files that can be read, and the manifest: one row per input file.

    ``status``: read, unreadable, or missing columns; ``rows`` that were read,
    ``corrupt`` among them (kept, with what could be parsed), ``missing`` columns.
    Files are read through once here, so damage inside a file shows in the
    manifest and not in a later job.
    """
    parts, manifest = [], []
    for path in paths:
        try:
            df = _with_origin(spark, path)
            missing = [c for c in columns if c not in df.columns]
            seen = df.groupBy("_file").agg(F.count("*").alias("rows"), F.count_if(F.col(_CORRUPT).isNotNull()).alias("corrupt"))
            if not missing:  # damage may stand in the column itself
                seen = df.groupBy("_file").agg(
                    F.count("*").alias("rows"), F.count_if(F.col(_CORRUPT).isNotNull()).alias("corrupt"),
                    *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(columns)])
            files = [(r["_file"], r["rows"], r["corrupt"]) for r in seen.collect()]
        except Exception:  # whatever a reader makes of a file that is absent, damaged or no table
            manifest.append((path, "unreadable", None, None, None))
            continue
        status = "missing columns" if missing else "read"
        manifest += [(f, status, n, bad, missing) for f, n, bad in files or [(path, 0, 0)]]
        if not missing:
            parts.append(df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]))
    return reduce(DataFrame.unionByName, parts) if parts else None, spark.createDataFrame(manifest, MANIFEST)


def load_previous(spark: SparkSession, files: list[str], column: str = "cdr3") -> tuple[DataFrame, DataFrame]:
    """Distinct trimmed CDR3 of many files, and the manifest that tells which files were read, skipped and why."""
    rows, manifest = read_with_manifest(spark, files, [column])
    if rows is None:
        return spark.createDataFrame([], "cdr3 string"), manifest
    return rows.select(F.trim(F.col(column)).alias("cdr3")).na.drop().distinct(), manifest


def load_scored(df: DataFrame, assays: list[str], min_rows: int = 5) -> dict[str, DataFrame]:
    """Per detected score column: complete rows with the assays found by name.

    Scores with fewer than ``min_rows`` complete rows are left out.
    """
    here = resolve_columns(df, assays)
    scores = [c for c, _ in detect_score_columns(df)] if here else []
    if not scores:
        return {}
    others = lambda s: [a for a in here if a != s]
    complete = lambda s: reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [s, *others(s)]])
    counts = df.agg(*[F.count_if(complete(s)).alias(f"n{i}") for i, s in enumerate(scores)]).first()
    return {s: df.select(s, *others(s)).na.drop() for i, s in enumerate(scores) if counts[f"n{i}"] >= min_rows}


def write_evaluation(bundle: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Summary, threshold metrics and labelled predictions as three tables."""
    for name in ("summary", "metrics", "predictions"):
        bundle[name].write.mode(mode).parquet(f"{path}/{name}")


def write_fold_predictions(preds: DataFrame, path: str, mode: str = "errorifexists") -> None:
    preds.write.mode(mode).partitionBy("fold").parquet(path)


def forward_fill(df: DataFrame, column: str, order: str) -> DataFrame:
    """Last known value along ``order`` without a one-task window.

    Rows are numbered once; each row finds its source through the running
    maximum of numbered known rows, taken per partition with carried edges.
    """
    numbered = with_sorted_ids(df, [F.col(order)], "_id")
    rows = numbered.withColumn("_block", F.floor(F.col("_id") / 100_000))
    known = F.when(F.col(column).isNotNull(), F.col("_id"))
    from pyspark.sql import Window

    blocks = rows.groupBy("_block").agg(F.max(known).alias("_m"), F.max_by(column, known).alias("_v"))
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("_block", F.last("_v", ignorenulls=True).over(before).alias("_carry"))
    local = Window.partitionBy("_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.join(carried, "_block").withColumn(
        column, F.coalesce(F.last(column, ignorenulls=True).over(local), F.col("_carry"))
    )
    return filled.drop("_id", "_block", "_carry")


def load_benchmark_sheet(df: DataFrame, group: str, order: str, names: dict[str, str] | None = None) -> DataFrame:
    """Clean a sparse benchmark sheet: headers, filled groups, dropped blanks, names."""
    stripped = df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns])
    filled = forward_fill(stripped, group, order).na.drop(subset=["Language Model"])
    out = filled.withColumnsRenamed({"Language Model": "LM", "F1-Score": "F1"})
    if names:
        mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        out = out.withColumn("cond", F.try_element_at(mapping, F.col(group)))
    return out
