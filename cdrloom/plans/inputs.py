"""Antibody-shaped inputs derived from the given tables, in Spark and in SQL.

Every document is read whole: its amino-acid letters are cut into consecutive
pieces of 231, the last piece keeps the remainder, and each piece becomes one
antibody (heavy chain with a planted loop, light chain).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LETTERS = "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table to all cores in a local session, whose files hold one split; a cluster reads its splits as they are."""
    context = df.sparkSession.sparkContext
    return df.repartition(context.defaultParallelism, key) if context.master.startswith("local[") else df


def antibodies(spark: SparkSession, sf: str) -> DataFrame:
    aa = F.upper(F.regexp_replace("text", LETTERS, ""))
    pieces = F.regexp_extract_all(aa, F.lit("([A-Z]{231}(?:[A-Z]{0,230}$)?|^[A-Z]{1,230}$)"), F.lit(1))
    documents = spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    cut = documents.select("doc_id", "lang", "source", F.posexplode_outer(pieces).alias("tile", "b")).where(
        "b is not null"
    )
    n = (8 + (F.col("doc_id") + F.col("tile")) % 9).cast("int")
    b = F.col("b")
    loop = F.substring(b, F.lit(97), n)
    heavy = F.concat(F.substring(b, 1, 96), F.lit("C"), loop, F.lit("WGQG"), F.substring(b, 97 + n, 27 - n))
    blank = (F.col("doc_id") + F.col("tile")) % 10 == 0
    return cut.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("tile").cast("string")).alias("barcode"),
        "doc_id", "tile", (F.col("doc_id") * (1 << 32) + F.col("tile")).alias("row_id"),
        F.col("source").alias("antigen"), F.col("lang").alias("germline"),
        heavy.alias("hseq"), F.substring(b, F.lit(124), F.length(b)).alias("lseq"),
        F.when(blank, F.lit("")).otherwise(loop).alias("cdr3"),
    )


ANTIBODIES_SQL = """
letters AS (
  SELECT doc_id, lang, source,
         upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) AS aa
  FROM documents),
tiles AS (
  SELECT doc_id, lang, source, aa, greatest(1, length(aa) // 231) AS nt,
         unnest(range(0, greatest(1, length(aa) // 231))) AS tile
  FROM letters WHERE length(aa) > 0),
pieces AS (
  SELECT doc_id, lang, source, tile, 8 + (doc_id + tile) % 9 AS n,
         CASE WHEN tile < nt - 1 THEN substr(aa, tile * 231 + 1, 231) ELSE substr(aa, tile * 231 + 1) END AS b
  FROM tiles),
ab AS (
  SELECT doc_id || '-' || tile AS barcode, doc_id, tile, doc_id * 4294967296 + tile AS row_id,
         source AS antigen, lang AS germline,
         substr(b, 1, 96) || 'C' || substr(b, 97, n) || 'WGQG' || substr(b, 97 + n, 27 - n) AS hseq,
         substr(b, 124) AS lseq,
         CASE WHEN (doc_id + tile) % 10 = 0 THEN '' ELSE substr(b, 97, n) END AS cdr3
  FROM pieces)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Antibodies with quality (1 = pass), toxic and a score with many ties."""
    ab, labels = antibodies(spark, sf), table(spark, sf, "labels")
    wave = (F.col("doc_id") * 37 + F.col("tile") * 11) % 100
    return ab.join(labels, "doc_id").withColumns({
        "score": F.col("quality") * 0.5 + wave / 200.0, "fold": (F.col("doc_id") % 5).cast("int"),
    })


LABELLED_SQL = ANTIBODIES_SQL + """,
lab AS (
  SELECT ab.*, quality, toxic, quality * 0.5 + ((doc_id * 37 + tile * 11) % 100) / 200.0 AS score,
         CAST(doc_id % 5 AS INTEGER) AS fold
  FROM ab JOIN labels USING (doc_id))"""


def assays(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled antibodies with four assay columns, some of them missing."""
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_acctbal") / 10000).alias("psr_norm_insulin"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_retailprice") / 1000).alias("psr_norm_dna"))
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("psr_norm_smp"))
    wave = (F.col("doc_id") * 13 + F.col("tile") * 7) % 50
    base = labelled(spark, sf).join(customer, "doc_id", "left").join(part, "doc_id", "left").join(docs, "doc_id")
    return base.withColumns({
        "psr_norm_avidin": F.when(wave > 4, wave / 25.0), "psr_filter": F.col("quality"), "psr_rf_elisa": F.col("toxic"),
        "id2": F.col("doc_id") + 8500,
    })


ASSAYS_SQL = LABELLED_SQL + """,
assay AS (
  SELECT lab.*, c_acctbal / 10000 AS psr_norm_insulin, p_retailprice / 1000 AS psr_norm_dna,
         n_chars / 1000.0 AS psr_norm_smp,
         CASE WHEN (doc_id * 13 + tile * 7) % 50 > 4 THEN ((doc_id * 13 + tile * 7) % 50) / 25.0 END AS psr_norm_avidin,
         quality AS psr_filter, toxic AS psr_rf_elisa, doc_id + 8500 AS id2
  FROM lab LEFT JOIN customer ON c_custkey = doc_id LEFT JOIN part ON p_partkey = doc_id
  JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id))"""


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """One vector per document, keyed like the first piece of that document."""
    return table(spark, sf, "embeddings").select(
        F.concat_ws("-", F.col("vec_id").cast("string"), F.lit("0")).alias("barcode"), "embedding"
    )


EMBEDDINGS_SQL = "emb AS (SELECT vec_id || '-0' AS barcode, embedding FROM embeddings)"


def clones(spark: SparkSession, sf: str) -> DataFrame:
    """Selection counts of the non-empty loops before and after a round."""
    counts = table(spark, sf, "lineitem").groupBy(
        F.col("l_partkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("slot")
    ).agg(
        F.count_if(F.col("l_returnflag") == "N").alias("macs"),
        (10 * F.count_if((F.col("l_returnflag") == "A") & (F.col("l_discount") < 0.06))).alias("facs1"),
    )
    ab = antibodies(spark, sf).where("cdr3 <> ''").withColumn("slot", F.col("tile") % 7)
    return ab.join(counts, ["doc_id", "slot"]).select(
        "barcode", "row_id", "doc_id", "tile", "germline", "cdr3", "macs", "facs1",
        (((F.col("doc_id") * 37 + F.col("tile") * 11) % 100) / 100.0).alias("score"),
    )


CLONES_SQL = ANTIBODIES_SQL + """,
clones AS (
  SELECT barcode, row_id, doc_id, tile, germline, cdr3, macs, facs1, ((doc_id * 37 + tile * 11) % 100) / 100.0 AS score
  FROM ab JOIN (
    SELECT l_partkey, l_linenumber - 1 AS slot, count(*) FILTER (l_returnflag = 'N') AS macs,
           10 * count(*) FILTER (l_returnflag = 'A' AND l_discount < 0.06) AS facs1
    FROM lineitem GROUP BY 1, 2) ON doc_id = l_partkey AND tile % 7 = slot
  WHERE cdr3 <> '')"""


def previous(spark: SparkSession, sf: str) -> DataFrame:
    """Loops known already: those of the labelled, failing antibodies."""
    return labelled(spark, sf).where("quality = 0 and cdr3 <> ''").select("cdr3").distinct()


PREVIOUS_SQL = "prev AS (SELECT DISTINCT cdr3 FROM lab WHERE quality = 0 AND cdr3 <> '')"


def curve(spark: SparkSession, sf: str) -> DataFrame:
    """A learning curve with one row per order month."""
    monthly = table(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(
        F.count("*").alias("n"), F.avg("o_totalprice").alias("price"), F.max("o_totalprice").alias("top"),
    )
    from pyspark.sql import Window

    w = Window.orderBy("m")  # one row per month
    return monthly.select(
        F.sum("n").over(w).alias("sample_size"), (F.col("price") / 500000).alias("auc"),
        (F.col("top") / 1000000).alias("accuracy"), (F.col("n") / 1000.0).alias("recall"),
    )


CURVE_SQL = """
curve AS (
  SELECT sum(n) OVER (ORDER BY m) AS sample_size, price / 500000 AS auc, top / 1000000 AS accuracy, n / 1000.0 AS recall
  FROM (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n, avg(o_totalprice) AS price, max(o_totalprice) AS top
        FROM orders GROUP BY 1))"""


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)
