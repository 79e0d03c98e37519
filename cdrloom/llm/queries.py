"""Named queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, html_text, jaccard, lexical, negatives, neighbours, packing, quality, suffix_dedup, token_counts, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf, "documents"), passages=suffix_dedup.PASSAGE)


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return quality.score(documents, quality.fit(documents, table(spark, sf, "labels")))


@query("op3_nearest_neighbours")
def op3_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.search(table(spark, sf, "embeddings"), F.col("id") % 50 == 0)


@query("op4_html_text")
def op4_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


CONTROLS = ("[INST]", "[/INST]", " [/INST]", "[ANS]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[NAME]", "␛")


def signs_sql(column: str) -> str:
    """Escape signs that the template puts into a text: one for each control string that begins there."""
    return "(" + " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in CONTROLS) + ")"


CHAT_SQL = f"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS x FROM t),
o AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS last FROM s
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)),
e AS (SELECT *, length(text) + {signs_sql('text')} + CASE role WHEN 'user' THEN 18 WHEN 'system' THEN 15 WHEN 'assistant' THEN 10
  ELSE 19 + length(role) + {signs_sql('role')} END AS size,
  CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' ELSE false END AS allowed FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars, bool_and(allowed) AND bool_or(last AND role = 'assistant') AS valid
FROM e GROUP BY conv_id"""


@query("op5_chat_formatting", CHAT_SQL)
def op5_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    return chat.digests(turns.unionByName(extra))


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), bpe.default_path())


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), bpe.default_path())


JACCARD_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
k AS (SELECT a, count(*) AS n_links, min(b) FILTER (same) AS twin FROM l GROUP BY 1)
SELECT w.doc_id, min(root) AS class_id, coalesce(any_value(n_links), 0) AS n_links, least(w.doc_id, any_value(twin)) AS copy_id
FROM w JOIN r ON r.node = w.doc_id LEFT JOIN k ON k.a = w.doc_id GROUP BY w.doc_id"""


@query("op8_jaccard_join", JACCARD_SQL)
def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf, "documents")).drop("text_key", "group_key")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    scored = toxicity.score(documents, toxicity.fit(documents, table(spark, sf, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), bpe.default_path())


WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS keeper FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to FROM k"""


@query("op11_warc_bundles", WARC_SQL)
def op11_warc_bundles(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"))


NEGATIVES_SQL = """WITH f AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM f a JOIN f b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    relabelled = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf, "embeddings"), F.col("id") % 50 == 0, relabelled)


def terms_sql(column: str) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{letters}', '{letters.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


LEXICAL_SQL = f"""WITH d AS (SELECT row_number() OVER () AS place, doc_id, {terms_sql('text')} AS ts FROM documents),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest({terms_sql('text')}) AS term FROM benchmark),
p AS (SELECT place, any_value(doc_id) AS doc_id, term, any_value(n) AS n, count(*) AS tf FROM (SELECT place, doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY place, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY term),
s AS (SELECT item_id, place, any_value(doc_id) AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, place)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50"""


@query("op13_ranked_search", LEXICAL_SQL)
def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
