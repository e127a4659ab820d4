"""Queries that apply the operators, with production parameters, to the whole of their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm import alignment, fingerprint, language, linededup, minhash, mixing, packing, preferences, setjoin, topk, toxicity, warc, whitening
from codeloom.llm._spark import table

Query = Callable[[SparkSession, str], DataFrame]
#: Whole lines of so many words are not kept twice.
LINE_WORDS = 8
#: The part of all tokens that a mixture draws.
MIXED_SHARE = 0.9


def id_class(col: str, of: int):
    """crc32 of an id's text, modulo ``of``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % of


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels.where(id_class("doc_id", 5) != 0))
    scored = toxicity.score(docs, lexicon)
    return scored.select(
        "doc_id", (id_class("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_and_next(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(id_class("doc_id", 3) != 1))
    return language.predict(docs, model).select("doc_id", (id_class("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup(table(spark, sf_dir, "documents"), details=True, within=True, line_words=LINE_WORDS)
    return done.select("doc_id", "text", "n_chars", "removed_words", "spans")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents"), copies_col="copies", blocks_col="blocks", budget_share=MIXED_SHARE)
    return drawn.select("doc_id", "source", mixing.tokens("text").alias("tokens"), "copies", "blocks")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN r ON p.payload_digest = r.payload_digest AND p.payload_bytes >= 1000
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), added=True)


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return preferences.pair_up(preferences.against_other_answers(preferences.conversations(turns), every=True))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.scaled(table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)


OP10_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_setjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.linked(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return done.withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_fingerprints, op2_language, op3_minhash, op4_linededup, op5_mixing, op6_warc, op7_packing, op8_toxicity, op9_preferences, op10_topk, op11_alignment, op12_setjoin, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL, "op10_topk": OP10_SQL}
