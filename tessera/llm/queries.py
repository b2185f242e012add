"""The queries of this subpackage: each applies one operator, with its production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import extraction, jaccard, matroska, mixing, packing, pii, quality, topk, toxicity, warc
from tessera.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, table(spark, sf_dir, "labels"))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = matroska.media_column(table(spark, sf_dir, "documents").select("doc_id", "text"))
    read = media.select("doc_id", F.length(F.coalesce(F.encode("text", "utf-8"), F.lit(b""))).cast("long").alias("n_bytes"), matroska.features("media").alias("read"))
    return read.select("doc_id", "n_bytes", "read.*")


def op3_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "expected")


def op4_no_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op5_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return history.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", F.col("time").alias("capture_time"))


OP5_SQL = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to, url_key, capture_time
FROM (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(sha1(coalesce(html, '')), CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), 'string_agg', '') AS payload_digest,
         list_aggregate(list_reverse(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\\d*\\.', ''), '.')), 'string_agg', ',') || ')'
           || lower(regexp_extract(url, '^[a-z]+://[^/?#:]*([^#]*)', 1)) AS url_key,
         strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS capture_time
  FROM pages)
"""


def op6_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_offset_preserving_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii.*")


def op9_two_pass_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hierarchical_quality": op1_hierarchical_quality,
    "op2_matroska": op2_matroska,
    "op3_pareto_mixing": op3_pareto_mixing,
    "op4_no_random_access": op4_no_random_access,
    "op5_warc_merge": op5_warc_merge,
    "op6_token_groups": op6_token_groups,
    "op7_toxicity": op7_toxicity,
    "op8_offset_preserving_pii": op8_offset_preserving_pii,
    "op9_two_pass_blocks": op9_two_pass_blocks,
    "op10_harmonic_packing": op10_harmonic_packing,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op4_no_random_access": OP4_SQL, "op5_warc_merge": OP5_SQL}
