"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversation_repair, embedding_dedup, exact_dedup, jaccard_join, language_id, mixing, paragraph_dedup, quality, sentencepiece_sampling, substring_dedup, toxicity, vector_codes
from .common import documents


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.encode(documents(spark, sf_dir), ids=False)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).drop("text_hash")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(documents(spark, sf_dir))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op6_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.paragraph_dedup(documents(spark, sf_dir), same_anchor=False).drop("kept_text")


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_embedding_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet")).report


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_exact_dedup, op3_mix_sources, op4_suffix_array, op5_language_id, op6_paragraph_minhash, op7_kneser_ney_quality, op8_embedding_lattice, op9_ngram_jaccard, op10_toxicity, op11_conversation_repair, op12_vector_codes, op13_bpe)
}

ORACLE_SQL = {
    "op11_conversation_repair": conversation_repair.report_sql(),
    "op12_vector_codes": vector_codes.codes_sql(),
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
    "op3_mix_sources": r"""
WITH d AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS tie, md5(coalesce(doc_id::VARCHAR, sha256(coalesce(text, '')))) AS key,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS schedule, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM s),
-- Sources reach their cap in the order of cap / weight: those before the first that doesn't are full.
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             (sum(source_size) OVER ())::DOUBLE * 150 / 100 AS total FROM w),
l AS (SELECT arg_min((total - held) / open, cap / weight) AS level FROM c WHERE (total - held) / open < cap / weight),
t AS (SELECT source, source_size, schedule, least(cap, weight * coalesce((SELECT level FROM l), 1e300)) AS target FROM w),
p AS (SELECT doc_id, size, source_size, target, schedule, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(least(size, floor(target)::BIGINT - start), 0) AS one, greatest(least(size, floor(target)::BIGINT - start - source_size), 0) AS two FROM p),
-- The shares of the target at the middle of the copies, and where the integrals of the schedules 1.5 - t, 0.5 + t and 1 reach them.
u AS (SELECT *, CASE WHEN one > 0 THEN (start + one / 2) / target END AS u1, CASE WHEN two > 0 THEN (start + source_size + two / 2) / target END AS u2 FROM k)
SELECT round(CASE schedule WHEN 0 THEN 1.5::DOUBLE - sqrt(2.25::DOUBLE - 2 * u1) WHEN 1 THEN sqrt(0.25::DOUBLE + 2 * u1) - 0.5::DOUBLE ELSE u1 END, 9) AS first_position,
       round(CASE schedule WHEN 0 THEN 1.5::DOUBLE - sqrt(2.25::DOUBLE - 2 * u2) WHEN 1 THEN sqrt(0.25::DOUBLE + 2 * u2) - 0.5::DOUBLE ELSE u2 END, 9) AS second_position,
       doc_id, size, source_size, round(target, 6) AS target, (one + two)::BIGINT AS taken, ((one > 0)::INT + (two > 0)::INT)::BIGINT AS copies FROM u""",
}
