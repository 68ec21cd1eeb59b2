"""A corpus pipeline: five stages over documents, each written and read again.

Toxic documents go; of equal texts one stays; of each group of near copies one stays;
sources are mixed to their target weights; what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import exact_dedup, jaccard_join, mixing, sentencepiece_sampling, toxicity
from tallymark.llm.common import Scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict toxic."""
    return toxicity.toxicity_stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of largest doc_id of each text."""
    return exact_dedup.dedup_stage(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each component of the n-gram Jaccard join."""
    return jaccard_join.jaccard_stage(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents in training order; a document may come twice or not at all."""
    return mixing.mix_stage(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document with their ids."""
    return sentencepiece_sampling.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The learned classifier and the sampled segmentations have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
