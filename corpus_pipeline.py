"""From raw documents to token files: quality, near copies, benchmarks, mix, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caselens.llm import decontam, jaccard, mixing, quality, tokens
from caselens.llm.queries.op1 import quality_weights
from caselens.llm.queries.op6 import END_ID, VOCABULARY, tokenizer_path
from caselens.runtime import bound_batches, materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from labels outside the held-out fold."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(*quality.trusted(docs.select("doc_id", "text"), labels))
    return quality.score(docs, model).where("score >= 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    bound_batches(spark)
    return jaccard.one_of_each(docs, n=4, threshold=(85, 100))


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without test items; long test passages in documents that stay are cut out."""
    bound_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, or one to three times."""
    weights = quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.repeated(docs, mixing.mix(docs, weights=weights))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    bound_batches(spark)
    return tokens.read(spark, tokens.tokenize(docs, tokenizer_path(), end_id=END_ID, vocabulary=VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmarks", drop_benchmarks),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer cannot be put in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
