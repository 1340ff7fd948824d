from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselens.llm import jaccard
from caselens.llm.registry import query, table


@query("op3_ngram_jaccard")
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=4, threshold=(85, 100))
