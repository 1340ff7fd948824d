from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselens.llm import whitening
from caselens.llm.registry import query, table


@query("op12_whiten")
def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"), components=16, scale=64.0)
