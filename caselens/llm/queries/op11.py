from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselens.llm import minhash
from caselens.llm.registry import query, table


@query("op11_minhash")
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, threshold=(85, 100))
