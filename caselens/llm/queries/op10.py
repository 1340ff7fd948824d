from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselens.llm import secrets
from caselens.llm.registry import query, table


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))
