from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselens.llm import quality
from caselens.llm.registry import query, table


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
