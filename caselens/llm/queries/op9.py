from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselens.llm import brown
from caselens.llm.registry import query, table


@query("op9_brown_score")
def op9_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.report(table(spark, sf_dir, "documents"))
