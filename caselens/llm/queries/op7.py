from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselens.llm import licences
from caselens.llm.registry import query, table


@query("op7_licence_scan")
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(table(spark, sf_dir, "documents"))
