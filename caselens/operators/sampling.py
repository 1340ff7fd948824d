"""Bounded and reproducible samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, *, case_id: str, n: int) -> DataFrame:
    """The n rows with the least keys."""
    return df.orderBy(case_id).limit(n)


def sample_per_group(df: DataFrame, *, by: str, case_id: str, n: int = 5, seed: str = "0") -> DataFrame:
    """Up to n rows per group in an order fixed by the seed.

    Spark keeps at most n rows per group and map task before the shuffle.
    """
    order = F.md5(F.concat(F.lit(seed), F.col(case_id).cast("string")))
    ranked = Window.partitionBy(by).orderBy(order, case_id)
    return (df.where(F.col(by).isNotNull())
            .withColumn("sample_rank", F.row_number().over(ranked))
            .where(F.col("sample_rank") <= n))
