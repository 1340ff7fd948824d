"""Data profile: missing values, distinct values, copies; and profiles that merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.functions.text import is_blank


def profile(df: DataFrame, *, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """One row per column: rows, nulls, blanks, distinct values, repeated values.

    The default reads the table once and estimates the distinct values (repeats
    are then null). ``exact`` counts every value: one shuffle of pre-aggregated
    (column, value) counts.
    """
    names = list(columns or df.columns)
    if not exact:
        return _estimated(df, names)
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in names]))
    long = df.select(cells.alias("cell")).select("cell.*")
    empty = F.col("value").isNotNull() & is_blank("value")
    # Long values travel as digests.
    key = F.when(F.col("value").isNull(), None).otherwise(F.sha2("value", 256))
    per_value = (long.groupBy("column_name", key.alias("d"), F.coalesce(empty, F.lit(False)).alias("blank"))
                 .agg(F.count("*").alias("n")))
    has = F.col("d").isNotNull()
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return per_value.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        total(~has).alias("n_null"),
        total(F.col("blank")).alias("n_blank"),
        F.count_if(has).alias("n_distinct"),
        F.count_if(has & (F.col("n") > 1)).alias("n_repeated"))


def _estimated(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One aggregate over all columns, then one row per column."""
    facts = []
    for c in names:
        text = F.col(c).cast("string")
        facts.append(F.struct(
            F.lit(c).alias("column_name"),
            F.count("*").alias("n_rows"),
            F.count_if(text.isNull()).alias("n_null"),
            F.count_if(text.isNotNull() & is_blank(text)).alias("n_blank"),
            F.approx_count_distinct(c).alias("n_distinct"),
            F.lit(None).cast("bigint").alias("n_repeated")))
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def sketch_profile(df: DataFrame, *, by: Sequence[str] = (), columns: Sequence[str] | None = None, lg_k: int = 12) -> DataFrame:
    """One row per value of ``by`` (a load, a day) and column: counts and sketches that merge.

    ``values`` sketches the distinct values (HyperLogLog, 2^lg_k registers), ``numbers``
    the quantiles of numeric columns (KLL; null for others). A sketch has a
    fixed size, so the stored table grows with loads times columns, and the
    cases are read once. Null counts in ``n_null`` only. Append the rows of
    every load, and ask ``merged_profile`` about any set of loads.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = [c for c in (columns or df.columns) if c not in by]
    facts = []
    for c in names:
        text = F.col(c).cast("string")
        number = F.col(c).cast("double") if isinstance(fields[c], T.NumericType) else None
        sketch = F.lit(None).cast("binary") if number is None else F.kll_sketch_agg_double(number)
        facts.append(F.struct(
            F.lit(c).alias("column_name"),
            F.count("*").alias("n_rows"),
            F.count_if(text.isNull()).alias("n_null"),
            F.count_if(text.isNotNull() & is_blank(text)).alias("n_blank"),
            F.hll_sketch_agg(text, lg_k).alias("values"),
            sketch.alias("numbers")))
    return df.groupBy(*by).agg(F.array(*facts).alias("_facts")).select(*by, F.inline("_facts"))


def merged_profile(sketches: DataFrame, *, by: Sequence[str] = (), quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Rows of ``sketch_profile`` merged per column (and ``by``): counts are exact, the rest estimates.

    ``n_distinct`` has a standard error of about 1.04 / sqrt(2^lg_k), 1.6 % by
    default; ``quantiles`` (an array as asked for; null for columns without
    numbers) are off by about 1.3 % of the ranks.
    """
    per = sketches.groupBy(*by, "column_name").agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "n_null", "n_blank")],
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("n_distinct"),
        F.kll_merge_agg_double("numbers").alias("_numbers"))
    ranks = F.array(*[F.lit(float(q)) for q in quantiles])
    some = F.col("_numbers").isNotNull() & (F.kll_sketch_get_n_double("_numbers") > 0)
    return per.withColumn("quantiles", F.when(some, F.kll_sketch_get_quantile_double("_numbers", ranks))).drop("_numbers")
