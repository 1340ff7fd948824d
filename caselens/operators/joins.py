"""Joins by key: attach, resume, look up, check parity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.runtime import materialize, unsent


def salted_lookup(
    facts: DataFrame,
    dim: DataFrame,
    *,
    key: str,
    spread_by: Sequence[str],
    how: str = "inner",
    hot_rows: int = 1_000_000,
    n_facts: int | None = None,
    grows: bool = False,
    counted: str | None = None,
) -> DataFrame:
    """Join many ``facts`` to a ``dim`` with few rows per key, hot keys split.

    A key with more than ``hot_rows`` facts is cut into parts of about that
    size; its ``dim`` rows are repeated per part. There are at most
    ``count(facts) / hot_rows`` hot keys, which bounds the broadcast list.
    Where the caller knows that there are no more than ``hot_rows`` facts, no
    key can be hot and the join is a plain one. A ``dim`` that ``grows`` with the
    facts is never sent through the driver. ``counted`` names a column of ``dim``,
    whose keys are unique, with the facts of each key, which then are not counted
    again.
    """
    sent = unsent if grows else (lambda df: df)
    if n_facts is not None and n_facts <= hot_rows:
        return facts.join(sent(dim), key, how)
    sizes = (dim.select(key, F.col(counted).alias("count")) if counted
             else facts.where(F.col(key).isNotNull()).groupBy(key).count())
    hot = F.broadcast(
        sizes.where(F.col("count") > hot_rows)
        .select(key, F.ceil(F.col("count") / hot_rows).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = facts.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*spread_by), parts).cast("int"))
    right = dim.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("_parts").join(sent(right.drop("_parts")), [key, "_part"], how).drop("_part")


def numbered(df: DataFrame, *order: Column, output: str = "number") -> DataFrame:
    """Number the rows from 0 in an order, without sorting them in one task.

    Rows are sorted by range, counted per range, and shifted by the ranges
    before; the driver sees one count per range.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part, within = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    shift, total = {}, 0
    for row in ranged.groupBy(part.alias("p")).count().orderBy("p").collect():
        shift[row["p"]] = total
        total += row["count"]
    if not shift:
        return ranged.withColumn(output, F.col("_at").cast("int")).drop("_at")
    before = F.create_map(*[F.lit(x) for pair in shift.items() for x in pair])
    return ranged.withColumn(output, (before[part] + within).cast("int")).drop("_at")


def attach(cases: DataFrame, results: DataFrame, *, case_id: str) -> DataFrame:
    """Every case once, with its result or nulls. Results are unique by key."""
    return cases.join(results, case_id, "left")


def pending(
    cases: DataFrame,
    results: DataFrame,
    *,
    case_id: str,
    done: Sequence[str] = ("ok", "blank"),
) -> DataFrame:
    """Cases without a finished result."""
    finished = results.where(F.col("status").isin(*done)).select(case_id)
    return cases.join(finished, case_id, "left_anti")


def map_values(
    df: DataFrame,
    lookup: dict[str, str],
    *,
    key: str,
    output: str,
    default: str | None = None,
) -> DataFrame:
    """Value of a fixed lookup; unmapped keys give ``default``."""
    rows = list(lookup.items())
    table = df.sparkSession.createDataFrame(rows, f"{key} string, {output} string")
    joined = df.join(F.broadcast(table), key, "left")
    return joined if default is None else joined.na.fill(default, [output])


def parity(left: DataFrame, right: DataFrame, *, key: str) -> DataFrame:
    """One row: sizes, keys missing on either side and repeated keys."""
    counted = (
        left.select(F.col(key), F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(F.col(key), F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counted.agg(
        total("l").alias("left_rows"),
        total("r").alias("right_rows"),
        F.count_if((F.col("l") > 0) & (F.col("r") == 0)).alias("only_left"),
        F.count_if((F.col("l") == 0) & (F.col("r") > 0)).alias("only_right"),
        F.count_if(F.col("l") > 1).alias("repeated_left"),
        F.count_if(F.col("r") > 1).alias("repeated_right"))


