"""Counts over time, tags and places, and the series built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.dates import month_of
from caselens.functions.text import _col
from caselens.runtime import materialize


def _no_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def count_by(df: DataFrame, *, by: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per key; rows with a null key are left out."""
    return _no_nulls(df, by).groupBy(*by).agg(F.count("*").alias(name))


def top_n(df: DataFrame, *, by: Sequence[str], n: int = 20, name: str = "n") -> DataFrame:
    """The n most frequent keys; ties go to the lesser key."""
    return count_by(df, by=by, name=name).orderBy(F.desc(name), *by).limit(n)


def with_year(df: DataFrame, *, date: str, output: str = "year") -> DataFrame:
    return df.withColumn(output, F.year(date))


def with_month(df: DataFrame, *, date: str, output: str = "month") -> DataFrame:
    return df.withColumn(output, month_of(date))


def topic_rows(df: DataFrame, *, tags: Column | str, stem: str, regex: bool = False, output: str = "tag") -> DataFrame:
    """One row per tag that contains the stem. Tags are lower case already.

    Rows without a hit are filtered by the array first: that filter moves below
    joins to the table the tags come from.
    """
    def on_topic(t: Column) -> Column:
        return F.coalesce(t.rlike(stem) if regex else t.contains(stem), F.lit(False))

    hits = F.filter(_col(tags), on_topic)
    return df.where(F.exists(_col(tags), on_topic)).withColumn(output, F.explode(hits))


def topic_filter(df: DataFrame, *, text: str, stem: str, ignore_case: bool = False) -> DataFrame:
    """Rows whose text contains the stem; null texts do not."""
    c = F.lower(text) if ignore_case else F.col(text)
    return df.where(F.coalesce(c.contains(stem.lower() if ignore_case else stem), F.lit(False)))


def zero_fill(
    counts: DataFrame, *, month: str = "month", values: Sequence[str], by: Sequence[str] = (), step: str = "month",
) -> DataFrame:
    """Add the empty months (or days) between the first and the last one of the table.

    Works on aggregated counts. With ``by`` every key gets the months of the
    whole table; the counts are then written once, so that their source is not
    read again for the bounds and the keys.
    """
    interval = F.expr(f"interval 1 {step}")
    if by:
        counts = materialize(counts, "counts")
        first = counts.agg(F.min(month)).scalar()
        last = counts.agg(F.max(month)).scalar()
        calendar = counts.select(*by).distinct().withColumn(month, F.explode(F.sequence(first, last, interval)))
        return calendar.join(counts, [*by, month], "left").na.fill(0, list(values))
    # One global series: a row per month at most, so one task is enough.
    following = F.lead(month).over(Window.orderBy(month))
    until = F.coalesce((following - interval).cast("date"), F.col(month))
    steps = F.sequence(month, until, interval)
    spaced = counts.withColumn("_steps", steps).select("*", F.posexplode("_steps").alias("_gap", "_month"))
    kept = {v: F.when(F.col("_gap") == 0, F.col(v)).otherwise(0) for v in values}
    return spaced.withColumns(kept).withColumn(month, F.col("_month")).drop("_steps", "_gap", "_month")


def monthly_series(df: DataFrame, *, date: str, case_id: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and distinct cases per month, empty months as 0."""
    counts = (
        _no_nulls(with_month(df, date=date), ["month", *by])
        .groupBy(*by, "month", case_id).agg(F.count("*").alias("n"))
        .groupBy(*by, "month").agg(F.sum("n").alias("n_tags"), F.count("*").alias("n_cases")))
    return zero_fill(counts, values=["n_tags", "n_cases"], by=by)


def pivot_counts(
    df: DataFrame, *, rows: str, columns: str, values: Sequence[object] | None = None, value: str | None = None,
) -> DataFrame:
    """Counts (or sums of ``value``) with one column per value, 0 where a pair is absent.

    Without ``values`` Spark first looks for the distinct ones (one more job).
    """
    if value is None:
        df, value = count_by(df, by=[rows, columns]), "n"
    wide = df.groupBy(rows).pivot(columns, None if values is None else list(values)).sum(value)
    return wide.na.fill(0)


def share_and_rank(counts: DataFrame, *, part: str, value: str = "n") -> DataFrame:
    """Share of the part's total and rank within it, over aggregated counts."""
    within = Window.partitionBy(part)
    return (counts
            .withColumn("share", F.col(value) / F.sum(value).over(within))
            .withColumn("rank", F.dense_rank().over(within.orderBy(F.desc(value)))))


def spikes(
    series: DataFrame, *, time: str, by: Sequence[str] = (), value: str = "n", window: int = 7, z: float = 2.0,
) -> DataFrame:
    """Change on the previous step, z-score against the trailing window, spike flag.

    Runs on a zero-filled series; the window leaves the current row out and the
    score is null until it is full or where it is flat.
    """
    ordered = Window.partitionBy(*by).orderBy(time)
    trailing = ordered.rowsBetween(-window, -1)
    full = F.count(value).over(trailing) == window
    spread = F.stddev_samp(value).over(trailing)
    score = (F.col(value) - F.avg(value).over(trailing)) / spread
    return (series
            .withColumn("change", F.col(value) - F.lag(value).over(ordered))
            .withColumn("z_score", F.when(full & (spread > 0), score))
            .withColumn("is_spike", F.coalesce(F.col("z_score") > z, F.lit(False))))


def word_freq(df: DataFrame, *, text: str) -> DataFrame:
    """Words of a text column with their count and weight against the top one."""
    word = F.explode(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    counts = df.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    most = counts.agg(F.max(F.when(F.col("word").isNotNull(), F.col("n")))).scalar()
    return counts.withColumn("weight", F.col("n") / most)


def monthly_mean(series: DataFrame, *, name: str = "series", ts: str = "ts", value: str = "value") -> DataFrame:
    return (series.groupBy(name, month_of(ts).alias("month")).agg(F.avg(value).alias(value)))


def align_series(
    series: DataFrame, names: Sequence[str], *, name: str = "series", ts: str = "ts", value: str = "value",
) -> DataFrame:
    """One row per month with the monthly mean of each series, null where it has none."""
    return (series.withColumn("month", month_of(ts)).groupBy("month")
            .pivot(name, list(names)).agg(F.avg(value)))


def join_indicators(counts: DataFrame, indicators: DataFrame, *, month: str = "month") -> DataFrame:
    """Monthly counts beside the indicators of the same month; others are left out."""
    return counts.join(indicators, month)


def summary_sentences(
    df: DataFrame, *, template: str, columns: Sequence[str], source: str, output: str = "content",
) -> DataFrame:
    """One document per row: a sentence and a metadata map naming its source."""
    return (df.withColumn(output, F.format_string(template, *columns))
            .withColumn("metadata", F.create_map(F.lit("source"), F.lit(source))))
