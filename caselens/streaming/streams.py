"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from caselens.functions.dates import month_of
from caselens.functions.text import digest
from caselens.operators.infer import generate


def read_stream(
    spark: SparkSession, path: str, *, schema: T.StructType | str, fmt: str = "parquet",
    max_files: int | None = None,
) -> DataFrame:
    """Files as a stream; ``max_files`` bounds what one micro-batch reads."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def stream_dedup(stream: DataFrame, *, text: str, case_id: str, columns: Sequence[str] = ()) -> DataFrame:
    """Row with the least key of every distinct text of a stream: ``digest``, the key, and ``columns``.

    A later file may bring a lesser key, so the rows are a running aggregate
    for complete or update output (``drain_totals``). Copies meet map-side. The
    state is one such row per distinct text; for large streams keep it in the
    RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    keyed = stream.where(F.col(text).isNotNull()).withColumn("digest", digest(text))
    first = F.min_by(F.struct(case_id, *columns), case_id)
    return keyed.groupBy("digest").agg(first.alias("_first")).select("digest", "_first.*")


def stream_dedup_within(stream: DataFrame, *, text: str, time: str, within: str) -> DataFrame:
    """One row of the copies of a text that arrive within a span of each other: whichever is seen first.

    Keys expire behind the watermark, so the state stays small; which copy is
    kept depends on the order of arrival.
    """
    keyed = stream.where(F.col(text).isNotNull()).withColumn("digest", digest(text))
    return keyed.withWatermark(time, within).dropDuplicatesWithinWatermark(["digest"])


def first_of_session(
    cases: DataFrame, *, text: str, time: str, case_id: str, gap: str, lateness: str = "1 day", columns: Sequence[str] = (),
) -> DataFrame:
    """First row of the copies of a text that follow each other within ``gap``: ``digest, n_copies``, the key, ``time``, ``columns``.

    First is the earliest ``time``, ties to the least key, whatever the order of
    arrival within ``lateness``. The same rows from a table and from a stream: a
    stream gives those of sessions that ended behind the watermark and then
    forgets them, so its state holds one row per text of the last ``lateness``
    and ``gap`` (append output, ``drain``). Rows later than that are dropped, as
    by every watermark. ``time`` is a timestamp; null texts and times are left out.
    """
    keyed = cases.where(F.col(text).isNotNull() & F.col(time).isNotNull()).withColumn("digest", digest(text))
    if cases.isStreaming:
        keyed = keyed.withWatermark(time, lateness)
    row = F.struct(*dict.fromkeys((case_id, time, *columns)))
    first = F.min_by(row, F.struct(time, case_id))
    return (keyed.groupBy(F.session_window(time, gap), "digest")
            .agg(first.alias("_first"), F.count("*").alias("n_copies")).select("digest", "n_copies", "_first.*"))


def stream_topic_counts(
    stream: DataFrame, *, tag: str, time: str, case_id: str, window: str | None = None,
    slide: str | None = None, lateness: str = "1 day",
) -> DataFrame:
    """Tag counts per month, or per event-time window.

    A calendar month is no fixed window, so months are kept as keys (few per
    tag) for complete or update output; windows close behind the watermark.
    """
    if window is None:
        return (stream.groupBy(month_of(time).alias("month"), tag)
                .agg(F.count("*").alias("n_tags"), F.approx_count_distinct(case_id).alias("approx_cases")))
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return (stream.withWatermark(time, lateness).groupBy(span.alias("span"), tag)
            .agg(F.count("*").alias("n_tags"))
            .select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), tag, "n_tags"))


def stream_generate(
    stream: DataFrame, *, path: str, checkpoint: str, case_id: str, prompt: str, factory: Callable, **options,
) -> StreamingQuery:
    """Answer arriving cases into a keyed table, then stop.

    Every micro-batch owns a folder of the table and overwrites it when it is
    run again after a failure, so no case is stored twice.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        (generate(batch, case_id=case_id, prompt=prompt, factory=factory, **options)
         .write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"))

    return (stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def drain(stream: DataFrame, *, path: str, checkpoint: str) -> None:
    """Append all files there are to a Parquet table."""
    (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def drain_totals(totals: DataFrame, *, path: str, checkpoint: str) -> None:
    """Run an aggregated stream over all files there are; keep its last totals."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    (totals.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
