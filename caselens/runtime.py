"""Session-level helpers shared by the operators."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    A local master without the setting (tests) gets a temporary folder. On a
    cluster the setting is required: a machine-local folder would be lost with
    its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_dir(spark.sparkContext.applicationId)


@functools.cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"caselens-{application}-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors and gives the following
    joins true sizes. The folder's own retention removes the files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SPREAD_BYTES_PER_CORE = 32 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a small scan has fewer splits than the session has cores.

    The input must be small for the cores, so the shuffle costs each of them
    next to nothing; large inputs pass without one. Meant for plain scans:
    counting the splits of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > cores * SPREAD_BYTES_PER_CORE or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


BATCH_BYTES = 8 * 1024 * 1024
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of ``BATCH_BYTES`` (or one longer row), where the session does not say how large.

    Spark's 10,000 rows of long texts are held by a task several times over: as
    written and as returned in its JVM, outside the heap, and in Python.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast hint behind a row count; larger tables are joined by a shuffle."""
    return F.broadcast(df) if small_enough(df, max_rows) else unsent(df)


def unsent(df: DataFrame) -> DataFrame:
    """Hint for a side of a join that grows with the input: it is not sent through the driver.

    Spark judges by the size of files, and those of whole numbers in a row are a
    small part of what the driver would hold.
    """
    return df.hint("merge")
