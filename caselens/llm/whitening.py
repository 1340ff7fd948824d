"""Whitening of embeddings by their leading components.

Vectors become integers, so that counts and sums are exact. The sums are taken
in tasks over the distinct vectors, centred at the whole number next to the
mean; the one matrix of the vectors' width goes to the driver, where ``qdwh``
finds its components. What goes back to the tasks is a matrix of width x
components. Neither grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm import dense, qdwh
from caselens.runtime import materialize


@dataclass(frozen=True)
class Whitening:
    """A fit over ``n`` vectors. Their mean is ``base + rest / n``, exactly."""

    n: int
    base: np.ndarray        # whole numbers next to the mean
    rest: np.ndarray        # sum of the vectors less n * base
    components: np.ndarray  # one unit vector per column
    values: np.ndarray      # their variances, falling
    trace: float

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.base) - self.rest / self.n

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        return self.centred(rows) @ self.components / np.sqrt(self.values)

    def deviation(self, rows: np.ndarray) -> list[int | None]:
        """Sum over the entries of ``(n * x - sum)^2``, exactly; None where a long cannot hold it."""
        off = (rows - self.base) * self.n - self.rest
        top = int(np.abs(off).max(initial=0))
        if top * top * off.shape[1] < 1 << 63:
            return (off * off).sum(axis=1).tolist()
        exact = [sum(x * x for x in row) for row in off.tolist()]
        return [x if x < 1 << 63 else None for x in exact]


def _added(df: DataFrame) -> dict[int, float]:
    """Totals of ``(slot, value)`` rows; the caller's slots are bounded by the width of the vectors."""
    found = df.groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    return dict(zip(found["slot"].to_pylist(), found["value"].to_pylist(), strict=True))


def _slots(totals: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals)), pa.int64()), pa.array(totals, kind)], ["slot", "value"])


def _sums(wide: int):
    """Number of rows in slot 0, sums of the entries behind it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + wide, np.int64)
        for batch in batches:
            rows = dense.unpack(batch.column(0), wide)
            total[0] += len(rows)
            total[1:] += rows.sum(axis=0, dtype=np.int64)
        yield _slots(total, pa.int64())
    return run


def _products(wide: int, form):
    """Sums of the products of every two columns of ``form(rows)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            rows = form(dense.unpack(batch.column(0), wide)).astype(np.float64)
            total = total + rows.T @ rows
        if np.ndim(total):
            yield _slots(total.ravel(), pa.float64())
    return run


def fit(vectors: DataFrame, wide: int, *, components: int = 16) -> Whitening | None:
    """Fit over the rows of ``x`` (packed vectors), each counted as it stands there; None without rows.

    Components with no variance (beside rounding) are left out: nothing can be
    divided by it.
    """
    sums = _added(vectors.select("x").mapInArrow(_sums(wide), "slot long, value long")
                  .select("slot", F.col("value").cast("decimal(38,0)").alias("value")))
    n = int(sums.get(0) or 0)
    if not n:
        return None
    total = [int(sums[1 + i]) for i in range(wide)]
    base = np.array([s // n for s in total], np.int64)
    rest = [s - n * int(b) for s, b in zip(total, base, strict=True)]
    # Products of small whole numbers: doubles hold their sums exactly, in any order, up to 2^53.
    found = _added(vectors.select("x").mapInArrow(_products(wide, lambda rows: rows - base), "slot long, value double"))
    cov = np.empty((wide, wide))
    for i in range(wide):
        for j in range(i + 1):
            cov[i, j] = cov[j, i] = (n * int(found[i * wide + j]) - rest[i] * rest[j]) / (n * n)
    values, parts = qdwh.eigen(cov)
    kept = int((values[:components] > wide * qdwh.EPS * max(values[0], 0.0)).sum())
    return Whitening(n, base, np.array(rest, np.int64), parts[:, :kept], values[:kept], float(np.trace(cov)))


def identity_error(vectors: DataFrame, wide: int, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows less the identity."""
    k = len(model.values)

    def form(rows: np.ndarray) -> np.ndarray:
        return np.hstack([model.whitened(rows), np.ones((len(rows), 1))])

    found = _added(vectors.select("x").mapInArrow(_products(wide, form), "slot long, value double"))
    moments = np.array([found[i] for i in range((k + 1) ** 2)]).reshape(k + 1, k + 1) / model.n
    mean = moments[:k, k]  # next to 0, as the rows are centred
    return float(np.abs(moments[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def report(
    df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16, scale: float = 64.0,
) -> DataFrame:
    """Every vector on the leading components, one row per component.

    Returns ``vec_id, component, n, deviation, whitened, explained,
    identity_error``. An entry c becomes ``floor(scale * c)``; a constant added
    to all of them would change nothing below. The fit takes every distinct
    vector once. ``deviation`` is the sum of ``(n * x - sum)^2``.

    Rows whose vector is null or holds null, NaN or an infinite number are left
    out. A vector shorter than the longest counts as filled up with 0. Entries
    beyond 2^28 stand at it. Rows that repeat a vector or an id stay, a null id
    is an ordinary value, and other columns are not looked at. Fewer components
    come out where fewer have a variance, none for a single distinct vector. No
    rows give no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    id_type = rows.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    wide = dense.width(rows, "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, good = dense.matrix(batch.column(1), wide)
            own = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), dense.pack(dense.floors(values[good], scale))], ["vec_id", "x"])

    packed = materialize(rows.mapInArrow(pack, f"vec_id {id_type}, x binary"), "vectors")
    distinct = materialize(packed.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, wide, components=components) if wide else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], shape)
    error = identity_error(distinct, wide, model)
    k = len(model.values)
    explained = model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = dense.unpack(batch.column(1), wide).astype(np.int64)
            m = len(values)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, model.n)), pa.array(model.deviation(values), pa.int64()).take(each),
                 pa.array(model.whitened(values).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return packed.mapInArrow(project, shape)
