"""Cells of vectors that lie together, and searches that leave out cells too far away.

Cells are the leaves of a tree of splits at medians, which a bounded sample
decides; every vector is dealt. A search sends a vector to the cells whose box is
within the vector's bound, and of those cells the rows within reach of what was
sent. In a task tiles of a few vectors are left out the same way, so all that is
left out is too far away and what is found is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.runtime import broadcast_if_small, materialize

#: Numbers in the sample that decides the splits.
SAMPLE = 1 << 17
#: Vectors of up to as many entries are near few boxes only.
FLAT = 4
#: Vectors of one tile.
TILE = 128
#: Boxes and bounds are compared with this much room, as their lengths are rounded.
ROOM = 1 + 1e-9


def vectors_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _splits(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(dims, cuts)`` of the splits of a whole tree, level by level."""
    dims, cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    held = [np.arange(len(x))]
    for node in range(len(dims)):
        i = held[node]
        if len(i):
            dims[node] = int(np.argmax(np.ptp(x[i], axis=0)))
            cuts[node] = np.median(x[i, dims[node]])
        above = x[i, dims[node]] > cuts[node]
        held += [i[~above], i[above]]
    return dims, cuts


def depth_of(n: int, rows: int) -> int:
    """The splits above each cell. A cell's lowest ``depth_of`` bits are its place in the tree, so cells near each other share the upper ones."""
    return max(0, math.ceil(math.log2(max(1, n / rows))))


def dealt(points: DataFrame, n: int, rows: int) -> DataFrame:
    """``points`` (with ``id`` and ``v``) and the ``cell`` of each, of about ``rows`` vectors; cells over four times that are cut into parts."""
    depth = depth_of(n, rows)
    if not depth:
        return points.withColumn("cell", F.lit(0).cast("long"))
    wide = len(points.first()["v"])
    most = max(4 << depth, SAMPLE // wide)
    sample = points.select("v").sample(min(1.0, most / n), 7).limit(2 * most).toArrow()
    dims, cuts = _splits(vectors_of(sample["v"]), depth)
    at, names = points.columns.index("v"), [*points.columns, "cell"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, node = vectors_of(batch.column(at)), np.zeros(len(batch), np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > cuts[node])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node - len(dims))], names)

    placed = materialize(points.mapInArrow(place, points.select("*", F.lit(0).cast("long").alias("cell")).schema), "placed")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / (4 * rows)).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1).cast("long")))
    return (placed.join(broadcast_if_small(parts), "cell", "left").withColumn("cell", F.col("cell") + part * (1 << depth)).drop("parts"))


def _box(wide: int) -> list[Column]:
    return [F.array(*[F.min(F.col("v")[i]) for i in range(wide)]).alias("lo"), F.array(*[F.max(F.col("v")[i]) for i in range(wide)]).alias("hi")]


def _pure() -> Column:
    """The one component of a group, null where there are several."""
    return F.when(F.min("component") == F.max("component"), F.min("component")).alias("pure")


def _gap(low: str, high: str, lo: str, hi: str, wide: int) -> Column:
    """The distance of two boxes."""
    sides = [F.greatest(F.lit(0.0), F.col(lo)[i] - F.col(high)[i], F.col(low)[i] - F.col(hi)[i]) for i in range(wide)]
    return F.sqrt(sum((s * s for s in sides), F.lit(0.0)))


def meetings(asked: DataFrame, rows: DataFrame, wide: int, *, own: bool):
    """``asked`` and those of ``rows`` that may be within reach, both grouped by the pair of their cells, for ``applyInArrow``.

    ``asked`` are ``id, v, core, component, cell, bound``, ``rows`` the same
    without ``bound``. Rows of the component of all that is asked, and what is
    farther than ``bound`` by distance or ``core``, need not be met. ``own`` says if
    a cell meets itself.
    """
    boxes = rows.groupBy(F.col("cell").alias("q")).agg(*_box(wide), F.min("core").alias("least"), _pure())
    boxes = materialize(boxes, "boxes")
    briefs = asked.groupBy(F.col("cell").alias("p")).agg(
        *(c.alias(n) for c, n in zip(_box(wide), ("low", "high"), strict=True)), F.min("core").alias("core"), F.max("bound").alias("bound"),
        _pure().alias("component"))
    apart = F.col("pure").isNull() | F.col("component").isNull() | (F.col("pure") != F.col("component"))
    within = F.greatest(_gap("low", "high", "lo", "hi", wide), F.col("core"), F.col("least")) <= F.col("bound") * ROOM
    pairs = materialize(briefs.crossJoin(broadcast_if_small(boxes)).where(within & apart & (F.lit(own) | (F.col("p") != F.col("q"))))
                        .select("p", "q", "lo", "hi", "least", "pure"), "pairs")
    flat = wide <= FLAT
    left = asked.withColumnRenamed("cell", "p").join(broadcast_if_small(pairs), "p").where(apart)
    if flat:
        left = left.where(F.greatest(_gap("v", "v", "lo", "hi", wide), F.col("core"), F.col("least")) <= F.col("bound") * ROOM)
    left = materialize(left.select("p", "q", "id", "v", "core", "component", "bound"), "left")
    reach = left.groupBy("p", "q").agg(*_box(wide), F.min("core").alias("least"), F.max("bound").alias("bound"), _pure())
    reach = broadcast_if_small(materialize(reach, "reach"))
    right = rows.withColumnRenamed("cell", "q").join(reach, "q").where(apart)
    if flat:
        right = right.where(F.greatest(_gap("v", "v", "lo", "hi", wide), F.col("core"), F.col("least")) <= F.col("bound") * ROOM)
    return left.groupBy("p", "q").cogroup(right.select("p", "q", "id", "v", "core", "component").groupBy("p", "q"))


def tiles(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Positions of vectors that lie together, and their boxes."""
    found, left = [], [np.arange(len(x))]
    while left:
        i = left.pop()
        if len(i) <= TILE:
            found.append(i)
            continue
        part = x[i]
        order = np.argpartition(part[:, int(np.argmax(np.ptp(part, axis=0)))], len(i) // 2)
        left += [i[order[:len(i) // 2]], i[order[len(i) // 2:]]]
    return found, np.array([x[i].min(axis=0) for i in found]), np.array([x[i].max(axis=0) for i in found])


def gaps(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray) -> np.ndarray:
    """The distances of one box from others."""
    return np.sqrt((np.maximum(0, np.maximum(los - hi, lo - his)) ** 2).sum(axis=1))


def _ranks(ids: pa.ChunkedArray) -> np.ndarray:
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


def _nearest(queries: pa.Table, rows: pa.Table, k: int, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions ``(i, j)`` and distances of the ``k`` nearest rows of each query that lie within its ``bound``; ties by id."""
    x, y, bound, rank = vectors_of(queries["v"]), vectors_of(rows["v"]), queries["bound"].to_numpy(), _ranks(rows["id"])
    (mine, lo, hi), (theirs, los, his) = tiles(x), tiles(y)
    size, found = np.array([len(t) for t in theirs]), []
    for t, i in enumerate(mine):
        far = gaps(lo[t], hi[t], los, his)
        order = np.argsort(far, kind="stable")
        # As many of the nearest tiles as hold k others bound the rest.
        first = int(np.searchsorted(np.cumsum(size[order]), k + 1)) + 1
        limit, done = bound[i], 0
        for upto in (min(first, len(order)), len(order)):
            some = order[done:upto]
            some = some[far[some] <= limit.max() * ROOM]
            done = upto
            if not len(some):
                continue
            j = np.concatenate([theirs[s] for s in some])
            d = np.sqrt(sum((x[i, c][:, None] - y[j, c][None, :]) ** 2 for c in range(x.shape[1])))
            if own:
                d[i[:, None] == j[None, :]] = np.inf
            if len(j) > k:
                limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
            a, b = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
            found.append((i[a], j[b], d[a, b]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, d = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((rank[j], d, i))
    i, j, d = i[order], j[order], d[order]
    start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    keep = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i)))) < k
    return i[keep], j[keep], d[keep]


def nearest_in_cells(points: DataFrame, n: int, k: int, *, rows: int = 8_192) -> DataFrame:
    """``id, nb, d``: the ``k`` nearest other ``points`` (``id, v``) of each, exactly; ties by id."""
    return listed_in_cells(points, n, k, rows=rows).select("id", F.explode("near").alias("e")).select("id", "e.nb", "e.d")


def listed_in_cells(points: DataFrame, n: int, k: int, *, rows: int = 8_192) -> DataFrame:
    """``id, v, cell, near``: each of ``points`` (``id, v``), and the ``k`` nearest others as ``(d, nb)``, exactly; ties by id."""
    wide, kind = len(points.first()["v"]), points.schema["id"].dataType.simpleString()
    cells = materialize(dealt(points, n, rows), "cells")
    near = f"near array<struct<d: double, nb: {kind}>>"

    def lists(ids: pa.ChunkedArray, others: pa.ChunkedArray, i: np.ndarray, j: np.ndarray, d: np.ndarray, n: int) -> pa.Array:
        each = pa.StructArray.from_arrays([pa.array(d), others.combine_chunks().take(pa.array(j))], ["d", "nb"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(n + 1)).astype(np.int32)), each)

    def inside(group: pa.Table) -> pa.Table:
        group = group.append_column("bound", pa.array(np.full(len(group), np.inf)))
        i, j, d = _nearest(group, group, k, True)
        last = np.where(np.bincount(i, minlength=len(group)) >= k, 0.0, np.inf)
        np.maximum.at(last, i, d)
        return pa.table({"id": group["id"], "v": group["v"], "cell": group["cell"], "bound": pa.array(last),
                         "near": lists(group["id"], group["id"], i, j, d, len(group))})

    def across(asked: pa.Table, others: pa.Table) -> pa.Table:
        i, j, d = _nearest(asked, others, k, False) if len(asked) and len(others) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"id": asked["id"], "near": lists(asked["id"], others["id"], i, j, d, len(asked))})

    found = materialize(cells.groupBy("cell").applyInArrow(inside, f"id {kind}, v array<double>, cell long, bound double, {near}"), "inside")
    plain = found.select("id", "v", F.lit(0.0).alias("core"), F.lit(None).cast(kind).alias("component"), "cell", "bound")
    more = meetings(plain, plain.drop("bound"), wide, own=False).applyInArrow(across, f"id {kind}, {near}").where(F.size("near") > 0)
    more = materialize(more, "across").groupBy("id").agg(F.flatten(F.collect_list("near")).alias("more"))
    return found.select("id", "v", "cell", "near").join(more, "id", "left").select(
        "id", "v", "cell", F.when(F.col("more").isNull(), F.col("near")).otherwise(F.slice(F.array_sort(F.concat("near", "more")), 1, k)).alias("near"))
