"""A graph of nearest neighbours without comparing all pairs.

Neighbour descent (Dong et al., "Efficient k-nearest neighbor graph construction
for generic similarity measures", 2011): random projections deal the vectors
into leaves, whose members are compared with each other; then neighbours of
neighbours are compared, round by round, until hardly any list changes. Work
grows as n log n: leaves are of bounded size, lists too, and so is what one
vector is compared with in a round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselens.operators import cells
from caselens.operators.cells import vectors_of as _vectors
from caselens.operators.joins import salted_lookup
from caselens.runtime import broadcast_if_small, materialize

#: Centres whose lists are compared in one task's group.
GROUP = 2_000


def usable(df: DataFrame, *, case_id: str, vector: str) -> DataFrame:
    """``id, v`` of the rows with an id and a vector of finite numbers; of rows that repeat an id one."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = df.where(F.col(case_id).isNotNull() & (F.size(v) > 0) & finite).select(F.col(case_id).alias("id"), v.alias("v"))
    return rows.dropDuplicates(["id"])


def _leaves(points: DataFrame, n: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """``tree, leaf, part, id, v``: every point once per tree; full leaves are cut into parts."""
    levels = max(0, math.ceil(math.log2(max(1, n / leaf))))
    if not levels:
        return points.select(F.lit(0).alias("tree"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("part"), "id", "v")
    wide = points.agg(F.max(F.size("v"))).first()[0]
    planes = np.random.default_rng(seed).standard_normal((wide, trees * levels))
    kind = points.schema["id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at = _vectors(batch.column(1)) @ planes
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32)), pa.array(at.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], ["id", "v", "at"])

    placed = materialize(points.mapInArrow(project, f"id {kind}, v array<double>, at array<double>"), "projected")
    middles = placed.agg(*[F.percentile_approx(F.col("at")[i], 0.5, 1000).alias(f"m{i}") for i in range(trees * levels)]).first()
    codes = [F.struct(F.lit(t).alias("tree"), sum(
        (F.when(F.col("at")[t * levels + j] > float(middles[t * levels + j]), F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j in range(levels)),
        F.lit(0).cast("long")).alias("leaf")) for t in range(trees)]
    dealt = materialize(placed.select("id", "v", F.explode(F.array(*codes)).alias("c")).select("c.tree", "c.leaf", "id", "v"), "leaves")
    parts = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * leaf)).alias("parts"))
    return dealt.join(broadcast_if_small(parts), ["tree", "leaf"]).select(
        "tree", "leaf", F.pmod(F.xxhash64("id", "tree"), F.col("parts")).alias("part"), "id", "v")


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(axis=-1))


def _of_leaf(width: int):
    """The nearest members of a leaf to each of its members."""
    def run(group: pa.Table) -> pa.Table:
        v = _vectors(group["v"])
        square = (v * v).sum(axis=1)
        rough = square[:, None] + square[None, :] - 2 * (v @ v.T)
        np.fill_diagonal(rough, np.inf)
        k = min(width, len(v) - 1)
        rows = np.repeat(np.arange(len(v)), k)
        cols = np.argpartition(rough, k - 1, axis=1)[:, :k].ravel() if k else np.zeros(0, np.int64)
        return pa.table({"id": group["id"].take(pa.array(rows)), "nb": group["id"].take(pa.array(cols)), "d": _apart(v[rows], v[cols])})
    return run


def _around():
    """Members of one centre's list that are nearer to each other than the last of their own lists."""
    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["at"].to_numpy(), kind="stable")
        at, new, bound = (group[c].to_numpy()[order] for c in ("at", "new", "bound"))
        v, ids = _vectors(group["v"])[order], group["id"].combine_chunks().take(pa.array(order))
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        size = np.diff(np.append(start, len(at)))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s, m in zip(start.tolist(), size.tolist(), strict=True):
            i, j = np.triu_indices(m, 1)
            fresh = new[s + i] | new[s + j]
            i, j = s + i[fresh], s + j[fresh]
            square = (v[s:s + m] ** 2).sum(axis=1)
            rough = square[i - s] + square[j - s] - 2 * (v[s:s + m] @ v[s:s + m].T)[i - s, j - s]
            near = rough <= np.maximum(bound[i], bound[j]) ** 2 + 1e-9 * (square[i - s] + square[j - s])
            i, j = i[near], j[near]
            d = _apart(v[i], v[j])
            for a, b in ((i, j), (j, i)):
                better = d < bound[a]
                found.append((a[better], b[better], d[better]))
        a, b, d = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3))
        return pa.table({"id": ids.take(pa.array(a.astype(np.int64))), "nb": ids.take(pa.array(b.astype(np.int64))), "d": d.astype(np.float64)})
    return run


def _nearest(pairs: DataFrame, width: int) -> DataFrame:
    """The ``width`` nearest of each list; ``new`` where a pair was in no list before."""
    order = Window.partitionBy("id").orderBy("d", F.xxhash64("id", "nb"))
    once = pairs.where("id <> nb").groupBy("id", "nb").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= width).select("id", "nb", "d", "new")


def knn_graph(
    df: DataFrame, *, case_id: str, vector: str, k: int = 10, width: int | None = None, trees: int = 4, leaf: int = 256,
    rounds: int = 12, settled: float = 0.002, seed: int = 11, hot_rows: int = 1_000_000,
) -> DataFrame:
    """``id, neighbour, distance, rank``: about the ``k`` nearest other rows of each row, by Euclidean distance.

    Lists hold ``width`` neighbours while they are searched (2 k, 24 at least).
    A round compares the members of each list and of as many lists that hold its
    centre; rounds end when less than ``settled`` of the entries change. A table
    of up to ``leaf`` rows is one leaf, so its graph is exact. Vectors of up to
    ``cells.FLAT`` entries are compared by cells within reach, which is exact, too.

    Rows without an id, without a vector or with null, NaN or infinite entries
    take no part; vectors are of one length, and of rows that repeat an id one
    takes part. Equal vectors are neighbours at distance 0. No rows, or one, give
    no rows.
    """
    width = width or max(24, 2 * k)
    kind = df.schema[case_id].dataType.simpleString()
    pair = f"id {kind}, nb {kind}, d double"
    points = materialize(usable(df, case_id=case_id, vector=vector), "points")
    n, order = points.count(), Window.partitionBy("id").orderBy("distance", "neighbour")
    if n > leaf and len(points.first()["v"]) <= cells.FLAT:
        graph = cells.nearest_in_cells(points, n, k)
        return (graph.select("id", F.col("nb").alias("neighbour"), F.col("d").alias("distance")).withColumn("rank", F.row_number().over(order)))
    start = _leaves(points, n, trees, leaf, seed).groupBy("tree", "leaf", "part").applyInArrow(_of_leaf(width), pair)
    graph = materialize(_nearest(start.withColumn("new", F.lit(True)), width), "graph")
    groups = max(1, n // GROUP)
    for turn in range(rounds if n > leaf else 0):
        last = graph.groupBy("id").agg(F.max("d").alias("last"), F.count("*").alias("n"))
        state = points.join(last, "id", "left").select(
            F.col("id").alias("nb"), "v", F.when(F.col("n") >= width, F.col("last")).otherwise(F.lit(math.inf)).alias("bound"))
        some = Window.partitionBy("id").orderBy(F.desc("new"), F.xxhash64("id", "nb", F.lit(turn)))
        back = graph.select(F.col("nb").alias("id"), F.col("id").alias("nb"), "new")
        back = back.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= width).drop("rank")
        lists = graph.select("id", "nb", "new").unionByName(back).groupBy("id", "nb").agg(F.max("new").alias("new"))
        members = salted_lookup(lists, materialize(state, "state"), key="nb", spread_by=["id"], hot_rows=hot_rows, n_facts=2 * n * width)
        members = members.select(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"), F.xxhash64("id").alias("at"), F.col("nb").alias("id"), "v", "bound", "new")
        better = members.groupBy("group").applyInArrow(_around(), pair)
        before = graph.select("id", "nb", "d", F.lit(False).alias("new"))
        graph = materialize(_nearest(before.unionByName(better.withColumn("new", F.lit(True))), width), "graph")
        if graph.where("new").count() <= settled * n * width:
            break
    return (graph.select("id", F.col("nb").alias("neighbour"), F.col("d").alias("distance"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
