"""Hard negatives by threshold joins on inner products.

Anchors are joined with all rows above a threshold, which falls until every
window holds as many rows as it asks for (after Anastasiu and Karypis, "L2AP:
Fast cosine similarity search with prefix L-2 norm bounds", 2014):

* Dimensions stand in order of their energy over all rows. A row is indexed by
  its first dimensions only: those behind are left out where their norm times
  the anchor's is below the threshold.
* Partial scores are added up step by step over the indexed dimensions. A pair
  goes when its partial score plus the product of what is left of both norms
  is below the threshold.
* What remains is scored exactly, on whole numbers. Windows that are full raise
  the threshold again while a block is worked through.

Anchors and rows meet in blocks of bounded size, each one task, whatever one
label holds. Of equal vectors with one label only as many rows take part as can
be returned, and equal anchors are searched for once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.llm import dense
from caselens.operators.joins import salted_lookup
from caselens.runtime import broadcast_if_small, materialize

#: Anchors and rows of one block; rows that are worth a task of their own.
ANCHOR_BLOCK, ROW_BLOCK, LEAST_BLOCK = 8_192, 16_384, 1_024
#: Dimensions of a step; pairs scored at once.
STEP, PAIRS = 8, 200_000
#: Thresholds of the search for positives, as shares of the largest score there can be; the last one admits all rows.
LEVELS = (0.75, 0.5, 0.35, 0.2, 0.0, -1.0)
_HIT = "anchor long, w int, vec_id long, score long"


def _prepared(df: DataFrame, wide: int) -> DataFrame:
    """``vec_id, label, q, energy, anchor`` of the rows that take part; ``q`` is the packed vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, good = dense.matrix(batch.column(2), wide)
            own = pa.array(np.flatnonzero(good))
            whole = dense.floors(values[good], 256.0)
            energy = (whole.astype(np.int64) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), dense.pack(whole), pa.array(energy), batch.column(3).take(own)],
                ["vec_id", "label", "q", "energy", "anchor"])

    return df.mapInArrow(run, "vec_id long, label long, q binary, energy long, anchor boolean").distinct()


def _order(rows: DataFrame, wide: int) -> np.ndarray:
    """Dimensions by their energy over all rows, largest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide)
        for batch in batches:
            total += (dense.unpack(batch.column(0), wide).astype(np.float64) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide)), pa.array(total)], ["at", "energy"])

    found = rows.select("q").mapInArrow(run, "at long, energy double").groupBy("at").agg(F.sum("energy").alias("energy")).collect()
    energy = {r["at"]: r["energy"] for r in found}
    return np.array(sorted(range(wide), key=lambda i: (-energy.get(i, 0.0), i)), np.int64)


def _rest(rows: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norm of the dimensions from each edge on, one column per edge."""
    square = np.cumsum((rows.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
    square = np.hstack([square, np.zeros((len(rows), 1))])
    return np.sqrt(square[:, edges])


def _candidates(x: np.ndarray, y: np.ndarray, rest_x: np.ndarray, rest_y: np.ndarray, least: np.ndarray,
                edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may score ``least`` (one number per anchor) or more; rows come by falling number of indexed steps."""
    with np.errstate(divide="ignore", invalid="ignore"):
        needed = np.where(rest_x[:, 0] > 0, (least - 0.5) / rest_x[:, 0], np.where(least <= 0, -np.inf, np.inf)).min(initial=np.inf)
    # A row is left out of the lists of all steps from the first edge on at which its rest cannot reach a threshold alone.
    steps = np.where(needed <= 0, len(edges) - 1, (rest_y >= needed).sum(axis=1))
    order = np.argsort(-steps, kind="stable")
    y, rest_y, steps = y[order], rest_y[order], np.minimum(steps[order], len(edges) - 1)
    partial = np.zeros((len(x), len(y)), x.dtype)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    live = int((steps > 0).sum())
    for k in range(len(edges) - 1):
        if not live:
            break
        low, high = edges[k], edges[k + 1]
        partial[:, :live] += x[:, low:high] @ y[:live, low:high].T
        may = partial[:, :live] + (rest_x[:, k + 1, None] * rest_y[None, :live, k + 1]) * (1 + 1e-6) >= least[:, None] - 0.5
        onward = int((steps > k + 1).sum())
        if may[:, :onward].mean() < 0.02 if onward else False:
            onward = 0  # few enough to score them at once
        found.append(_pairs(may[:, onward:], onward))
        live = onward
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, cols = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    return rows, order[cols]


def _pairs(may: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    rows, cols = np.nonzero(may)
    return rows, cols + shift


def _first(hits: list[np.ndarray], k: int, windows: int) -> np.ndarray:
    """The ``k`` first hits of each window: columns anchor, window, id, score; highest scores first, ties by id."""
    rows = np.concatenate(hits)
    group = rows[:, 0] * windows + rows[:, 1]
    order = np.lexsort((rows[:, 2], -rows[:, 3], group))
    rows, group = rows[order], group[order]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(rows) else np.zeros(0, np.int64)
    rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
    return rows[rank < k]


def _search(order: np.ndarray, k: int, same: bool):
    """The ``k`` first rows in every window of every anchor of a block, among the rows of a block."""
    wide = len(order)
    edges = [*range(0, wide, STEP), wide]

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = np.zeros((0, 4), np.int64)
        if len(anchors) and len(rows):
            whole_x, whole_y = (dense.unpack(t["q"], wide)[:, order] for t in (anchors, rows))
            low, high = (_windows(anchors[c]) for c in ("low", "high"))
            label_x, label_y = anchors["label"].to_numpy(), rows["label"].to_numpy()
            ids = rows["vec_id"].to_numpy()
            largest = max(float((whole_x.astype(np.float64) ** 2).sum(1).max()), float((whole_y.astype(np.float64) ** 2).sum(1).max()))
            kind = np.float32 if largest < 1 << 22 else np.float64  # whole numbers that this type holds exactly
            x, rest_x = whole_x.astype(kind), _rest(whole_x, edges)
            least = low.min(axis=1)
            step = max(64, 4_000_000 // len(x))
            for at in range(0, len(ids), step):
                part = whole_y[at:at + step]
                i, j = _candidates(x, part.astype(kind), rest_x, _rest(part, edges), least, edges)
                j += at
                fits = (label_x[i] == label_y[j]) == same
                i, j = i[fits], j[fits]
                hits = [found]
                for a in range(0, len(i), PAIRS):
                    p, q = i[a:a + PAIRS], j[a:a + PAIRS]
                    score = np.einsum("ij,ij->i", whole_x[p].astype(np.int64), whole_y[q].astype(np.int64))
                    for w in range(low.shape[1]):
                        inside = np.flatnonzero((score >= low[p, w]) & (score <= high[p, w]))
                        hits.append(np.stack([p[inside], np.full(len(inside), w), ids[q[inside]], score[inside]], axis=1))
                    hits = [_first(hits, k, low.shape[1])]
                found = hits[0]
                if len(found):
                    # A full window asks for its last row's score, the others for all they take.
                    cell = found[:, 0] * low.shape[1] + found[:, 1]
                    count = np.bincount(cell, minlength=low.size)
                    last = np.full(low.size, np.iinfo(np.int64).max)
                    np.minimum.at(last, cell, found[:, 3])
                    least = np.where(count >= k, last, low.ravel()).reshape(low.shape).min(axis=1)
        names = anchors["anchor"].to_numpy() if len(anchors) else np.zeros(0, np.int64)
        return pa.table({"anchor": names[found[:, 0]], "w": found[:, 1].astype(np.int32), "vec_id": found[:, 2], "score": found[:, 3]})
    return run


def _windows(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of different lengths as one matrix; a missing window takes nothing and asks for nothing."""
    lists = column.to_pylist()
    out = np.full((len(lists), max(map(len, lists))), np.iinfo(np.int64).max)
    for i, one in enumerate(lists):
        out[i, :len(one)] = one
    return out


def _join(anchors: DataFrame, rows: DataFrame, order: np.ndarray, k: int, *, same: bool) -> DataFrame:
    """``anchor, w, vec_id, score, rank``: the ``k`` first rows of every window ``w`` of the anchors.

    ``anchors`` are ``anchor, label, q, low, high`` (arrays with the bounds of
    the windows). With ``same``, only rows of the anchor's label count and meet
    it; otherwise only rows of other labels count.
    """
    cell = F.col("label") if same else F.lit(0).cast("long")
    spare = max(1, rows.sparkSession.sparkContext.defaultParallelism)

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        n = F.count("*")
        least = F.ceil(n / LEAST_BLOCK) if name == "n_rows" else F.lit(1)
        return df.groupBy(cell.alias("cell")).agg(F.greatest(F.ceil(n / size), F.least(least, F.lit(spare))).cast("int").alias(name))

    sizes = materialize(blocks(anchors, ANCHOR_BLOCK, "n_anchors").join(blocks(rows, ROW_BLOCK, "n_rows"), "cell"), "blocks")
    sizes = broadcast_if_small(sizes)

    def place(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    group = ["cell", "a", "b"]
    left = anchors.withColumn("cell", cell).join(sizes, "cell").select(
        *group[:1], place("anchor", "n_anchors").alias("a"), every("n_rows").alias("b"), "anchor", "label", "q", "low", "high")
    right = rows.withColumn("cell", cell).join(sizes, "cell").select(
        *group[:1], every("n_anchors").alias("a"), place("vec_id", "n_rows").alias("b"), "vec_id", "label", "q")
    hits = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_search(order, k, same), _HIT)
    place_of = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(place_of)).where(F.col("rank") <= k)


def _until_full(anchors: DataFrame, rows: DataFrame, order: np.ndarray, k: int, bounds: list[tuple[Column, Column]], *, same: bool) -> DataFrame:
    """Join with one pair of bounds (``low``, ``high``) after the other, the windows of an anchor that are not full only.

    ``anchors`` have a column ``w`` and one row per window; ``wanted`` is the number of hits that is as good as ``k``.
    """
    open_rows, done = anchors, None
    for turn, (low, high) in enumerate(bounds):
        asked = (open_rows.select("anchor", "label", "q", F.struct("w", low.cast("long").alias("low"), high.cast("long").alias("high")).alias("s"))
                 .groupBy("anchor", "label", "q").agg(F.array_sort(F.collect_list("s")).alias("s")))
        asked = materialize(asked, "asked")
        hits = _join(asked.select("anchor", "label", "q", F.col("s.low").alias("low"), F.col("s.high").alias("high")), rows, order, k, same=same)
        # Windows are numbered by their place in the list while they are searched.
        named = asked.select("anchor", F.posexplode("s.w").alias("w", "own"))
        hits = materialize(hits.join(named, ["anchor", "w"]).select("anchor", F.col("own").alias("w"), "vec_id", "score", "rank"), "hits")
        if turn + 1 < len(bounds):
            counts = hits.groupBy("anchor", "w").agg(F.count("*").alias("n"))
            state = materialize(open_rows.join(counts, ["anchor", "w"], "left"), "windows")
            full = F.coalesce("n", F.lit(0)) >= F.col("wanted")
            open_rows = state.where(~full).drop("n")
            hits = hits.join(state.where(full).select("anchor", "w"), ["anchor", "w"], "left_semi")
            last = not open_rows.limit(1).count()
        else:
            last = True
        done = hits if done is None else done.unionByName(hits)
        if last:
            break
    return done


def mine(
    df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", anchors: Column | str,
    positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), hot_rows: int = 1_000_000,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An entry x of a vector becomes ``floor(256 * x)``; a score is the inner
    product of two such vectors. ``anchors`` is a condition on ``df``. An
    anchor's positives are the ``positives`` best other rows of its label; of
    each the ``negatives`` best rows of other labels are returned whose score is
    at most the positive's and at least ``share`` of it. Ties go to the lesser
    id. A positive with a score below 0 has no such rows, as its window is empty.

    Rows with a null id, label or vector, or a vector that holds null, NaN or an
    infinite number, take no part. A vector shorter than the longest counts as
    filled up with 0. Entries beyond 2^28 stand at it, and scores must fit in a
    long. Rows equal in id, label and vector are one; an id that repeats with
    other values names several rows. Other columns are not looked at. No rows,
    or no anchors, give no rows.
    """
    spark = df.sparkSession
    chosen = F.coalesce(F.expr(anchors) if isinstance(anchors, str) else anchors, F.lit(False))
    picked = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                       F.col(vector).alias("v"), chosen.alias("anchor")).where("vec_id is not null and label is not null")
    wide = dense.width(picked, "v")
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not wide:
        return spark.createDataFrame([], shape)
    rows = materialize(_prepared(picked, wide), "vectors")
    order = _order(rows, wide)
    # More rows than these of one label and vector are in no result.
    by_id = Window.partitionBy("label", "q").orderBy("vec_id")
    base = materialize(rows.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= max(positives + 1, negatives))
                       .select("vec_id", "label", "q", "energy"), "rows")
    labels = base.groupBy("label").agg(F.max("energy").alias("most"), F.count("*").alias("n"))

    # Anchors with the same label and vector are one, named by their least id and found again by it.
    own = rows.where("anchor").select(F.struct("label", "q").alias("k"), "vec_id", "energy")
    least = own.groupBy("k").agg(F.min(F.struct("vec_id", "energy")).alias("m"))
    # An id that repeats with other vectors names several anchors, so they are numbered.
    least = materialize(least.select("k", F.col("m.energy").alias("energy"), F.monotonically_increasing_id().alias("anchor")), "anchors")
    members = materialize(salted_lookup(own.select("k", "vec_id"), least.select("k", "anchor"), key="k", spread_by=["vec_id"], hot_rows=hot_rows)
                          .select("anchor", F.col("vec_id").alias("anchor_id")), "members")

    top = F.sqrt(F.col("energy").cast("double")) * F.sqrt(F.col("most").cast("double")) + 1
    asked = (least.select("anchor", "k.label", "k.q", "energy").join(broadcast_if_small(labels), "label")
             .withColumn("w", F.lit(0)).withColumn("wanted", F.least("n", F.lit(positives + 1))).withColumn("top", top))
    bounds = [(F.floor(F.col("top") * level), F.ceil("top")) for level in LEVELS]
    best = _until_full(asked.select("anchor", "label", "q", "w", "wanted", "top"), base, order, positives + 1, bounds, same=True)
    best = materialize(best.select("anchor", "vec_id", "score", "rank"), "positives")

    # One window per score that a positive has.
    num, den = share
    scores = best.where("score >= 0").select("anchor", "score").distinct()
    asked = (least.select("anchor", "k.label", "k.q").join(scores, "anchor")
             .withColumn("w", F.row_number().over(Window.partitionBy("anchor").orderBy("score"))).withColumn("wanted", F.lit(negatives)))
    asked = materialize(asked, "windows")
    last = F.ceil(F.col("score") * num / den)
    bounds = [(F.greatest(F.ceil(F.col("score") * middle / den), last), F.col("score")) for middle in ((den + num) / 2 + (den - num) / 4, num)]
    worst = _until_full(asked, base, order, negatives, bounds, same=False)
    worst = (worst.join(asked.select("anchor", "w", F.col("score").alias("positive_score")), ["anchor", "w"])
             .select("anchor", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))

    # An anchor is none of its own positives: where it is among the best, the next one moves up.
    place = Window.partitionBy("anchor", "anchor_id").orderBy(F.desc("score"), "vec_id")
    self_rank = F.min(F.when(F.col("vec_id") == F.col("anchor_id"), F.col("rank"))).over(Window.partitionBy("anchor", "anchor_id"))
    pairs = (salted_lookup(members, best, key="anchor", spread_by=["anchor_id"], hot_rows=hot_rows).withColumn("own", self_rank)
             .where(F.col("own").isNull() | (F.col("own") != F.col("rank")))
             .withColumn("place", F.row_number().over(place)).where(F.col("place") <= positives)
             .select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    found = salted_lookup(pairs, worst, key="anchor", spread_by=["anchor_id"], hot_rows=hot_rows).where(
        pairs["positive_score"] == worst["positive_score"]).drop(worst["positive_score"])
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
