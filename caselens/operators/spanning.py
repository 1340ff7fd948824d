"""Density clusters from a spanning tree of mutual reachability distances.

HDBSCAN (Campello et al., "Density-Based Clustering Based on Hierarchical
Density Estimates", 2013) in steps that Spark distributes: the mutual
reachability of two vectors is their distance, or the distance to the
``min_pts``-th neighbour of either where that is larger. Boruvka rounds pick the
least edge that leaves each component: from lists of nearest neighbours where
these settle it, and over the cells within reach for the points where they do
not. The tree's edges are then merged from the shortest to the longest, in tiers of a
bounded number of edges; in a tier each component is worked through by itself.
Vectors of few entries lie in cells, and groups of cells do most of both by
themselves before.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselens.operators import cells
from caselens.operators.graph import components
from caselens.operators.joins import numbered, salted_lookup
from caselens.operators.neighbours import _vectors, knn_graph, usable
from caselens.operators.settling import SETTLED, around_cell, first_out, settled, united
from caselens.runtime import broadcast_if_small, materialize, small_enough

#: Distances below count as this, so that equal vectors have a finite density.
LEAST = 1e-9
#: Components, and their shares of cells besides two a cell, up to which outermost points are compared.
CORNERS = 4_000
#: Edges of a group of cells that one task joins, and those that it joins at most.
GROUP, ONE_TASK = 1 << 17, 1_000_000
#: Components that the driver keeps the names and least edges of.
NAMES = 100_000
_EDGE = "a long, b long, w double, src long, dst long"


def _least_edges(edges: DataFrame) -> DataFrame:
    """The least edge that leaves each component; ties by the ends, so that no cycle forms."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "src", "dst"))
    picked = both.groupBy("a").agg(F.min(F.struct("w", "src", "dst", "b")).alias("e"))
    return picked.select("a", "e.b", "e.w", "e.src", "e.dst")


def _renamed(df: DataFrame, names: DataFrame, column: str, hot_rows: int) -> DataFrame:
    """``df`` with the component of ``column``; ids that are in no edge stay."""
    dim = names.select(F.col("id").alias(column), "component")
    out = salted_lookup(df, dim, key=column, spread_by=[c for c in df.columns if c != column], how="left", hot_rows=hot_rows)
    return out.withColumn(column, F.coalesce("component", column)).drop("component").select(*df.columns)


def _kruskal(group: pa.Table) -> pa.Table:
    """The edges of a spanning forest of one small graph."""
    w, src, dst, a, b = (group[c].to_numpy() for c in ("w", "src", "dst", "a", "b"))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i in np.lexsort((dst, src, w)).tolist():
        p, q = find(int(a[i])), find(int(b[i]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append(i)
    return group.take(pa.array(kept, pa.int64()))


def spanning_forest(edges: DataFrame, *, small: int = 200_000, hot_rows: int = 1_000_000) -> DataFrame:
    """``src, dst, w``: the edges of a least spanning forest of ``src, dst, w``.

    Boruvka rounds: every component takes its least edge, the components that
    these join become one, and of parallel edges the least stays. Ties go to the
    lesser ends. When ``small`` edges are left, one task ends the search. Edges
    of a node to itself, and nulls, are left out. No edges give no rows.
    """
    ends = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    state = edges.where("src <> dst and w is not null").select(*ends, "w").groupBy("src", "dst").agg(F.min("w").alias("w"))
    state = materialize(state.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w", "src", "dst"), "edges")
    forest = None
    while True:
        n = state.count()
        if n <= small:
            tail = state.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lambda t: _kruskal(t.drop(["one"])), _EDGE)
            return (tail if forest is None else forest.unionByName(tail)).select("src", "dst", "w")
        taken = materialize(_least_edges(state), "taken")
        names = materialize(components(taken, src="a", dst="b", hot_rows=hot_rows), "names")
        chosen = taken.dropDuplicates(["src", "dst"])
        forest = chosen if forest is None else forest.unionByName(chosen)
        for column in ("a", "b"):
            state = _renamed(state, names, column, hot_rows)
        ends = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).alias("ends")
        state = (state.where("a <> b").groupBy(ends).agg(F.min(F.struct("w", "src", "dst")).alias("e"))
                 .select("ends.a", "ends.b", "e.w", "e.src", "e.dst"))
        state = materialize(state, "edges")


def _closest(queries: pa.Table, rows: pa.Table) -> pa.Table:
    """For each component of the queries, the row of another one that is nearest to any of its members, if within its ``bound``.

    Pairs of tiles whose boxes are farther apart than the least edge so far are left out.
    """
    found: list[tuple[np.ndarray, ...]] = []
    own, other, ids_x, ids_y = (t[c].to_numpy() for c in ("component", "id") for t in (queries, rows))
    names, of = np.unique(own, return_inverse=True)
    if len(queries) and len(rows):
        x, y = cells.vectors_of(queries["v"]), cells.vectors_of(rows["v"])
        core_x, core_y = queries["core"].to_numpy(), rows["core"].to_numpy()
        best = np.full(len(names), np.inf)
        np.minimum.at(best, of, queries["bound"].to_numpy())
        (mine, lo, hi), (theirs, los, his) = cells.tiles(x), cells.tiles(y)
        least = np.array([core_y[j].min() for j in theirs])
        pure = np.array([other[j[0]] if (other[j] == other[j[0]]).all() else -1 for j in theirs])
        mixed = np.array([(other[j] != other[j[0]]).any() for j in theirs])
        far = np.array([np.maximum(np.maximum(cells.gaps(lo[t], hi[t], los, his), least), core_x[i].min()) for t, i in enumerate(mine)])
        for t, i in enumerate(mine):
            if (own[i] == own[i[0]]).all():
                far[t, ~mixed & (pure == own[i[0]])] = np.inf
        for t in np.argsort(far.min(axis=1), kind="stable").tolist():
            i, order = mine[t], np.argsort(far[t], kind="stable")
            for some in (order[:4], order[4:]):
                some = some[np.isfinite(far[t, some]) & (far[t, some] <= best[of[i]].max() * cells.ROOM)]
                if not len(some):
                    continue
                j = np.concatenate([theirs[s] for s in some])
                square = (x[i] ** 2).sum(1)[:, None] + (y[j] ** 2).sum(1)[None, :]
                rough = np.sqrt(np.maximum(square - 2 * (x[i] @ y[j].T), 0))
                rough = np.maximum(np.maximum(rough, core_x[i, None]), core_y[None, j])
                rough[own[i, None] == other[None, j]] = np.inf
                near = rough <= np.minimum(rough.min(axis=1), best[of[i]])[:, None] + 1e-6 * (1 + np.sqrt(square))
                near &= np.isfinite(rough)
                p, q = np.nonzero(near)
                p, q = i[p], j[q]
                w = np.maximum(np.maximum(np.sqrt(((x[p] - y[q]) ** 2).sum(1)), core_x[p]), core_y[q])
                np.minimum.at(best, of[p], w)
                found.append((of[p], w, np.minimum(ids_x[p], ids_y[q]), np.maximum(ids_x[p], ids_y[q]), other[q]))
    c, w, src, dst, to = (np.concatenate(f) for f in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 5
    order = np.lexsort((to, dst, src, w, c))
    order = order[np.flatnonzero(np.concatenate([[True], np.diff(c[order]) != 0]))] if len(order) else order
    return pa.table({"a": pa.array(names[c[order]], pa.int64()), "b": pa.array(to[order], pa.int64()), "w": pa.array(w[order], pa.float64()),
                     "src": pa.array(src[order], pa.int64()), "dst": pa.array(dst[order], pa.int64())})


def _tightened(asked: DataFrame, at: DataFrame, wide: int) -> DataFrame:
    """``asked`` with a lesser ``bound`` where the outermost vectors of each cell show a shorter edge out of the component."""
    groups = at.groupBy("cell", "component")
    if not small_enough(groups.count(), CORNERS + 2 * at.select("cell").distinct().count()):
        return asked
    outer = F.array(*[by(F.struct("v", "core"), F.col("v")[i]) for i in range(wide) for by in (F.min_by, F.max_by)])
    corners = groups.agg(outer.alias("o")).select("component", F.explode("o").alias("o")).select("component", "o.v", "o.core")
    corners = materialize(corners.distinct(), "corners")
    mine = corners.join(broadcast_if_small(asked.select("component").distinct()), "component").repartition(corners.sparkSession.sparkContext.defaultParallelism)
    theirs = corners.select(F.col("component").alias("other"), F.col("v").alias("y"), F.col("core").alias("core_y"))
    apart = F.sqrt(sum(((F.col("v")[i] - F.col("y")[i]) ** 2 for i in range(wide)), F.lit(0.0)))
    shown = (mine.join(F.broadcast(theirs), F.col("component") != F.col("other"))
             .groupBy("component").agg(F.min(F.greatest(apart, "core", "core_y")).alias("shown")))
    return (asked.join(broadcast_if_small(materialize(shown, "shown")), "component", "left")
            .withColumn("bound", F.least("bound", "shown")).drop("shown").where(F.col("radius") <= F.col("bound") * cells.ROOM))


def _prim(group: pa.Table) -> pa.Table:
    """The least spanning tree of all vectors of one small group."""
    x, core, ids = _vectors(group["v"]), group["core"].to_numpy(), group["id"].to_numpy()
    near, source, left = np.full(len(x), np.inf), np.zeros(len(x), np.int64), np.ones(len(x), bool)
    edges: list[tuple[int, int, float]] = []
    at = 0
    for _ in range(len(x) - 1):
        left[at] = False
        w = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(axis=1)), core), core[at])
        closer = w < near
        near[closer], source[closer] = w[closer], at
        nxt = int(np.argmin(np.where(left, near, np.inf)))
        edges.append((int(min(ids[nxt], ids[source[nxt]])), int(max(ids[nxt], ids[source[nxt]])), float(near[nxt])))
        at = nxt
    return pa.table({"src": pa.array([e[0] for e in edges], pa.int64()), "dst": pa.array([e[1] for e in edges], pa.int64()),
                     "w": pa.array([e[2] for e in edges], pa.float64())})


def _ends(group: pa.Table) -> pa.Table:
    """The edges of a spanning forest of one small graph (``kind`` edge), and the least node of each node's tree (``kind`` name)."""
    kept = _kruskal(group)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(group["a"].to_pylist(), group["b"].to_pylist(), strict=True):
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    nodes = list(parent)
    names = pa.table({"kind": pa.array(["name"] * len(nodes), pa.string()), "a": pa.array(nodes, pa.int64()),
                      "b": pa.array([find(x) for x in nodes], pa.int64())})
    edges = kept.append_column("kind", pa.array(["edge"] * len(kept), pa.string()))
    return pa.concat_tables([edges, names], promote_options="default").select(["kind", "a", "b", "w", "src", "dst"])


def _joined(chosen: DataFrame, hot_rows: int, one_task: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """``(tree, names)``: the ``chosen`` edges but for those that close a ring, and the ``component`` of each ``id``."""
    if small_enough(chosen, one_task):
        one = chosen.select("a", "b", "w", "src", "dst", F.lit(0).alias("one")).groupBy("one")
        done = materialize(one.applyInArrow(lambda t: _ends(t.drop(["one"])), f"kind string, {_EDGE}"), "joined")
        return done.where("kind = 'edge'").select("src", "dst", "w"), done.where("kind = 'name'").select(F.col("a").alias("id"), F.col("b").alias("component"))
    names = materialize(components(chosen, src="a", dst="b", hot_rows=hot_rows), "names")
    # Where lengths are equal, chosen edges can close a ring; the forest leaves one of them out.
    kept = spanning_forest(chosen.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), hot_rows=hot_rows)
    kept = kept.select(F.col("src").alias("x"), F.col("dst").alias("y"), "w")
    pair = (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y"))
    new = (chosen.withColumnRenamed("w", "length").join(kept, pair & (F.col("length") == F.col("w")))
           .groupBy("x", "y").agg(F.min(F.struct("src", "dst", "w")).alias("e")).select("e.*"))
    return materialize(new, "tree"), names


def _boruvka(points: DataFrame, edges: DataFrame, block_rows: int, hot_rows: int) -> DataFrame:
    """``src, dst, w``: the least spanning tree of ``points`` (``id, v, core, radius``), with the help of a part of the edges.

    What is not in a point's list is at least its ``radius`` away. So the least
    listed edge that leaves a component is the least of all where no radius in
    the component is below it. Otherwise the points with a lesser radius are
    compared with all points of the cells (of ``block_rows`` points) that are no
    farther than that edge, or than an edge between outermost points of cells.
    """
    state = materialize(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w", "src", "dst"), "edges")
    n, wide = points.count(), len(points.first()["v"])
    at = materialize(cells.dealt(points, n, block_rows).withColumn("component", F.col("id")), "at")

    tree = None
    while True:
        listed = materialize(_least_edges(state), "listed")
        least = (at.groupBy("component").agg(F.min("radius").alias("radius"))
                 .join(listed.select(F.col("a").alias("component"), "w"), "component", "left"))
        least = materialize(least.withColumn("w", F.coalesce("w", F.lit(float("inf")))), "least")
        parts = least.count()
        if parts < 2:
            return tree if tree is not None else edges.select("src", "dst", "w").limit(0)
        unsafe = least.where("w > radius").select("component", "w")
        chosen = listed
        if unsafe.limit(1).count():
            asked = materialize(salted_lookup(at, unsafe, key="component", spread_by=["id"], hot_rows=hot_rows).where("radius < w")
                                .withColumnRenamed("w", "bound"), "asked")
            if wide <= cells.FLAT and parts <= CORNERS:
                asked = materialize(_tightened(asked, at, wide), "asked")
            found = cells.meetings(asked, at, wide, own=True).applyInArrow(_closest, _EDGE)
            every = materialize(listed.unionByName(found), "every")
            chosen = every.groupBy("a").agg(F.min(F.struct("w", "src", "dst", "b")).alias("e")).select("a", "e.b", "e.w", "e.src", "e.dst")
            chosen = materialize(chosen, "chosen")
        new, names = _joined(chosen, hot_rows)
        tree = new if tree is None else tree.unionByName(new)
        for column in ("a", "b"):
            state = _renamed(state, names, column, hot_rows)
        ends = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).alias("ends")
        state = materialize(state.where("a <> b").groupBy(ends).agg(F.min(F.struct("w", "src", "dst")).alias("e"))
                            .select("ends.a", "ends.b", "e.w", "e.src", "e.dst"), "edges")
        at = materialize(_renamed(at.withColumnRenamed("component", "c"), names, "c", hot_rows).withColumnRenamed("c", "component"), "at")


def _candidates(rest: DataFrame, wide: int, k: int) -> tuple[DataFrame, DataFrame]:
    """``(points, edges)``: ``rest`` with the length ``h`` of its cell, and all edges that a least tree can have up to that of either end."""
    lo, hi = (F.array(*[by(F.col("v")[i]) for i in range(wide)]) for by in (F.min, F.max))
    boxes = rest.groupBy("cell").agg(lo.alias("lo"), hi.alias("hi"), F.max("core").alias("most"), F.percentile_approx("core", 0.9, 1_000).alias("usual"),
                                     F.count("*").alias("n"))
    # Where most vectors have equal ones, twice the spacing of the others.
    side = F.array_max(F.zip_with("lo", "hi", lambda low, high: high - low))
    spacing = 2 * side * F.pow(F.lit(float(k)) / F.col("n"), F.lit(1 / wide))
    boxes = boxes.withColumn("h", F.when(F.col("usual") > 0, F.least("most", 2 * F.col("usual"))).otherwise(spacing)).drop("most", "usual", "n")
    boxes = materialize(boxes, "boxes")
    points = rest.join(broadcast_if_small(boxes.select("cell", "h")), "cell")
    others = boxes.select(F.col("cell").alias("q"), F.col("lo").alias("low"), F.col("hi").alias("high"))
    reach = F.col("limit") * cells.ROOM
    pairs = (boxes.select(F.col("cell").alias("g"), "lo", "hi", F.col("h").alias("limit")).crossJoin(broadcast_if_small(others))
             .where((F.col("g") != F.col("q")) & (cells._gap("low", "high", "lo", "hi", wide) <= reach)).select("g", "q", "lo", "hi", "limit"))
    columns = ["g", "id", "v", "core", "last", "cell", "h", "near"]
    around = points.join(broadcast_if_small(materialize(pairs, "pairs")), F.col("cell") == F.col("q")).where(cells._gap("v", "v", "lo", "hi", wide) <= reach)
    both = points.withColumn("g", F.col("cell")).select(*columns).unionByName(around.select(*columns))
    edges = both.groupBy("g").applyInArrow(around_cell(_closest), SETTLED.removeprefix("kind string, "))
    return points, materialize(edges, "candidates")


def _shift(n: int, depth: int, rows: int) -> int:
    """The bits of a cell that a group of about ``rows`` of ``n`` edges leaves out."""
    return max(0, depth - math.ceil(math.log2(max(1, n / rows))))


def _settled(edges: DataFrame, depth: int, whole: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """``(tree, names, edges)``: edges that are sure, the parts that they join (each step's of those of the step before), and the edges that are left."""
    trees, names, shift, mask = [], [], -1, (1 << depth) - 1
    while n := edges.count():
        at_least, shift = shift + 1, depth if n <= whole else _shift(n, depth, GROUP)
        shift = max(shift, min(at_least, depth))
        if shift == depth and n > ONE_TASK:
            break
        groups = [F.shiftright(F.col(c).bitwiseAND(mask), shift) for c in ("ca", "cb")]
        done = edges.withColumn("g", F.explode(F.array_distinct(F.array(*groups)))).groupBy("g").applyInArrow(settled(shift, mask), SETTLED)
        done = materialize(done, "settled")
        trees.append(done.where("kind = 'tree'").select("src", "dst", "w", "sc", "dc"))
        names.append(done.where("kind = 'name'").select(F.col("a").alias("id"), F.col("b").alias("component")))
        sides = [F.max(c).alias(c) for c in ("a", "b", "ra", "rb", "ca", "cb", "sc", "dc")]
        across = done.where("kind = 'half'").groupBy("src", "dst").agg(F.max("w").alias("w"), *sides)
        edges = materialize(done.where("kind = 'edge'").drop("kind").unionByName(across), "edges")
        if shift == depth:
            break
    return trees, names, edges


def _flat_tree(rows: DataFrame, n: int, wide: int, min_pts: int, k: int, block_rows: int, hot_rows: int, whole: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """``(points, tree)`` for vectors of few entries: ``id, v, core, radius, cell`` and ``src, dst, w, sc, dc``.

    Cells are joined by themselves up to a length, with what is that near
    around them, then groups of cells, see ``settling``. Parts whose least edge
    may be longer are compared with the cells within reach: first those of up to
    ``k`` vectors, one of whose listed neighbours is in another part, and when
    these are the lesser half all but the largest.
    """
    depth = cells.depth_of(n, block_rows)
    entry = lambda at: F.get("near", at)
    listed = materialize(cells.listed_in_cells(rows, n, k, rows=block_rows).select(
        "id", "v", "cell", "near", F.coalesce(entry(F.least(F.size("near"), F.lit(min_pts)) - 1)["d"], F.lit(0.0)).alias("core"),
        F.coalesce(entry(F.lit(k - 1))["d"], F.lit(float("inf"))).alias("last")), "listed")
    place = F.col("cell").bitwiseAND((1 << depth) - 1)
    # Of more than k equal vectors those with the k least ids are met; the others hang on the first of them.
    copy = F.coalesce((F.col("last") == 0) & (F.col("id") > entry(F.lit(k - 1))["nb"]), F.lit(False))
    copies = listed.where(copy).select(entry(F.lit(0))["nb"].alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"), place.alias("sc"), place.alias("dc"))
    met, edges = _candidates(listed.where(~copy), wide, k)
    trees, steps, left = _settled(edges, depth, whole)
    at = met.select("id", "v", "core", "cell", F.col("h").alias("radius"), F.when(F.col("last") > 0, F.col("last") + F.col("core")).otherwise(F.lit(float("inf"))).alias("reach"), F.col("id").alias("component"))
    for step in steps:
        step = step.select(F.col("id").alias("component"), F.col("component").alias("to"))
        at = at.join(broadcast_if_small(step), "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")
    at = materialize(at, "at")
    joined = _asked(at, left.select("a", "b", "w", "src", "dst"), wide, k, hot_rows)
    if joined is not None:
        for end, cell in (("src", "sc"), ("dst", "dc")):
            joined = at.select(F.col("id").alias(end), F.col("cell").alias(cell)).join(broadcast_if_small(joined), end)
        trees.append(materialize(joined, "joined"))
    tree = copies
    for part in trees:
        tree = tree.unionByName(part)
    return listed.select("id", "v", "core", F.col("last").alias("radius"), "cell"), tree


def _found(here: DataFrame, some: DataFrame, wide: int, tighten: bool) -> DataFrame:
    """The least edges out of the components ``some`` that are no longer than their ``bound``; what is nearer than ``least`` is not met."""
    asked = here.join(broadcast_if_small(some), "component").where(F.greatest("radius", "least") < F.col("bound")).drop("least")
    asked = materialize(asked, "asked")
    if tighten:
        asked = materialize(_tightened(asked, here, wide), "asked")
    found = cells.meetings(asked, here.drop("radius"), wide, own=True).applyInArrow(_closest, _EDGE)
    return materialize(found.groupBy("a").agg(F.min(F.struct("w", "src", "dst", "b")).alias("e")).select("a", "e.b", "e.w", "e.src", "e.dst"), "found")


def _asked(at: DataFrame, left: DataFrame, wide: int, k: int, hot_rows: int, most: int = NAMES) -> DataFrame | None:
    """``src, dst, w``: the least edges that join the components of ``at``, of which the edges ``left`` are known."""
    at = at.select("id", "v", "core", "component", "cell", "radius", "reach")
    tree = None
    while True:
        parts = materialize(at.groupBy(F.col("component").alias("a")).agg(
            F.count("*").alias("n"), F.min("radius").alias("radius"), F.min("reach").alias("reach")), "parts")
        if small_enough(parts, most) and small_enough(left, 2 * most):
            new = _asked_here(at.drop("reach"), parts, left, wide, k)
            return new if tree is None else tree if new is None else tree.unionByName(new)
        # Of so many components each takes its least edge in a round, those of up to k vectors by asking for it.
        state = parts.join(_least_edges(left), "a", "left").withColumn("known", F.coalesce("w", F.lit(float("inf"))))
        state = materialize(state, "state")
        sure, some = state.where("known <= radius"), state.where((F.col("known") > F.col("radius")) & (F.col("n") <= k) & (F.col("reach") < float("inf")))
        few = not some.limit(1).count() and not sure.limit(1).count()
        if few:
            some = state.join(state.agg(F.max_by("a", F.struct("n", "a")).alias("a")), "a", "left_anti")
        bound = F.least("known", F.lit(float("inf")) if few else F.col("reach") * cells.ROOM)
        listed = state.join(some.select("a"), "a", "left_semi").unionByName(sure).where("w is not null").select("a", "b", "w", "src", "dst")
        some = some.select(F.col("a").alias("component"), bound.alias("bound"), F.col("radius").alias("least"))
        every = listed.unionByName(_found(at.drop("reach"), materialize(some, "some"), wide, False))
        chosen = every.groupBy("a").agg(F.min(F.struct("w", "src", "dst", "b")).alias("e")).select("a", "e.b", "e.w", "e.src", "e.dst")
        new, names = _joined(materialize(chosen, "chosen"), hot_rows)
        tree = new if tree is None else tree.unionByName(new)
        at = materialize(_renamed(at.withColumnRenamed("component", "c"), names, "c", hot_rows).withColumnRenamed("c", "component"), "at")
        for column in ("a", "b"):
            left = _renamed(left, names, column, hot_rows)
        left = materialize(left.where("a <> b"), "left")


def _asked_here(at: DataFrame, parts: DataFrame, left: DataFrame, wide: int, k: int) -> DataFrame | None:
    """As ``_asked``, with the names of the components and their least edges on the driver; vectors are compared in tasks."""
    spark, parts, left = at.sparkSession, parts.orderBy("a").toArrow(), left.toArrow()
    names, n, start, reach = (parts[c].to_numpy() for c in ("a", "n", "radius", "reach"))
    a, b = (np.searchsorted(names, left[c].to_numpy()) for c in ("a", "b"))
    w, src, dst = (left[c].to_numpy() for c in ("w", "src", "dst"))
    part, start, kept = np.arange(len(names)), start.copy(), []
    while True:
        order = np.lexsort((dst, src, w))
        a, b, w, src, dst = (c[order] for c in (a, b, w, src, dst))
        while True:
            first, radius = first_out(part, a, b), np.full(len(names), np.inf)
            np.minimum.at(radius, part, start)
            known = np.append(w, np.inf)[first]
            chosen = np.unique(first[(first < len(w)) & (known <= radius)])
            if not len(chosen):
                break
            part, new = united(part, a, b, chosen)
            kept += zip(src[new].tolist(), dst[new].tolist(), w[new].tolist(), strict=True)
        size = np.bincount(part, weights=n, minlength=len(names))
        if np.count_nonzero(size) < 2:
            columns = zip(("src", "dst", "w"), zip(*kept, strict=True), strict=True) if kept else ()
            return spark.createDataFrame(pa.table({c: pa.array(v) for c, v in columns})) if kept else None
        near, open_ = np.full(len(names), np.inf), size > 0
        np.minimum.at(near, part, reach * cells.ROOM)
        small = open_ & (size <= k) & np.isfinite(near)
        small[np.argmax(size)] = False
        open_[np.argmax(size)] = False
        bound = np.where(size <= k, np.minimum(known, near), known)
        asking = small if 2 * np.count_nonzero(small) >= np.count_nonzero(open_) else open_
        now = spark.createDataFrame(pa.table({"component": names, "to": names[part]}))
        some = spark.createDataFrame(pa.table({"component": names[asking], "bound": bound[asking], "least": radius[asking]}))
        here = at.join(F.broadcast(now), "component").withColumn("component", F.col("to")).drop("to")
        found = _found(here, some, wide, asking is open_ and np.count_nonzero(size) <= CORNERS).toArrow()
        x, y = (np.searchsorted(names, found[c].to_numpy()) for c in ("a", "b"))
        shown = known.copy()
        np.minimum.at(shown, x, found["w"].to_numpy())
        # Below its least edge nothing is near a component that asked.
        known_now = asking[part] & np.isfinite(shown[part])
        if not known_now.any():
            raise RuntimeError(f"{np.count_nonzero(size)} components without an edge between them")
        start = np.where(known_now, np.maximum(start, shown[part]), start)
        a, b, w = np.append(a, x), np.append(b, y), np.append(w, found["w"].to_numpy())
        src, dst = np.append(src, found["src"].to_numpy()), np.append(dst, found["dst"].to_numpy())


def reachability_tree(
    df: DataFrame, *, case_id: str, vector: str, min_pts: int = 5, k: int | None = None, block_rows: int = 8_192,
    whole: int = 4_096, hot_rows: int = 1_000_000, **search,
) -> tuple[DataFrame, DataFrame]:
    """``(points, tree)``: ``id, v, core, radius`` and the edges ``src, dst, w`` of a least spanning tree by mutual reachability.

    Ids must be integers. ``core`` is the distance to the ``min_pts``-th nearest
    other vector. ``k`` neighbours of each vector are listed (``min_pts``, 10
    at least); the tree is exact as far as these lists are (see ``knn_graph``).
    Up to ``whole`` vectors are one task's work.
    """
    points, tree, _ = _reached(df, case_id=case_id, vector=vector, min_pts=min_pts, k=k, block_rows=block_rows, whole=whole, hot_rows=hot_rows, **search)
    return points.select("id", "v", "core", "radius"), tree.select("src", "dst", "w")


def _reached(
    df: DataFrame, *, case_id: str, vector: str, min_pts: int, k: int | None = None, block_rows: int = 8_192,
    whole: int = 4_096, hot_rows: int = 1_000_000, **search,
) -> tuple[DataFrame, DataFrame, int]:
    """``(points, tree, depth)`` as of ``reachability_tree``; with ``depth`` also the cells of both, see ``_flat_tree``."""
    k = max(k or 10, min_pts)
    rows = usable(df, case_id=case_id, vector=vector).select(F.col("id").cast("long").alias("id"), "v")
    rows = materialize(rows, "points")
    n = rows.count()
    if n > max(whole, 1) and (wide := len(rows.first()["v"])) <= cells.FLAT:
        points, tree = _flat_tree(rows, n, wide, min_pts, k, block_rows, hot_rows)
        return points, materialize(tree, "tree"), cells.depth_of(n, block_rows)
    graph = materialize(knn_graph(rows, case_id="id", vector="v", k=k, hot_rows=hot_rows, **search), "graph")
    core = graph.groupBy("id").agg(F.max(F.when(F.col("rank") <= min_pts, F.col("distance"))).alias("core"),
                                   F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("radius"))
    points = materialize(rows.join(core, "id", "left").select(
        "id", "v", F.coalesce("core", F.lit(0.0)).alias("core"), F.coalesce("radius", F.lit(float("inf"))).alias("radius")), "points")
    if points.limit(whole + 1).count() <= whole:
        one = points.withColumn("one", F.lit(0)).groupBy("one")
        return points, materialize(one.applyInArrow(_prim, "src long, dst long, w double"), "tree"), 0
    near = graph.select(F.least("id", "neighbour").alias("src"), F.greatest("id", "neighbour").alias("dst"), F.col("distance").alias("w"))
    near = near.groupBy("src", "dst").agg(F.min("w").alias("w"))
    for end in ("src", "dst"):
        cores = points.select(F.col("id").alias(end), F.col("core").alias(f"{end}_core"))
        near = salted_lookup(near, cores, key=end, spread_by=["src", "dst"], hot_rows=hot_rows)
    edges = near.select("src", "dst", F.greatest("w", "src_core", "dst_core").alias("w"))
    return points, materialize(_boruvka(points, edges, block_rows, hot_rows), "tree"), 0


# --- the condensed tree -----------------------------------------------------------------------------------------------

_EVENT = ("kind string, comp long, size long, cluster string, total double, inner double, parent string, stability double, wins boolean, "
          "cell long, a long, b long, w double, ca long, cb long, src long, dst long")
_COMP = ["comp", "size", "cluster", "total", "inner", "cell"]
_LINK = ["a", "b", "w", "ca", "cb", "src", "dst"]


def _merged(tier: str, min_size: int):
    """Merge the components of one group along its edges, all edges of one length at once.

    Edges may have one end in another group. A component that such an edge
    leaves is merged up to the length of that edge only, and so is what would
    merge with it.

    Out come ``comp`` rows (components afterwards), ``home`` rows (components
    that came into a cluster, and which), ``into`` rows (those in none, and the
    component they are now in), ``cluster`` rows (clusters that ended in a larger
    one) and the edges that are left: ``edge`` rows, and one ``half`` of those to
    other groups.
    """
    def run(comps: pa.Table, edges: pa.Table) -> pa.Table:
        comps, edges = comps.sort_by("comp"), edges.sort_by("w")
        ids = comps["comp"].to_numpy()
        size, cluster, total, inner = (comps[c].to_pylist() for c in ("size", "cluster", "total", "inner"))
        a, b = (np.minimum(np.searchsorted(ids, edges[c].to_numpy()), len(ids) - 1) for c in ("a", "b"))
        in_a, in_b = ids[a] == edges["a"].to_numpy(), ids[b] == edges["b"].to_numpy()
        length = edges["w"].to_numpy()
        here = np.flatnonzero(in_a & in_b)
        # The least length of an edge to another group, -1 where a component waits for one.
        outer = np.full(len(ids), np.inf)
        np.minimum.at(outer, a[in_a & ~in_b], length[in_a & ~in_b])
        np.minimum.at(outer, b[in_b & ~in_a], length[in_b & ~in_a])
        outer, parent, open_ = outer.tolist(), list(range(len(ids))), [c is None for c in cluster]
        # Those in no cluster, linked from the first to the last of each component.
        after, last, home = [-1] * len(ids), list(range(len(ids))), [None] * len(ids)
        names: dict[int, int] = {}
        ended: list[dict] = []

        def find(x: int) -> int:
            while (up := parent[x]) != x:
                parent[x] = x = parent[up]
            return x

        def linked(root: int, others: list[int]) -> None:
            # The first of a component is the one it is named by.
            for m in others:
                after[last[root]], last[root] = m, last[m]

        ends_a, ends_b, lengths = a[here].tolist(), b[here].tolist(), length[here].tolist()
        at, n = 0, len(lengths)
        while at < n:
            w = lengths[at]
            if at + 1 == n or lengths[at + 1] != w:
                p, q = find(ends_a[at]), find(ends_b[at])
                at += 1
                joined = [sorted((p, q))] if p != q else []
            else:
                of: dict[int, int] = {}

                def top(x: int) -> int:
                    while (up := of.setdefault(x, x)) != x:  # noqa: B023
                        of[x] = x = of[up]  # noqa: B023
                    return x

                while at < n and lengths[at] == w:
                    p, q = top(find(ends_a[at])), top(find(ends_b[at]))
                    of[max(p, q)] = min(p, q)
                    at += 1
                groups: dict[int, list[int]] = {}
                for m in sorted(of):
                    groups.setdefault(top(m), []).append(m)
                joined = [g for g in groups.values() if len(g) > 1]
            density = 1 / max(w, LEAST)
            for members in joined:
                root, least = members[0], min([outer[m] for m in members])
                if least <= w:
                    # Those in no cluster that are whole up to here come into the same one at this length.
                    alike = [m for m in members if cluster[m] is None and outer[m] >= w]
                    for m in alike[1:]:
                        parent[m] = alike[0]
                        size[alike[0]] += size[m]
                    if alike:
                        linked(alike[0], alike[1:])
                    for m in members:
                        outer[m] = -1.0
                    continue
                whole = sum([size[m] for m in members])
                big = [m for m in members if cluster[m] is not None]
                small = [m for m in members if cluster[m] is None]
                name, held, within = None, 0.0, 0.0
                if len(big) == 1:
                    name, held, within = cluster[big[0]], total[big[0]] + (whole - size[big[0]]) * density, inner[big[0]]
                elif big or whole >= min_size:
                    names[root] = names.get(root, 0) + 1
                    name, held = f"{tier}.{ids[root]}.{names[root]}", whole * density
                    for m in big:
                        stable = total[m] - size[m] * density
                        ended.append({"kind": "cluster", "cluster": cluster[m], "parent": name, "size": size[m], "stability": stable, "wins": stable >= inner[m]})
                        within += max(stable, inner[m])
                if name is None:
                    linked(root, members[1:])
                for m in small if name is not None else ():
                    while m >= 0:
                        home[m] = name
                        m = after[m]
                for m in members:
                    parent[m] = root
                size[root], cluster[root], total[root], inner[root], outer[root] = whole, name, held, within, least
        roots = np.array([find(x) for x in range(len(ids))], np.int64)
        top_, homed = np.flatnonzero(roots == np.arange(len(ids))), np.array([h is not None for h in home])
        into, came = np.flatnonzero(np.array(open_) & ~homed), np.flatnonzero(homed)
        cell = comps["cell"].to_numpy()
        # Edges that are left, by the components of their ends in this group.
        left = np.flatnonzero(~(in_a & in_b) | (roots[a] != roots[b]))
        whole_ = (in_a & in_b)[left]
        side = {c: (v[roots[end[left]]], ~inside[left]) for c, v, end, inside in (("a", ids, a, in_a), ("b", ids, b, in_b), ("ca", cell, a, in_a), ("cb", cell, b, in_b))}

        def rows(kind: str, at: np.ndarray, **columns) -> pa.Table:
            return pa.table({"kind": pa.array([kind] * len(at), pa.string()), **columns})

        pick = lambda values: [values[i] for i in top_.tolist()]
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        shape = pa.schema([(c, kinds[kind]) for c, kind in (f.split() for f in _EVENT.split(", "))])
        return pa.concat_tables([
            shape.empty_table(),
            rows("comp", top_, comp=ids[top_], size=pa.array(pick(size), pa.int64()), cluster=pa.array(pick(cluster), pa.string()),
                 total=pa.array(pick(total), pa.float64()), inner=pa.array(pick(inner), pa.float64()), cell=cell[top_]),
            rows("home", came, comp=ids[came], cluster=pa.array([home[i] for i in came.tolist()], pa.string())),
            rows("into", into, comp=ids[into], size=ids[roots[into]]),
            pa.Table.from_pylist(ended, schema=shape),
            pa.table({"kind": np.where(whole_, "edge", "half"), **{c: pa.array(v, mask=out) for c, (v, out) in side.items()},
                      **{c: edges[c].take(pa.array(left)) for c in ("w", "src", "dst")}}),
        ], promote_options="default").select(shape.names).cast(shape)
    return run


def _grouped(comps: DataFrame, edges: DataFrame, tier: str, min_size: int) -> DataFrame:
    """The events of all groups ``g`` of components and edges."""
    done = comps.select("g", *_COMP).groupBy("g").cogroup(edges.select("g", *_LINK).groupBy("g"))
    return materialize(done.applyInArrow(_merged(tier, min_size), _EVENT), "events")


def _merged_in_cells(comps: DataFrame, edges: DataFrame, depth: int, min_size: int, whole: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """``(comps, edges, events)`` after groups of cells that lie together, more at each step, merged what they can by themselves."""
    events, shift = [], -1
    while (n := edges.count()) > whole:
        at_least, shift = shift + 1, _shift(n, depth, min(whole, GROUP))
        if shift < at_least or shift == depth:
            break
        group = lambda c: F.shiftright(F.col(c).bitwiseAND((1 << depth) - 1), shift)  # noqa: B023, E731
        both = edges.withColumn("g", F.explode(F.array_distinct(F.array(group("ca"), group("cb")))))
        done = _grouped(comps.withColumn("g", group("cell")), both, f"cells{shift}", min_size)
        events.append(done)
        comps = done.where("kind = 'comp'").select(*_COMP)
        across = done.where("kind = 'half'").groupBy("src", "dst").agg(*[F.max(c).alias(c) for c in _LINK if c not in ("src", "dst")])
        edges = materialize(done.where("kind = 'edge'").select(*_LINK).unionByName(across.select(*_LINK)), "edges")
    return comps, edges, events


def _uppermost(group: pa.Table) -> pa.Table:
    """The uppermost of the winners above each cluster, itself included, in one task."""
    cluster, wins = group["cluster"].to_pylist(), group["wins"].to_pylist()
    up, own = dict(zip(cluster, group["parent"].to_pylist(), strict=True)), dict(zip(cluster, wins, strict=True))
    top: dict[str, str | None] = {}
    for c in cluster:
        way = []
        while c in up and c not in top:
            way.append(c)
            c = up[c]
        found = top.get(c)
        for c in reversed(way):
            found = top[c] = found if found is not None else c if own[c] else None
    return pa.table({"cluster": group["cluster"], "top": pa.array([top[c] for c in cluster], pa.string())})


def _jumped(clusters: DataFrame) -> DataFrame:
    """The same by doubling the way up."""
    jump = materialize(clusters.select("cluster", F.when(F.col("wins"), F.col("cluster")).alias("top"), F.col("parent").alias("up")), "jump")
    while jump.where("up is not null").limit(1).count():
        above = jump.select(F.col("cluster").alias("up"), F.col("top").alias("top_above"), F.col("up").alias("next"))
        jump = materialize(jump.join(broadcast_if_small(above), "up", "left").select(
            "cluster", F.coalesce("top_above", "top").alias("top"), F.col("next").alias("up")), "jump")
    return jump


def condensed_clusters(
    points: DataFrame, tree: DataFrame, *, min_size: int = 30, tier_edges: int = 1_000_000, hot_rows: int = 1_000_000, depth: int = 0,
) -> DataFrame:
    """``id, cluster``: the most stable clusters of a spanning tree (``src, dst, w``); null is noise.

    Going from long edges to short ones, a cluster ends where it falls into two
    or more parts of ``min_size`` points; smaller parts leave it. Its stability
    is the sum over its points of the density (1 / length) at which they leave
    less the one at which it began, and of a cluster and its descendants those
    with the larger sum are chosen. Edges of one length act at once, so the
    result does not depend on which of several least trees is given. The whole
    is no cluster. With ``depth`` the points have a ``cell`` and the tree the cells
    ``sc`` and ``dc`` of its ends, and groups of cells merge first what they can by
    themselves. A tier holds about ``tier_edges`` of the edges that are left, more
    where they are of one length.
    """
    comps = points.select(F.col("id").alias("comp"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("string").alias("cluster"),
                          F.lit(0.0).alias("total"), F.lit(0.0).alias("inner"), (F.col("cell") if depth else F.lit(0)).cast("long").alias("cell"))
    ends = [(F.col(c) if depth else F.lit(0)).cast("long").alias(name) for c, name in (("sc", "ca"), ("dc", "cb"))]
    edges = tree.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w", *ends, "src", "dst")
    comps, tree, events = _merged_in_cells(comps, edges, depth, min_size, tier_edges)
    n = tree.count()
    tiers = max(1, -(-n // tier_edges))
    cuts = tree.select(F.percentile_approx("w", [i / tiers for i in range(1, tiers)], 10_000)).first()[0] if tiers > 1 else []
    bounds = [*sorted(set(cuts or [])), float("inf")]
    comps = materialize(comps, "comps")
    # Where a small component is, until it comes into a cluster; and the component of every one that there was.
    at = comps.select(F.col("comp").alias("id"), "comp")
    ended = [done.where("kind = 'cluster'").select("cluster", "parent", "size", "stability", "wins") for done in events]
    open_at, homes, low = at, None, -1.0
    for tier, high in enumerate(bounds):
        edges = tree.where((F.col("w") > low) & (F.col("w") <= high))
        low = high
        if tiers > 1:
            names = at.select("id", F.col("comp").alias("component"))
            for end in ("a", "b"):
                edges = _renamed(edges, names, end, hot_rows)
            edges = materialize(edges, "tier")
            groups = materialize(components(edges, src="a", dst="b", hot_rows=hot_rows), "groups")
            grouped = comps.join(groups.withColumnRenamed("id", "comp"), "comp").withColumnRenamed("component", "g")
            rest = comps.join(groups.select(F.col("id").alias("comp")), "comp", "left_anti")
            edges = edges.join(groups.select(F.col("id").alias("a"), F.col("component").alias("g")), "a")
        else:
            grouped, rest, edges = comps.withColumn("g", F.lit(0)), None, edges.withColumn("g", F.lit(0))
        done = _grouped(grouped, edges, str(tier), min_size)
        comps = done.where("kind = 'comp'").select(*_COMP)
        comps = comps if rest is None else materialize(comps.unionByName(rest), "comps")
        ended.append(done.where("kind = 'cluster'").select("cluster", "parent", "size", "stability", "wins"))
        home = done.where("kind = 'home'").select("comp", "cluster")
        came = salted_lookup(open_at, home, key="comp", spread_by=["id"], hot_rows=hot_rows).select("id", "cluster")
        homes = came if homes is None else homes.unionByName(came)
        if tiers > 1:
            into = done.where("kind = 'into'").select("comp", F.col("size").alias("next"))
            open_at = salted_lookup(open_at, home.select("comp"), key="comp", spread_by=["id"], how="left_anti", hot_rows=hot_rows)
            open_at = materialize(salted_lookup(open_at, into, key="comp", spread_by=["id"], how="left", hot_rows=hot_rows)
                                  .select("id", F.coalesce("next", "comp").alias("comp")), "open")
            at = materialize(_renamed(at.withColumnRenamed("comp", "c"), groups, "c", hot_rows).withColumnRenamed("c", "comp"), "at")
    # Back from the components that the cells left to those before, and so to the points.
    for done in reversed(events):
        later = materialize(homes, "homes")
        into = done.where("kind = 'into'").select(F.col("comp").alias("was"), F.col("size").alias("id"))
        came = salted_lookup(into, later, key="id", spread_by=["was"], hot_rows=hot_rows).select(F.col("was").alias("id"), "cluster")
        homes = done.where("kind = 'home'").select(F.col("comp").alias("id"), "cluster").unionByName(came)
    clusters = functools.reduce(DataFrame.unionByName, ended)
    clusters = materialize(clusters, "clusters")
    if small_enough(clusters, ONE_TASK // 2):
        one = clusters.select("cluster", "parent", "wins", F.lit(0).alias("one")).groupBy("one")
        jump = materialize(one.applyInArrow(_uppermost, "cluster string, top string"), "jump")
    else:
        jump = _jumped(clusters)
    named = salted_lookup(materialize(homes, "homes"), jump.select("cluster", "top"), key="cluster", spread_by=["id"], hot_rows=hot_rows)
    return points.select("id").join(named.select("id", F.col("top").alias("cluster")), "id", "left")


def density_tree(
    df: DataFrame, *, case_id: str, vector: str, min_size: int = 30, min_pts: int | None = None, tier_edges: int = 1_000_000,
    hot_rows: int = 1_000_000, **how,
) -> DataFrame:
    """``(case_id, cluster)`` by density of varying degree; -1 is noise, 0 the largest cluster, ties by the least id.

    ``min_pts`` is ``min_size`` unless given. Ids are integers. Rows without a
    usable vector, and rows without an id, are in no cluster: the first are
    noise, the others are left out. Of rows that repeat an id one counts. No rows
    give no rows.
    """
    points, tree, depth = _reached(df, case_id=case_id, vector=vector, min_pts=min_pts or min_size, hot_rows=hot_rows, **how)
    found = materialize(condensed_clusters(points, tree, min_size=min_size, tier_edges=tier_edges, hot_rows=hot_rows, depth=depth), "condensed")
    sizes = found.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    numbers = numbered(sizes, F.desc("size"), F.col("least"), output="number").select("cluster", "number")
    named = salted_lookup(found, numbers, key="cluster", spread_by=["id"], hot_rows=hot_rows).select("id", "number")
    ids = df.where(F.col(case_id).isNotNull()).select(F.col(case_id).cast("long").alias("id")).distinct()
    return ids.join(named, "id", "left").select(F.col("id").alias(case_id), F.coalesce("number", F.lit(-1)).alias("cluster"))
