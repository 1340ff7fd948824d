"""Neighbour graphs and density clusters against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caselens.operators import cells, neighbours, spanning


def frame(spark, rows, partitions=3):
    made = spark.createDataFrame([(i, v, "clash", 1.0) for i, v in rows], "case long, vec array<double>, id string, w double")
    return made.repartition(partitions) if rows else made


def blobs(seed=1, dims=3):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (n, dims)) for c, s, n in ((0, 0.3, 60), (4, 0.3, 80), (4.9, 0.08, 40), (9, 1.0, 50))]
    return np.vstack([*parts, rng.uniform(-6, 14, (40, dims))])


def reach(x, min_pts):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(min_pts, len(x) - 1)]
    return np.maximum(np.maximum(d, core[:, None]), core[None])


def parts_below(m, members, limit):
    """Components of ``members`` by pairs nearer than ``limit``."""
    left, out = set(members), []
    while left:
        part, edge = set(), [left.pop()]
        while edge:
            a = edge.pop()
            part.add(a)
            near = {b for b in left if m[a, b] < limit}
            left -= near
            edge += near
        out.append(part)
    return out


def brute(x, min_size, min_pts):
    """Clusters as sets of positions, top down over the lengths at which something changes."""
    m = reach(x, min_pts)
    levels = sorted({float(v) for v in m[np.triu_indices(len(x), 1)]}, reverse=True)

    def solve(members, birth, start):
        """Sum of the best stabilities and the clusters behind it, of one cluster that begins at density ``birth``."""
        total, size, now = 0.0, len(members), members
        for at in range(start, len(levels)):
            parts = parts_below(m, now, levels[at])
            if len(parts) == 1:
                continue
            density = 1 / max(levels[at], spanning.LEAST)
            big = [p for p in parts if len(p) >= min_size]
            if len(big) == 1:
                total += (len(now) - len(big[0])) * density
                now = big[0]
                continue
            total += len(now) * density
            stable = total - size * birth
            found = [solve(p, density, at + 1) for p in big]
            inner = sum(f[0] for f in found)
            if stable >= inner and birth is not None and birth > 0:
                return stable, [members]
            return inner, [c for f in found for c in f[1]]
        return 0.0, []

    return sorted(map(sorted, solve(set(range(len(x))), 0.0, 0)[1]))


def clusters(rows):
    out = {}
    for r in rows:
        if r.cluster >= 0:
            out.setdefault(r.cluster, []).append(r.case)
    assert [len(out[c]) for c in sorted(out)] == sorted(map(len, out.values()), reverse=True)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("how", [{}, {"k": 6, "tier_edges": 60, "whole": 0, "block_rows": 70, "hot_rows": 5_000}])
def test_density_tree_equals_brute_force(spark, how):
    x = blobs()
    want = brute(x, 15, 5)
    assert len(want) >= 3 and sum(map(len, want)) < len(x) - 10
    got = spanning.density_tree(frame(spark, list(enumerate(x.tolist()))), case_id="case", vector="vec", min_size=15, min_pts=5, **how)
    rows = got.collect()
    assert len(rows) == len(x) and clusters(rows) == want


def test_equal_vectors_and_unusable_rows(spark):
    x = np.vstack([np.zeros((30, 2)), np.full((25, 2), 5.0), np.random.default_rng(3).uniform(20, 90, (12, 2))])
    rows = [*enumerate(x.tolist()), (100, None), (101, [float("nan"), 1.0]), (None, [0.0, 0.0]), (0, [0.0, 0.0])]
    got = spanning.density_tree(frame(spark, rows), case_id="case", vector="vec", min_size=10, min_pts=3).collect()
    assert clusters(got) == brute(x, 10, 3) and clusters(got)[:2] == [list(range(30)), list(range(30, 55))]
    assert {r.case: r.cluster for r in got if r.case >= 100} == {100: -1, 101: -1}
    assert spanning.density_tree(frame(spark, []), case_id="case", vector="vec").collect() == []


def test_spanning_forest(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 300), rng.integers(0, 60, 300), rng.integers(0, 9, 300), strict=True)]
    edges += [(100, 101, 1.0), (101, 102, 2.0), (100, 102, 5.0), (7, 7, 0.0)]
    table = spark.createDataFrame(edges, "src long, dst long, w double")
    results = [sorted(map(tuple, spanning.spanning_forest(table, small=s).collect())) for s in (10_000, 5)]
    assert results[0] == results[1] and (100, 102, 5.0) not in results[0]
    assert sorted(r for r in results[0] if r[0] >= 100) == [(100, 101, 1.0), (101, 102, 2.0)]
    assert spanning.spanning_forest(table.limit(0)).collect() == []


def test_knn_graph(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1_500, 16))
    x[700:900] = x[5]  # many equal vectors
    graph = neighbours.knn_graph(frame(spark, list(enumerate(x.tolist()))), case_id="case", vector="vec", k=8, leaf=100, hot_rows=500)
    lists = {}
    for r in graph.orderBy("id", "rank").collect():
        assert abs(r.distance - np.linalg.norm(x[r.id] - x[r.neighbour])) < 1e-9 and r.id != r.neighbour
        lists.setdefault(r.id, []).append(r.distance)
    assert len(lists) == len(x) and all(len(v) == 8 and v == sorted(v) for v in lists.values())
    good = total = 0
    for i in range(0, len(x), 50):
        true = np.sort(np.linalg.norm(x - x[i], axis=1))[1:9]
        good += sum(d <= true[-1] + 1e-9 for d in lists[i])
        total += 8
    assert good / total >= 0.9


def test_small_graphs_are_exact(spark):
    x = blobs(5)[:120]
    graph = neighbours.knn_graph(frame(spark, list(enumerate(x.tolist()))), case_id="case", vector="vec", k=4).collect()
    d = np.linalg.norm(x[:, None] - x[None], axis=-1)
    np.fill_diagonal(d, np.inf)
    assert {(r.id, r.rank): r.neighbour for r in graph} == {(i, k + 1): int(j) for i in range(len(x)) for k, j in enumerate(np.argsort(d[i])[:4])}
    assert neighbours.knn_graph(frame(spark, [(1, [1.0])]), case_id="case", vector="vec").collect() == []


def test_flat_neighbours_are_exact(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.integers(0, 40, (1_500, 2)) * 1.0, [[9e5, 9e5]]])  # many equal lengths, and one far away
    graph = neighbours.knn_graph(frame(spark, list(enumerate(x.tolist()))), case_id="case", vector="vec", k=6, leaf=100)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1): int(j) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:6])}
    assert {(r.id, r.rank): r.neighbour for r in graph.collect()} == want
    points = spark.createDataFrame([(f"n{i:04d}", v) for i, v in enumerate(x.tolist())], "id string, v array<double>")
    found = cells.nearest_in_cells(points, len(x), 6, rows=90).collect()
    assert {(r.id, r.nb) for r in found} == {(f"n{i:04d}", f"n{j:04d}") for (i, _), j in want.items()}


@pytest.mark.parametrize("dims", [2, 6])
def test_tree_of_cells_is_least(spark, dims):
    x = blobs(4, dims)
    df = frame(spark, list(enumerate(x.tolist())))
    trees = [spanning.reachability_tree(df, case_id="case", vector="vec", min_pts=4, whole=w, block_rows=30, leaf=300)[1] for w in (0, 4_096)]
    a, b = (sorted(r.w for r in t.collect()) for t in trees)
    assert len(a) == len(x) - 1 and np.allclose(a, b, rtol=1e-12)


def test_far_cells_are_not_met(spark):
    """Of two places far apart only the edges that face each other meet."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.uniform(0, 10, (2_000, 2)), rng.uniform(0, 10, (2_000, 2)) + [40, 0]])
    rows = [(i, v, 0.0, int(i >= 2_000)) for i, v in enumerate(x.tolist())]
    points = cells.dealt(spark.createDataFrame(rows, "id long, v array<double>, core double, component long"), len(x), 100)
    asked = spanning._tightened(points.withColumn("radius", F.lit(0.0)).withColumn("bound", F.lit(float("inf"))), points, 2)
    met = cells.meetings(asked, points, 2, own=True).applyInArrow(
        lambda a, b: pa.table({"n": pa.array([len(a) * len(b)], pa.int64())}), "n long").agg(F.sum("n")).first()[0]
    assert met < 0.02 * 2 * 2_000 ** 2
    edges = cells.meetings(asked, points, 2, own=True).applyInArrow(spanning._closest, spanning._EDGE)
    d = np.sqrt(((x[:2_000, None] - x[None, 2_000:]) ** 2).sum(-1))
    i, j = np.unravel_index(d.argmin(), d.shape)
    assert edges.orderBy("w").first()[2:] == (d[i, j], i, j + 2_000)


@pytest.mark.parametrize("kind", ["blobs", "ties"])
def test_flat_vectors_need_no_rounds_over_all_points(spark, monkeypatch, kind):
    """Cells and groups of cells settle most by themselves; one task, and components by name, do the rest."""
    rng = np.random.default_rng(12)
    if kind == "blobs":
        x = np.vstack([rng.normal(c, s, (n, 2)) for c, s, n in ((0, 1.0, 900), (9, 0.4, 500), (13, 2.0, 300))] + [rng.uniform(-30, 40, (60, 2)), [[900.0, 900.0]]])
    else:  # many equal lengths, and more equal vectors than are listed
        x = np.vstack([rng.integers(0, 25, (900, 2)), rng.integers(0, 15, (500, 2)) + [60, 0], np.full((80, 2), 40.0), [[500.0, 0.0]]]).astype(float)
    df = frame(spark, list(enumerate(x.tolist())))
    options = {"case_id": "case", "vector": "vec", "min_pts": 4}

    def result(**how):
        if kind == "blobs":
            return clusters(spanning.density_tree(df, min_size=20, tier_edges=2_000, **options, **how).collect())
        return [round(w, 9) for w in sorted(r.w for r in spanning.reachability_tree(df, **options, **how)[1].collect())]

    want = result()
    monkeypatch.setattr(spanning, "components", None)
    monkeypatch.setattr(spanning, "_boruvka", None)
    monkeypatch.setattr(spanning, "GROUP", 400)
    assert len(want) >= 2 and result(whole=0, block_rows=100) == want


def test_groups_of_cells_merge_as_the_whole(spark):
    """Merging by groups first leaves the same clusters, with edges that lie in two groups and of one length."""
    rng = np.random.default_rng(5)
    n, w = 800, rng.integers(1, 60, 799) / 10
    rows = [(i, int(rng.integers(max(0, i - 30), i)), float(w[i - 1])) for i in range(1, n)]
    plain = spark.createDataFrame(rows, "src long, dst long, w double")
    ids = spark.range(n).select("id")
    want = spanning.condensed_clusters(ids, plain, min_size=12).collect()
    cell = lambda c: F.floor(F.col(c) / 100).cast("long")
    got = spanning.condensed_clusters(ids.withColumn("cell", cell("id")), plain.withColumn("sc", cell("src")).withColumn("dc", cell("dst")),
                                      min_size=12, tier_edges=200, depth=3).collect()

    def sets(found):
        out = {}
        for r in found:
            out.setdefault(r.cluster, set()).add(r.id)
        return out.pop(None, set()), sorted(map(sorted, out.values()))

    assert len({r.cluster for r in want}) > 2 and sets(got) == sets(want)
