"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond", 2014. Every
step is a grouped minimum (combined map-side) and a key lookup with hot nodes
split, so a hub with a third of all edges is not one task. Before the steps,
tasks join the links of one range of nodes each, and nodes that then hang on one
other node only are set aside; what is left are the links between ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.operators.joins import salted_lookup
from caselens.runtime import materialize, unsent


def _large_star(edges: DataFrame, **split) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour."""
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = (edges.unionByName(up).groupBy("u").agg(F.min("v").alias("m"))
             .select("u", F.least("u", "m").alias("m")))
    return (salted_lookup(up, least, key="u", spread_by=["v"], grows=True, **split)
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame, **split) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (salted_lookup(edges, least, key="u", spread_by=["v"], grows=True, **split)
             .where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 65_521)).first()
    return tuple(row)


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of one task's links, each with the least one that they connect it with."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for edges in batches:
        for u, v in zip(edges["u"].tolist(), edges["v"].tolist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    yield pd.DataFrame({"id": list(parent), "component": [root(x) for x in parent]})


def _contracted(edges: DataFrame, n: int, task_rows: int, shape: T.StructType) -> tuple[DataFrame, DataFrame]:
    """``(hung, edges)``: nodes that hang on one other node only, with it as ``root``, and the links of all others.

    A task joins the links of one range of nodes, ``task_rows`` of them; the
    links of a hub fall into several ranges. Its stars connect what its links
    connected.
    """
    ranged = edges.repartitionByRange(max(1, -(-n // task_rows)), "u", "v")
    stars = materialize(ranged.mapInPandas(_in_one_task, shape).where("id <> component")
                        .select(F.col("id").alias("u"), F.col("component").alias("v")), "edges")
    up = stars.select(F.col("u").alias("id"), F.col("v").alias("root"))
    down = stars.select(F.col("v").alias("id"), F.lit(None).cast(shape["id"].dataType).alias("root"))
    nodes = materialize(up.unionByName(down).groupBy("id").agg(
        F.min("root").alias("root"), F.count("root").alias("up"), F.count_if(F.col("root").isNull()).alias("down")), "nodes")
    hangs = (F.col("up") == 1) & (F.col("down") == 0)
    # A node has no more rows here than there are tasks.
    others = nodes.where((F.col("up") > 0) & ~hangs).select(F.col("id").alias("u"))
    return nodes.where(hangs).select("id", "root"), materialize(stars.join(unsent(others), "u", "left_semi"), "edges")


def _with_hung(members: DataFrame, hung: DataFrame, hot_rows: int) -> DataFrame:
    """``members``, the nodes that hang on others, and those others where nothing else links them."""
    members = materialize(members, "members")
    found = salted_lookup(hung, members.withColumnRenamed("id", "root"), key="root", spread_by=["id"], how="left", hot_rows=hot_rows, grows=True)
    found = found.select("id", F.coalesce("component", "root").alias("component"))
    alone = hung.select(F.col("root").alias("id")).distinct().join(unsent(members), "id", "left_anti")
    return members.unionByName(found).unionByName(alone.withColumn("component", F.col("id")))


def components(
    edges: DataFrame, *, src: str = "src", dst: str = "dst", max_rounds: int = 100, hot_rows: int = 1_000_000,
    one_task: int = 1 << 16, task_rows: int = 1 << 17,
) -> DataFrame:
    """``(id, component)`` of every node with an edge; the component is its least id.

    Up to ``one_task`` links between whole numbers or texts are joined in one
    task, as a round costs more than they do; of more, tasks of ``task_rows``
    links each join what they hold as long as that halves the links. The rows
    are the same either way.
    """
    stars = materialize(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where("u <> v").distinct(), "edges")
    mark = _mark(stars)
    kind = stars.schema["u"].dataType
    shape = T.StructType([T.StructField("id", kind), T.StructField("component", kind)])
    plain = isinstance(kind, (T.IntegralType, T.StringType))
    aside, halved = [], plain
    while halved and mark[0] > one_task:
        hung, stars = _contracted(stars, mark[0], task_rows, shape)
        aside.append(hung)
        before, mark = mark, _mark(stars)
        halved = 2 * mark[0] <= before[0]
    members = _settled(stars, mark, shape, plain and mark[0] <= one_task, max_rounds, hot_rows)
    for hung in reversed(aside):
        members = _with_hung(members, hung, hot_rows)
    return members


def _settled(stars: DataFrame, mark: tuple, shape: T.StructType, in_one_task: bool, max_rounds: int, hot_rows: int) -> DataFrame:
    """The components of links ``u > v``: by one task, or by rounds of stars."""
    if mark[0] and in_one_task:
        return materialize(stars.coalesce(1).mapInPandas(_in_one_task, shape), "members")
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        # A step never adds edges, so their number bounds the rows of every lookup.
        split = {"hot_rows": hot_rows, "n_facts": mark[0]}
        stars = materialize(_small_star(_large_star(stars, **split), **split), "edges")
        before, mark = mark, _mark(stars)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    members = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
