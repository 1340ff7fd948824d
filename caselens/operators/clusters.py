"""Density clusters with noise, their names, terms and stability."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.text import trim_ws
from caselens.operators.graph import components
from caselens.operators.infer import Generate, generate, render_numbered
from caselens.operators.joins import numbered, salted_lookup
from caselens.operators.sampling import sample_per_group
from caselens.runtime import broadcast_if_small, materialize


def touching(cells: DataFrame, *, dims: int) -> DataFrame:
    """``(src, dst)`` nodes of cells of one level whose cubes share a corner."""
    half = [s for s in itertools.product((-1, 0, 1), repeat=dims) if s > (0,) * dims]
    steps = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in s]) for s in half])
    moved = (cells.select("level", F.col("node").alias("src"), "cube", F.explode(steps).alias("step"))
             .select("level", "src", F.zip_with("cube", "step", lambda a, b: a + b).alias("cube")))
    return (moved.join(cells.select("level", "cube", F.col("node").alias("dst")), ["level", "cube"])
            .select("src", "dst"))


def density_clusters(
    df: DataFrame,
    *,
    case_id: str,
    vector: str,
    cell: float,
    dims: int = 5,
    min_pts: int = 5,
    min_size: int = 30,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """``(case_id, cluster)``; -1 is noise, 0 the largest cluster.

    Space is cut into cubes of side ``cell``. A cube with ``min_pts`` vectors is
    dense, dense cubes that touch (corners included) belong together, and groups
    with fewer than ``min_size`` vectors are noise. Vectors meet only as counts
    per cube, so no pairs are formed however crowded a cube is; the links are
    between cubes. Meant for reduced vectors: a cube has 3**dims - 1 neighbours.
    """
    corner = F.transform(F.slice(vector, 1, dims), lambda x: F.floor(x.cast("double") / cell))
    points = materialize(df.select(F.col(case_id).alias("id"), corner.alias("cube")), "cubes")
    dense = materialize(
        points.groupBy("cube").agg(F.count("*").alias("n"), F.min("id").alias("cube_id"))
        .where(F.col("n") >= min_pts), "dense")

    links = touching(dense.select(F.lit(0).alias("level"), "cube", F.col("cube_id").alias("node")), dims=dims)
    roots = dense.join(
        components(links, hot_rows=hot_rows).withColumnRenamed("id", "cube_id"), "cube_id", "left")
    roots = materialize(roots.select("cube", "n", F.coalesce("component", "cube_id").alias("root")), "roots")
    sizes = roots.groupBy("root").agg(F.sum("n").alias("size")).where(F.col("size") >= min_size)
    numbers = numbered(sizes, F.desc("size"), F.col("root"), output="cluster").select("root", "cluster")
    named = salted_lookup(
        roots, numbers, key="root", spread_by=["cube"], hot_rows=hot_rows, n_facts=roots.count()).select("cube", "cluster")
    return (salted_lookup(points, named, key="cube", spread_by=["id"], how="left", hot_rows=hot_rows)
            .select(F.col("id").alias(case_id), F.coalesce("cluster", F.lit(-1)).alias("cluster")))


def cluster_count(df: DataFrame, *, cluster: str = "cluster") -> DataFrame:
    """Number of clusters without noise, and of distinct values with it."""
    return df.groupBy(cluster).agg(F.count("*").alias("n")).agg(
        F.count_if(F.col(cluster) != -1).alias("n_clusters"),
        F.count("*").alias("n_values"))


def label_list(df: DataFrame, *, label: str) -> DataFrame:
    """Distinct labels in order, with their number of cases."""
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(label)


def noise_report(df: DataFrame, *, case_id: str, cluster: str = "cluster", examples: int = 5) -> DataFrame:
    """Size and share of the noise, with the least keys as examples."""
    is_noise = F.col(cluster) == -1
    totals = df.agg(F.count("*").alias("n_rows"), F.count_if(is_noise).alias("n_noise"))
    least = df.where(is_noise).orderBy(case_id).limit(examples).agg(
        F.array_sort(F.collect_list(case_id)).alias("examples"))
    return totals.select(
        "n_rows", "n_noise",
        (F.col("n_noise") / F.col("n_rows")).alias("noise_share"),
        least.scalar().alias("examples"))


def label_clusters(
    df: DataFrame, labels: DataFrame, *, cluster: str = "cluster", label: str = "label",
    noise_label: str = rules.NOISE_LABEL, max_broadcast: int = 200_000,
) -> DataFrame:
    """Attach cluster labels; clusters without one (noise) get ``noise_label``.

    The labels are written first: a model that names them is asked once.
    """
    stored = materialize(labels.select(cluster, label), "labels")
    return (df.join(broadcast_if_small(stored, max_broadcast), cluster, "left")
            .na.fill(noise_label, [label]))


def name_clusters(
    df: DataFrame,
    *,
    case_id: str,
    cluster: str,
    text: str,
    factory: Callable[[], Generate],
    instruction: str = "State the shared main issue of these complaints in 3 to 8 words.",
    cue: str = "Theme:",
    n_samples: int = 5,
    seed: str = "0",
) -> DataFrame:
    """``(cluster, label)`` from up to n sample texts per cluster, noise left out.

    The reply counts from behind the last cue. A cluster without text, or whose
    call failed, is ``Unknown``.
    """
    clusters = df.where(F.col(cluster) != -1).select(cluster).distinct()
    texts = df.where((F.col(cluster) != -1) & F.col(text).isNotNull())
    sampled = (sample_per_group(texts, by=cluster, case_id=case_id, n=n_samples, seed=seed)
               .groupBy(cluster)
               .agg(F.array_sort(F.collect_list(F.struct("sample_rank", text))).alias("_rows"))
               .select(cluster, render_numbered(instruction, F.col(f"_rows.{text}"), cue).alias("_prompt")))
    replies = generate(sampled, case_id=cluster, prompt="_prompt", factory=factory, max_attempts=1)
    label = trim_ws(F.substring_index("output", cue, -1)) if cue else trim_ws("output")
    named = replies.where("status in ('ok', 'empty')").select(cluster, label.alias("label"))
    return clusters.join(named, cluster, "left").na.fill(rules.UNKNOWN_LABEL, ["label"])


def class_terms(df: DataFrame, *, by: str, text: str, k: int = 10) -> DataFrame:
    """The k terms that set each class apart: class-based tf-idf.

    tf = share of the term in its class; idf = ln(1 + mean class size / count of
    the term). Stands in for model-written names where there is no model.
    """
    term = F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    per_class = materialize(
        df.where(F.col(by).isNotNull()).select(by, term.alias("term")).where("term <> ''")
        .groupBy(by, "term").agg(F.count("*").alias("n")), "terms")
    classes = per_class.groupBy(by).agg(F.sum("n").alias("class_n"))
    mean_n = classes.agg(F.avg("class_n")).scalar()
    terms = per_class.groupBy("term").agg(F.sum("n").alias("term_n"))
    named = salted_lookup(per_class, terms, key="term", spread_by=[by])
    scored = (named.join(broadcast_if_small(classes), by)
              .withColumn("score", F.col("n") / F.col("class_n") * F.log(1 + mean_n / F.col("term_n"))))
    order = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), "term")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(by, "rank", "term", "n", "score"))


def stability(df: DataFrame, *, first: str, second: str) -> DataFrame:
    """Adjusted Rand index of two labelings, one row; 1 means the same partition."""
    cells = df.groupBy(first, second).agg(F.count("*").cast("double").alias("n"))

    def pairs(c: str):
        return F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0.0))

    total = cells.agg(F.sum("n").alias("n"), pairs("n").alias("same_pairs"))
    rows = cells.groupBy(first).agg(F.sum("n").alias("m")).agg(pairs("m")).scalar()
    cols = cells.groupBy(second).agg(F.sum("n").alias("m")).agg(pairs("m")).scalar()
    expected = F.col("first_pairs") * F.col("second_pairs") / (F.col("n") * (F.col("n") - 1) / 2)
    top = (F.col("first_pairs") + F.col("second_pairs")) / 2
    return (total
            .select("n", "same_pairs", rows.alias("first_pairs"), cols.alias("second_pairs"))
            .withColumn("expected", F.when(F.col("n") > 1, expected))
            .select(
                F.col("n").cast("bigint").alias("n_rows"), "same_pairs", "first_pairs", "second_pairs",
                F.when(top == F.col("expected"), F.lit(1.0))
                .otherwise((F.col("same_pairs") - F.col("expected")) / (top - F.col("expected")))
                .alias("adjusted_rand")))
