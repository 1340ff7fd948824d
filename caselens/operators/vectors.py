"""Embedding, reduction and nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, IDF, Normalizer, PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.functions.text import words
from caselens.runtime import small_enough

Encode = Callable[[list[str]], list[list[float]]]

#: Batches of the encoder that are sent on together.
ENCODED = 8
#: Scores that are held at once.
SCORES = 1 << 20
#: Rows of a side that meet the other side's in one task; queries of them that are scored together; parts that smaller sides
#: are cut into for the sake of the cores.
TILE_ROWS, TILE_QUERIES, TILE_PARTS = 20_000, 2_000, 8


def encode(
    df: DataFrame, *, case_id: str, text: str, factory: Callable[[], Encode], batch_size: int = 64,
) -> DataFrame:
    """``(case_id, embedding)`` from a caller's encoder, built once per partition."""
    key_type = df.schema[case_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for pdf in batches:
            texts = pdf["_text"].tolist()
            found: list = []
            for start in range(0, len(texts), batch_size):
                found.extend(encoder(texts[start:start + batch_size]))
            yield pd.DataFrame({case_id: pdf[case_id], "embedding": [list(map(float, v)) for v in found]})

    return (df.where(F.col(text).isNotNull()).select(case_id, F.col(text).alias("_text"))
            .mapInPandas(run, f"`{case_id}` {key_type}, embedding array<float>"))


def fit_text_encoder(df: DataFrame, *, text: str, dims: int = 256) -> PipelineModel:
    """Offline stand-in for a sentence encoder: hashed tf-idf of unit length."""
    tokens = df.where(F.col(text).isNotNull()).select(words(F.lower(text)).alias("_tokens"))
    return Pipeline(stages=[
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]).fit(tokens)


def encode_text(model: PipelineModel, df: DataFrame, *, text: str, output: str = "embedding") -> DataFrame:
    tokens = df.withColumn("_tokens", words(F.lower(F.coalesce(text, F.lit("")))))
    return (model.transform(tokens).withColumn(output, vector_to_array("_unit", "float32"))
            .drop("_tokens", "_tf", "_tfidf", "_unit"))


def encode_with(
    encoder: PipelineModel | Callable[[], Encode], df: DataFrame, *, text: str, output: str = "embedding", batch_size: int = 64,
) -> DataFrame:
    """Add the embedding of a text by a fitted pipeline or by the caller's encoder; null texts count as empty.

    Rows are embedded where they lie, with all their columns.
    """
    if isinstance(encoder, PipelineModel):
        return encode_text(encoder, df, text=text, output=output)
    rows = df.drop(output)
    shape = T.StructType([T.StructField("row", rows.schema), T.StructField(output, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for batch in batches:
            # Texts become strings a few at a time, not a whole batch of Spark's.
            for start in range(0, len(batch), batch_size * ENCODED):
                row = batch.column(0).slice(start, batch_size * ENCODED)
                column, found = row.field(row.type.get_field_index(text)), []
                for i in range(0, len(row), batch_size):
                    texts = [t or "" for t in column.slice(i, batch_size).to_pylist()]
                    found += [np.fromiter(map(float, v), np.float32) for v in model(texts)]
                yield pa.RecordBatch.from_arrays([row, pa.array(found, pa.list_(pa.float32()))], ["row", output])

    return rows.select(F.struct("*").alias("row")).mapInArrow(run, shape).select("row.*", output)


def reduce_dims(df: DataFrame, *, vector: str, k: int = 5, output: str = "reduced") -> DataFrame:
    """Linear reduction to k dimensions (principal components).

    The fit keeps one square matrix of the vector's width on the driver; its
    size does not depend on the number of rows.
    """
    held = df.withColumn("_v", array_to_vector(vector))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(held)
    return model.transform(held).withColumn(output, vector_to_array("_p")).drop("_v", "_p")


def kmeans(df: DataFrame, *, vector: str, k: int, seed: int = 42, output: str = "cluster") -> DataFrame:
    held = df.withColumn("_v", array_to_vector(vector))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=output).fit(held)
    return model.transform(held).drop("_v")


def _unit(rows) -> np.ndarray:
    m = np.concatenate(list(rows)).astype(np.float64).reshape(len(rows), -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1.0, length)


class _Best:
    """The k best base rows of each query so far, ties to the lesser key.

    Products in single precision find the rows that may be among the best; only
    those are scored exactly. The margin covers the rounding of the products.
    """

    def __init__(self, query_ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = query_ids, q, k
        self.rough_q = q.astype(np.float32)
        self.margin = 2 * (q.shape[1] * 1.2e-7 + 1e-6)
        self.bound = np.full(len(q), -np.inf, dtype=np.float32)
        self.found: list[pd.DataFrame] = []
        self.n_found = 0

    def add(self, base_ids: np.ndarray, b: np.ndarray) -> _Best:
        step = max(64, SCORES // len(self.q))  # bounds the score matrix
        for start in range(0, len(b), step):
            part = b[start:start + step]
            rough = self.rough_q @ part.astype(np.float32).T
            if np.isneginf(self.bound).any() and len(part) > self.k:
                slice_bound = -np.partition(-rough, self.k - 1, axis=1)[:, self.k - 1] - self.margin
                self.bound = np.maximum(self.bound, slice_bound)
            rows, cols = np.nonzero(rough >= self.bound[:, None])
            score = np.round(np.einsum("ij,ij->i", self.q[rows], part[cols]), 12)
            self.found.append(pd.DataFrame({
                "query_id": self.ids[rows], "base_id": base_ids[start + cols], "score": score, "at": rows}))
            self.n_found += len(rows)
            if self.n_found > 8 * self.k * len(self.q) + 100_000:
                self._shrink()
        return self

    def _shrink(self) -> None:
        kept = _trim(pd.concat(self.found, ignore_index=True), self.k)
        worst = kept.groupby("at")["score"].agg(["min", "size"])
        full = worst[worst["size"] == self.k]
        self.bound[full.index] = np.maximum(self.bound[full.index], full["min"].to_numpy() - self.margin)
        self.found, self.n_found = [kept], 0

    def result(self) -> pd.DataFrame:
        self._shrink()
        return self.found[0].drop(columns="at")


def _trim(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    hits = hits.sort_values(["query_id", "score", "base_id"], ascending=[True, False, True], kind="stable")
    return hits.groupby("query_id", sort=False).head(k)


def _merged(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "base_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _names(queries: DataFrame, base: DataFrame, query_id: str, base_id: str) -> str:
    q, b = (t.schema[c].dataType.simpleString() for t, c in ((queries, query_id), (base, base_id)))
    return f"query_id {q}, base_id {b}, score double"


def top_k(
    queries: DataFrame,
    base: DataFrame,
    *,
    query_id: str,
    base_id: str,
    vector: str,
    k: int = 5,
    max_queries: int = 4096,
    block_rows: int = 20_000,
    exclude_self: bool = False,
) -> DataFrame:
    """Exact ``(query_id, base_id, score, rank)`` by cosine similarity.

    Up to ``max_queries`` queries go to every task as one matrix; the base is
    scanned once where it lies, and each task sends on only its k best rows per
    query. More queries than that are matched block by block: every pair of a
    query block and a base block is one task of bounded size.
    """
    wanted = k + 1 if exclude_self else k
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("v"))
    b = base.select(F.col(base_id).alias("base_id"), F.col(vector).alias("v"))
    schema = _names(queries, base, query_id, base_id)
    held = q.limit(max_queries + 1).collect()
    if len(held) <= max_queries:
        partial = _scan(b, held, wanted, schema)
    else:
        one = F.lit(0).alias("cell")
        partial = _blocks(q.select("*", one), b.select("*", one), wanted, block_rows, schema)
    if exclude_self:
        partial = partial.where("query_id <> base_id")
    return _merged(partial, k)


def _scan(base: DataFrame, held: list, k: int, schema: str) -> DataFrame:
    if not held:
        return base.sparkSession.createDataFrame([], schema)
    shared = base.sparkSession.sparkContext.broadcast(
        (np.asarray([r["query_id"] for r in held]), _unit([r["v"] for r in held])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            if len(pdf):
                best = best or _Best(*shared.value, k)
                best.add(pdf["base_id"].to_numpy(), _unit(pdf["v"]))
        if best:
            yield best.result()

    return base.mapInPandas(run, schema)


def _blocks(queries: DataFrame, base: DataFrame, k: int, block_rows: int, schema: str) -> DataFrame:
    """Match every query with the base rows of its cell.

    Cells are cut into tiles of queries and of base rows by a hash of the key;
    each pair of tiles is one task, however full a cell is. A tile holds about
    ``block_rows`` rows, more (``TILE_ROWS``) where that makes over
    ``TILE_PARTS`` of them, as every row goes to each tile of the other side.
    A task scores at most ``block_rows`` queries together.
    """
    together = min(block_rows, TILE_QUERIES)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        few, many = (F.ceil(F.count("*") / rows) for rows in (max(block_rows, TILE_ROWS), block_rows))
        return df.groupBy("cell").agg(F.greatest(few, F.least(many, F.lit(TILE_PARTS))).cast("int").alias(name))

    # One row per cell; cells that only one side has match nothing.
    sizes = F.broadcast(blocks(queries, "n_q").join(blocks(base, "n_b"), "cell"))

    def place(key: str, n: str):
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    group = ["cell", "qb", "bb"]
    left = queries.join(sizes, "cell").select(
        "query_id", "v", "cell", place("query_id", "n_q").alias("qb"), every("n_b").alias("bb"))
    right = base.join(sizes, "cell").select(
        "base_id", "v", "cell", place("base_id", "n_b").alias("bb"), every("n_q").alias("qb"))

    def match(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or bs.empty:
            return pd.DataFrame({"query_id": qs["query_id"][:0], "base_id": bs["base_id"][:0], "score": []})
        ids, q, base_ids, b = qs["query_id"].to_numpy(), _unit(qs["v"]), bs["base_id"].to_numpy(), _unit(bs["v"])
        parts = [slice(at, at + together) for at in range(0, len(q), together)]
        return pd.concat([_Best(ids[part], q[part], k).add(base_ids, b).result() for part in parts], ignore_index=True)

    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(match, schema)


def coarse_cells(
    base: DataFrame, *, vector: str, cells: int, seed: int = 42, max_iter: int = 10,
) -> tuple[DataFrame, list[list[float]]]:
    """Give every vector its nearest of ``cells`` centres; also return the centres.

    Stored with ``write_table(..., partition_by=["cell"])`` the result is an
    index whose cells ``top_k_probed`` reads one by one.
    """
    held = base.withColumn("_v", array_to_vector(vector))
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="cell").fit(held)
    return model.transform(held).drop("_v"), [c.tolist() for c in model.clusterCenters()]


def assign_cells(df: DataFrame, centres: list[list[float]], *, vector: str) -> DataFrame:
    """Give every vector its nearest centre as ``cell``, for appending to an index."""
    apart = F.array(*[F.aggregate(
        F.zip_with(vector, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
        for c in centres])
    return df.withColumn("_apart", apart).withColumn(
        "cell", (F.array_position("_apart", F.array_min("_apart")) - 1).cast("int")).drop("_apart")


class Cells(list):
    """Centres of an index by cell, and how many cells a query has to read, as ``calibrate_probes`` measured it."""

    def __init__(self, centres: list[list[float]], probes: int | None = None):
        super().__init__(centres)
        self.probes = probes


def calibrate_probes(
    sample: DataFrame, index: DataFrame, centres: list[list[float]], *, query_id: str, base_id: str, vector: str,
    k: int = 5, recall: float = 0.9, exclude_self: bool = False, max_queries: int = 4096,
) -> int:
    """The least number of cells in which ``recall`` of the exact k nearest of ``sample`` lie.

    ``sample`` holds at most ``max_queries`` queries. One exact search and one
    lookup of the cells of its hits tell the recall of every number of probes.
    """
    if not small_enough(sample, max_queries):
        raise ValueError(f"the sample has over {max_queries} queries")
    exact = top_k(sample, index, query_id=query_id, base_id=base_id, vector=vector, k=k, exclude_self=exclude_self,
                  max_queries=max_queries)
    lying = index.select(F.col(base_id).alias("base_id"), "cell").join(F.broadcast(exact), "base_id")
    hits = lying.select("query_id", "cell").collect()
    if not hits:
        return len(centres)
    asked = sample.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).collect()
    near = _nearest_cells(_unit([r["v"] for r in asked]), np.asarray(centres), len(centres))
    place = {r["q"]: np.argsort(cells) for r, cells in zip(asked, near)}
    depth = np.sort([place[h["query_id"]][h["cell"]] for h in hits])
    return int(depth[int(np.ceil(recall * len(depth))) - 1]) + 1


def _nearest_cells(unit: np.ndarray, centre: np.ndarray, probes: int) -> np.ndarray:
    distance = (unit ** 2).sum(axis=1)[:, None] - 2 * unit @ centre.T + (centre ** 2).sum(axis=1)
    return np.argsort(distance, axis=1, kind="stable")[:, :probes]


def top_k_probed(
    queries: DataFrame,
    index: DataFrame,
    centres: list[list[float]],
    *,
    query_id: str,
    base_id: str,
    vector: str,
    k: int = 5,
    probes: int | None = None,
    max_queries: int = 4096,
    block_rows: int = 20_000,
) -> DataFrame:
    """Approximate top k: each query looks at its ``probes`` nearest cells only.

    Without ``probes`` as many as were measured for ``centres`` (``Cells``), all
    where none were.

    With the index stored by ``cell`` the other cells' files are not read, and a
    large cell needs no special care: its rows stay spread over their files.
    More than ``max_queries`` queries are matched block by block in each cell.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("v"))
    b = index.select(F.col(base_id).alias("base_id"), F.col(vector).alias("v"), "cell")
    schema = _names(queries, index, query_id, base_id)
    probes = probes or getattr(centres, "probes", None) or len(centres)
    centre = np.asarray(centres)
    held = q.limit(max_queries + 1).collect()
    if not held:
        return _merged(index.sparkSession.createDataFrame([], schema), k)
    if len(held) > max_queries:
        key_type = queries.schema[query_id].dataType.simpleString()
        vector_type = queries.schema[vector].dataType.simpleString()

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(cell=list(_nearest_cells(_unit(pdf["v"]), centre, probes)))

        near = q.mapInPandas(assign, f"query_id {key_type}, v {vector_type}, cell array<int>")
        asked = near.withColumn("cell", F.explode("cell"))
        return _merged(_blocks(asked, b, k, block_rows, schema), k)

    unit = _unit([r["v"] for r in held])
    asked = np.zeros((len(held), len(centre)), dtype=bool)
    np.put_along_axis(asked, _nearest_cells(unit, centre, probes), True, axis=1)
    shared = index.sparkSession.sparkContext.broadcast(
        (np.asarray([r["query_id"] for r in held]), unit, asked))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, qm, wanted = shared.value
        best: dict[int, _Best] = {}
        for pdf in batches:
            for cell, rows in pdf.groupby("cell"):
                who = wanted[:, cell]
                if cell not in best:
                    best[cell] = _Best(ids[who], qm[who], k)
                best[cell].add(rows["base_id"].to_numpy(), _unit(rows["v"]))
        for part in best.values():
            yield part.result()

    probed = [int(c) for c in np.flatnonzero(asked.any(axis=0))]
    return _merged(b.where(F.col("cell").isin(probed)).mapInPandas(run, schema), k)


def recall(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found."""
    pair = ["query_id", "base_id"]
    found = exact.select(*pair).join(approx.select(*pair, F.lit(1).alias("hit")), pair, "left")
    return found.agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"),
                     (F.count("hit") / F.count("*")).alias("recall"))
