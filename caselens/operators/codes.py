"""Nearest neighbours by short codes, with exact scores at the end.

An index holds every vector as the number of its cell and a product-quantised
code of what the cell's centre leaves (Jegou et al., "Product quantization for
nearest neighbor search", 2011): a few bytes that a search reads instead of the
vector. Scores from codes pick a short list per query, and only the rows on it
are read and scored exactly. How many cells a query looks into and how long the
list is follows from the recall that is asked for, measured against exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselens.operators import vectors
from caselens.operators.joins import salted_lookup
from caselens.operators.neighbours import _vectors, usable
from caselens.runtime import materialize


#: Estimated scores that are held at once.
GUESSES = 1 << 21
#: Vectors of queries are sent to every executor up to this size.
QUERY_BYTES = 32 << 20


@dataclass(frozen=True)
class Codes:
    """Centres of cells, and per part of the dimensions the values that a code stands for."""

    centres: np.ndarray  # cells x width
    books: np.ndarray    # parts x levels x width of a part
    probes: int          # cells that a query looks into
    shortlist: int       # rows that are scored exactly

    @property
    def wide(self) -> int:
        return self.centres.shape[1]

    def parted(self, rows: np.ndarray) -> np.ndarray:
        """Rows cut into parts; the last one is filled up with 0."""
        parts, _, size = self.books.shape
        full = np.zeros((len(rows), parts * size))
        full[:, :rows.shape[1]] = rows
        return full.reshape(len(rows), parts, size)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each row."""
        cell = _assign(unit, self.centres)
        rest = self.parted(unit - self.centres[cell])
        code = np.stack([_assign(rest[:, p], book) for p, book in enumerate(self.books)], axis=1)
        return cell, code.astype(np.uint8)

    def scores(self, queries: np.ndarray, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Estimated inner product of every query and every coded row."""
        out = (queries @ self.centres.T)[:, cell]
        tables = np.einsum("qps,pls->qpl", self.parted(queries), self.books)
        for p in range(len(self.books)):
            out += tables[:, p][:, code[:, p]]
        return out

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Rank of every cell for every query, nearest first."""
        return np.argsort(np.argsort(-(queries @ self.centres.T), axis=1, kind="stable"), axis=1, kind="stable")


def _assign(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), 8_192):
        part = rows[at:at + 8_192]
        out[at:at + 8_192] = np.argmin((centres ** 2).sum(1) - 2 * part @ centres.T, axis=1)
    return out


def _centres(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from random rows; a centre without rows moves to a random one."""
    k = max(1, min(k, len(rows)))
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        near = _assign(rows, centres)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], rows[rng.integers(0, len(rows), k)])
    return centres


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1.0, length)


def fit(df: DataFrame, *, case_id: str, vector: str, cells: int = 64, parts: int = 8, levels: int = 256, sample: int = 20_000,
        seed: int = 5) -> Codes | None:
    """Centres and code books from up to ``sample`` rows, those with the least hash of their id; None without usable rows.

    The sample bounds what the driver holds; it steers how well codes fit, not
    which rows are indexed. A fit looks into all cells and scores ten rows per
    hit until ``calibrate`` says better.
    """
    rows = usable(df, case_id=case_id, vector=vector)
    found = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    if not len(found):
        return None
    rng = np.random.default_rng(seed)
    unit = _unit(_vectors(found["v"]))
    centres = _centres(unit, cells, rng)
    parts = min(parts, unit.shape[1])
    size = -(-unit.shape[1] // parts)
    empty = Codes(centres, np.zeros((parts, 1, size)), len(centres), 0)
    rest = empty.parted(unit - centres[_assign(unit, centres)])
    books = [_centres(rest[:, p], min(levels, 256), rng) for p in range(parts)]
    return replace(empty, books=np.stack(books))


def build(df: DataFrame, codes: Codes, *, case_id: str, vector: str) -> DataFrame:
    """``id, v, cell, code``: every usable row. Written with ``partition_by=["cell"]``, a search reads its cells only."""
    rows = usable(df, case_id=case_id, vector=vector)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cell, code = codes.encode(_unit(_vectors(batch.column(1))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())],
                    ["id", "v", "cell", "code"])

    return rows.mapInArrow(run, f"id {kind}, v array<double>, cell int, code binary")


def _codes_of(column: pa.ChunkedArray | pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def _listed(codes: Codes, keep: int):
    """The ``keep`` best rows by code of each query, among the cells it looks into."""
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(queries) and len(rows):
            q, cell, code = _unit(_vectors(queries["v"])), rows["cell"].to_numpy(), _codes_of(rows["code"], len(codes.books))
            rank = codes.order(q)
            # A few queries against all rows of the block, so that a query's best are picked once.
            step = max(1, GUESSES // len(cell))
            for at in range(0, len(q), step):
                part = slice(at, at + step)
                guess = np.where(rank[part][:, cell] < codes.probes, codes.scores(q[part], cell, code), -np.inf)
                if guess.shape[1] > keep:
                    best = np.argpartition(-guess, keep - 1, axis=1)[:, :keep]
                    a, b = np.repeat(np.arange(len(guess)), keep), best.ravel()
                else:
                    a, b = (x.ravel() for x in np.indices(guess.shape))
                s = guess[a, b]
                good = np.isfinite(s)
                found.append((at + a[good], b[good], s[good]))
        i, j, score = (np.concatenate(column) for column in zip(*found, strict=True))
        return pa.table({"query_id": queries["query_id"].take(pa.array(i)), "base_id": rows["id"].take(pa.array(j)), "guess": score})
    return run


def search(
    queries: DataFrame, index: DataFrame, codes: Codes, *, query_id: str, vector: str, k: int = 5, exclude_self: bool = False,
    query_rows: int = 4_096, block_rows: int = 65_536, hot_rows: int = 1_000_000, listed_rows: int = 2_000_000,
) -> DataFrame:
    """``query_id, base_id, score, rank`` by cosine similarity: the best ``k`` of each query's short list.

    Queries and codes meet in blocks, each one task, with fewer than
    ``query_rows`` queries where their lists would be over ``listed_rows`` long
    together. Then only the rows that are
    on a list are joined with their vectors. Queries without a usable vector
    find nothing.
    """
    q = usable(queries, case_id=query_id, vector=vector).select(F.col("id").alias("query_id"), "v")
    keep = max(codes.shortlist or 10 * k, k) + exclude_self
    query_rows = max(1, min(query_rows, listed_rows // keep))
    asked_rows = q.count()
    n_q, n_b = (max(1, -(-n // size)) for n, size in ((asked_rows, query_rows), (index.count(), block_rows)))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = q.select(F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("a"), every(n_b).alias("b"), "query_id", "v")
    right = index.select(F.pmod(F.xxhash64("id"), F.lit(n_b)).alias("b"), every(n_q).alias("a"), "id", "cell", "code")
    kinds = q.schema["query_id"].dataType.simpleString(), index.schema["id"].dataType.simpleString()
    listed = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(
        _listed(codes, keep), f"query_id {kinds[0]}, base_id {kinds[1]}, guess double")
    if exclude_self:
        listed = listed.where("query_id <> base_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("guess"), "base_id")
    listed = materialize(listed.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep).select("query_id", "base_id"), "listed")
    own = index.select(F.col("id").alias("base_id"), F.col("v").alias("base"))
    asked = salted_lookup(listed, own, key="base_id", spread_by=["query_id"], hot_rows=hot_rows)
    # Listed rows with their vectors are many times the queries: they stay where they are if the queries can go there.
    if 8 * codes.wide * asked_rows <= QUERY_BYTES:
        asked = asked.join(F.broadcast(q), "query_id")
    else:
        asked = salted_lookup(asked, q, key="query_id", spread_by=["base_id"], hot_rows=hot_rows)

    def dot(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda n, p: n + p)

    length = F.sqrt(dot("v", "v")) * F.sqrt(dot("base", "base"))
    score = F.round(F.when(length > 0, dot("v", "base") / length).otherwise(0.0), 12)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "base_id")
    return (asked.select("query_id", "base_id", score.alias("score")).withColumn("rank", F.row_number().over(place))
            .where(F.col("rank") <= k))


def calibrate(
    queries: DataFrame, index: DataFrame, codes: Codes, *, query_id: str, vector: str, k: int = 5, recall: float = 0.9,
    errors: float = 2.5, exclude_self: bool = False, most_queries: int = 256,
) -> Codes:
    """The codes with the fewest probes and the shortest list that reach ``recall`` on sample queries, with ``errors``
    standard errors to spare.

    Up to ``most_queries`` queries, those with the least hash, are compared with
    the whole index exactly. For each true neighbour it is counted how many cells
    come before its own and how many rows before it by code.
    """
    asked = queries.orderBy(F.xxhash64(query_id)).limit(most_queries)
    asked = materialize(usable(asked, case_id=query_id, vector=vector), "sample")
    truth = vectors.top_k(asked, index, query_id="id", base_id="id", vector="v", k=k, exclude_self=exclude_self)
    rows = truth.join(index.select(F.col("id").alias("base_id"), "cell", "code"), "base_id").join(
        asked.select(F.col("id").alias("query_id"), "v"), "query_id").select("v", "cell", "code").toArrow()  # most_queries * k at most
    if not len(rows):
        return codes
    q, cell, code = _unit(_vectors(rows["v"])), rows["cell"].to_numpy(), _codes_of(rows["code"], len(codes.books))
    own = np.array([codes.scores(q[i:i + 1], cell[i:i + 1], code[i:i + 1])[0, 0] for i in range(len(q))])
    rank = codes.order(q)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # By row and number of probes: rows before the neighbour in the cells up to there.
        total = np.zeros((len(q), len(codes.centres)), np.int64)
        for batch in batches:
            for at in range(0, len(batch), 2_048):
                c, raw = batch["cell"].to_numpy()[at:at + 2_048], batch["code"].tolist()[at:at + 2_048]
                guess = codes.scores(q, c, np.frombuffer(b"".join(raw), np.uint8).reshape(len(c), -1))
                i, j = np.nonzero(guess > own[:, None] + 1e-12)
                np.add.at(total, (i, rank[i, c[j]]), 1)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"row": i, "place": j, "n": total[i, j]})

    counted = index.select("cell", "code").mapInPandas(count, "row long, place long, n long").groupBy("row", "place").agg(F.sum("n").alias("n")).toArrow()
    before = np.zeros((len(q), len(codes.centres)), np.int64)
    before[counted["row"].to_numpy(), counted["place"].to_numpy()] = counted["n"].to_numpy()
    before = np.cumsum(before, axis=1)
    wanted, n_rows = min(1.0, recall + errors * np.sqrt(recall * (1 - recall) / len(q))), index.count()
    reached = rank[np.arange(len(q)), cell]  # cells before the neighbour's own
    best, choice = np.inf, (len(codes.centres), int(before[:, -1].max()) + 1)
    for probes in range(1, len(codes.centres) + 1):
        place = np.sort(np.where(reached < probes, before[:, probes - 1], np.iinfo(np.int64).max))
        need = int(place[max(0, int(np.ceil(wanted * len(place))) - 1)])
        # A vector that is read costs as much as many codes of the cells that are looked into.
        cost = need + n_rows * probes / len(codes.centres) * len(codes.books) / (8 * codes.wide)
        if need < np.iinfo(np.int64).max and cost < best:
            best, choice = cost, (probes, need + 1)
    return replace(codes, probes=choice[0], shortlist=max(k, choice[1]))
