"""Near duplicates by one-permutation MinHash.

One hash of every n-gram deals the n-grams of a document over bins; the least
hash of each bin is kept (Li, Owen and Zhang, "One permutation hashing", 2012).
An empty bin takes the value of a random bin that is not empty, drawn anew for
every bin (optimal densification: Shrivastava, "Optimal densification for fast
and accurate minwise hashing", 2017), so bins agree like independent MinHashes
however small a set is. Bands of bins are the keys of buckets.

Documents of a bucket are linked to one centre, not to each other: a star has
one edge per document. A star misses documents that are near each other but not
near the centre, so buckets whose members are still in different components get
further centres. Where stars no longer help (many unlinked documents in one
bucket, as under a common passage), the members go on to wider bands, which few
unlinked documents share, and what is then left is compared block by block with
sketches. Every edge is confirmed on the full sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm import words as W
from caselens.llm.jaccard import SKETCH, Limit, Sets, links, ngram_sets, set_ids, sketches
from caselens.operators.graph import components
from caselens.operators.joins import salted_lookup
from caselens.runtime import broadcast_if_small, materialize

#: Members of a bucket compared in one block, and rows of a group of blocks.
BLOCK, GROUP_ROWS = 2_048, 50_000


@dataclass(frozen=True)
class Bands:
    """``count`` bands of ``rows`` bins each."""

    count: int
    rows: int

    @property
    def bins(self) -> int:
        return self.count * self.rows

    def miss(self, similarity: float) -> float:
        """Chance that two sets of that similarity agree in no band."""
        return (1 - similarity ** self.rows) ** self.count


#: Bands of all documents, and of those that share a bucket with many others. Two sets at 0.85 are missed once in
#: 10^8 and once in 10^6 times.
NARROW, WIDE = Bands(32, 5), Bands(96, 12)


@functools.cache
def _donors(bins: int) -> np.ndarray:
    """The bins that an empty bin asks in turn, one row per turn: a random order of all bins for each of them."""
    order = np.argsort(np.random.default_rng(bins).random((bins, bins)), axis=0)
    return order.astype(np.int32)


def signatures(sets: Sets, bins: int) -> np.ndarray:
    """One row of ``bins`` hashes per set; of an empty set, zeros."""
    docs = len(sets.offsets) - 1
    values = W.mix(sets.values ^ np.uint64(0x452821E638D01377))
    at = sets.owner() * bins + ((values >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((values, at))
    at, values = at[order], values[order]
    first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
    own = np.zeros(docs * bins, np.uint64)
    held = np.zeros(docs * bins, bool)
    own[at[first]], held[at[first]] = values[first], True
    own, held = own.reshape(docs, bins), held.reshape(docs, bins)
    out = own.copy()
    left = np.flatnonzero(held.any(axis=1) & ~held.all(axis=1))
    missing = ~held[left]
    for donor in _donors(bins):
        if not len(left):
            break
        give = missing & held[left][:, donor]
        doc, to = np.nonzero(give)
        out[left[doc], to] = own[left[doc], donor[to]]
        missing &= ~give
        more = missing.any(axis=1)
        left, missing = left[more], missing[more]
    return out


def band_keys(sets: Sets, bands: Bands) -> np.ndarray:
    """One row of ``bands.count`` keys per set."""
    sign = signatures(sets, bands.bins).reshape(-1, bands.count, bands.rows)
    key = np.tile(np.arange(bands.count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(bands.rows), (len(sign), 1))
    for k in range(bands.rows):
        key = W.mix(key ^ sign[:, :, k]) * np.uint64(0xD6E8FEB86659FD93)
    return key


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.view(np.int64).ravel()))


def _signed(n: int):
    """Size, identity and band keys of the set of every text; an empty set has no keys."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.smaller(rows):
            for a, b, words in W.batches(batch.column(1)):
                sets = ngram_sets(words, n)
                one, two = set_ids(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sets.sizes()), pa.array(one), pa.array(two), _lists(band_keys(sets, NARROW))],
                    ["doc_id", "n", "one", "two", "keys"])
    return run


def _full(n: int):
    """Size, sketch and n-grams of the set of every text."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.smaller(rows):
            for a, b, words in W.batches(batch.column(1)):
                sets = ngram_sets(words, n)
                grams = pa.ListArray.from_arrays(pa.array(sets.offsets.astype(np.int32)), pa.array(sets.values.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sets.sizes()), _lists(sketches(sets)), grams], ["id", "n", "sketch", "grams"])
    return run


def _wide(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of wider bands, from n-grams."""
    for batch in rows:
        grams = batch.column(1)
        sizes = grams.value_lengths().to_numpy(zero_copy_only=False)
        flat, offsets = grams.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(sizes)])
        for a, b in W.slices(offsets, W.SLICE_BYTES // 8):
            part = Sets(flat[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            for at in range(0, b - a, 256):  # bounds the signatures
                end = min(at + 256, b - a)
                some = Sets(part.values[part.offsets[at]:part.offsets[end]], part.offsets[at:end + 1] - part.offsets[at])
                keys = band_keys(some, WIDE)
                ids = batch.column(0).slice(a + at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64).ravel()), ids.take(pa.array(np.repeat(np.arange(end - at), WIDE.count)))], ["key", "id"])


def _compared(limit: Limit):
    """Pairs within a block that are in different components and whose sketches are near enough."""
    def run(group: pa.Table) -> pa.Table:
        block, ids, part, size, side = (group[c].to_numpy() for c in ("block", "id", "component", "n", "side"))
        words = group["sketch"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH)
        order = np.lexsort((size, block))
        found = [np.zeros((0, 2), np.int64)]
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        for rows in np.split(order, cuts):
            # By size: partners of a row are among those that follow it up to the largest size.
            most = np.searchsorted(size[rows], size[rows] * limit.den // limit.num, "right")
            for i, row in enumerate(rows.tolist()):
                others = rows[i + 1:most[i]]
                others = others[(part[others] != part[row]) & ((side[row] < 0) | (side[others] != side[row]))]
                if not len(others):
                    continue
                apart = np.bitwise_count(words[others] ^ words[row]).sum(1, dtype=np.int64)
                near = others[apart * (limit.den + limit.num) <= (size[others] + size[row]) * (limit.den - limit.num)]
                found.append(np.stack([np.minimum(ids[near], ids[row]), np.maximum(ids[near], ids[row])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"src": pairs[:, 0], "dst": pairs[:, 1]})
    return run


class _Components:
    """Links found so far and the components of the documents they join."""

    def __init__(self, grams: DataFrame, limit: Limit, hot_rows: int):
        self.grams, self.limit, self.hot_rows = grams, limit, hot_rows
        self.linked: DataFrame | None = None
        self.part: DataFrame | None = None

    def add(self, edges: DataFrame) -> None:
        """Confirm edges ``src, dst`` on the full sets and join the documents they link."""
        new = materialize(links(edges, self.grams, self.limit), "links")
        if new.limit(1).count():
            # Stars of the components stand for the links that they came from.
            stars = new if self.part is None else new.unionByName(self.part.select(F.col("component").alias("src"), F.col("id").alias("dst")))
            self.part = materialize(components(stars, hot_rows=self.hot_rows), "components")

    def of(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component of their ``id``."""
        if self.part is None:
            return rows.withColumn("component", F.col("id"))
        return rows.join(self.part, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def unsettled(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
        """Rows of the buckets with several components, their sizes, and the number of rows and of pairs across components."""
        at = materialize(self.of(rows.select("key", "id")).select("key", "id", "component"), "members")
        sizes = at.groupBy("key", "component").agg(F.count("*").alias("c"))
        state = materialize(
            sizes.groupBy("key").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("inside"), F.count("*").alias("parts"))
            .where("parts > 1"), "buckets")
        n_rows, pairs = state.agg(F.sum("size"), F.sum((F.col("size") * F.col("size") - F.col("inside")) / 2)).first()
        return salted_lookup(at, state.select("key", "size"), key="key", spread_by=["id"], hot_rows=self.hot_rows), state, n_rows or 0, pairs or 0

    def stars(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
        """Link the members of every bucket to one centre, then to another one, as long as that halves the open pairs."""
        last, turn = math.inf, 0
        while True:
            open_rows, state, n_rows, pairs = self.unsettled(rows)
            if not n_rows or pairs <= 2 * n_rows or pairs > last / 2:
                return open_rows, state, n_rows, pairs
            rank = F.xxhash64("id", F.lit(turn)) if turn else F.col("id")
            centre = open_rows.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), F.col("id").alias("centre"), F.col("component").alias("other"))).alias("c"))
            edges = salted_lookup(open_rows.drop("size"), centre.select("key", "c.centre", "c.other"), key="key", spread_by=["id"], hot_rows=self.hot_rows)
            self.add(edges.where("component <> other").select(F.least("id", "centre").alias("src"), F.greatest("id", "centre").alias("dst")).distinct())
            rows, last, turn = open_rows, pairs, turn + 1

    def compare(self, rows: DataFrame, state: DataFrame) -> None:
        """Compare all members of the open buckets, in blocks of bounded size."""
        parts = F.ceil(F.col("size") / BLOCK)
        dealt = state.agg(F.sum(F.col("size") * parts)).first()[0]
        rows = (rows.withColumn("parts", parts).withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")))
                .withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
        block = F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q"))
        side = F.when(F.col("p") == F.col("q"), -1).otherwise((F.col("p") > F.col("q")).cast("int"))
        groups = max(1, int(dealt // GROUP_ROWS))
        rows = (rows.join(self.grams.select("id", "n", "sketch"), "id").select(block.alias("block"), side.alias("side"), "id", "component", "n", "sketch")
                .withColumn("group", F.pmod("block", F.lit(groups))))
        self.add(rows.groupBy("group").applyInArrow(W.lean_group(_compared(self.limit)), "src long, dst long").distinct())


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 3, threshold: tuple[int, int] = (85, 100),
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; a component is its least id, and that document is kept.

    A document's set holds its distinct ``n``-grams of words (runs without
    ASCII white space, A-Z in lower case), or its whole word sequence if it has
    fewer words. Two documents are linked if the sets' common part is at least
    ``threshold`` of their union; the bands suit thresholds of 0.8 and more.
    Null, empty and blank texts have no words and are linked with nothing. Ids
    are integers; rows that repeat an id are one document with several texts,
    and a null id gives a null component and is not kept. Other columns are not
    looked at. No rows give no rows.
    """
    limit = Limit(*threshold)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(rows.mapInArrow(W.lean(_signed(n)), "doc_id long, n long, one long, two long, keys array<long>"), "signatures")

    # Equal sets are one class, known by its least id.
    sized = signed.select("doc_id", "n", F.struct("one", "two").alias("set"))
    least = materialize(sized.where("n > 0 and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("rep")), "classes")
    nodes = salted_lookup(sized, least, key="set", spread_by=["doc_id"], how="left", hot_rows=hot_rows)
    nodes = materialize(nodes.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep"))
                                     .otherwise(F.col("doc_id")).alias("rep")), "nodes")

    # Buckets of the classes. An id that repeats can stand for several sets; it is one document all the same.
    keyed = (signed.where("n > 0").join(least.select(F.col("rep").alias("doc_id"), "set.one", "set.two"), ["doc_id", "one", "two"])
             .select(F.col("doc_id").alias("id"), F.explode("keys").alias("key")))
    texts_of = nodes.where("n > 0").select("doc_id", "rep").distinct()
    same_id = texts_of.groupBy(F.col("doc_id").alias("src")).agg(F.max("rep").alias("most"), F.min("rep").alias("dst")).where("most <> dst")
    keyed = materialize(keyed.distinct(), "keys")
    several = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    found = materialize(salted_lookup(keyed, several.select("key"), key="key", spread_by=["id"], hot_rows=hot_rows), "buckets")

    wanted = found.select(F.col("id").alias("doc_id")).distinct()
    grams = materialize(rows.join(broadcast_if_small(wanted), "doc_id", "left_semi").mapInArrow(
        W.lean(_full(n)), "id long, n long, sketch array<long>, grams array<long>"), "sets")

    joined = _Components(grams, limit, hot_rows)
    left, state, n_rows, pairs = joined.stars(found)
    if n_rows and pairs > 2 * n_rows:
        wide = grams.join(broadcast_if_small(left.select("id").distinct()), "id", "left_semi").select("id", "grams").mapInArrow(
            W.lean(_wide), "key long, id long").distinct()
        left, state, n_rows, pairs = joined.stars(materialize(wide, "wide-keys"))
    if n_rows:
        joined.compare(left, state)
    part = joined.part
    again = materialize(same_id, "repeated-ids")
    if again.limit(1).count():
        edges = texts_of.where("doc_id <> rep").join(broadcast_if_small(again.select(F.col("src").alias("doc_id"))), "doc_id", "left_semi")
        edges = edges.select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
        part = components(edges if part is None else edges.unionByName(part.select(F.col("component").alias("src"), F.col("id").alias("dst"))), hot_rows=hot_rows)
    found_id = F.col("rep")
    if part is not None:
        nodes = salted_lookup(nodes, part.select(F.col("id").alias("rep"), "component"), key="rep", spread_by=["doc_id"], how="left", hot_rows=hot_rows)
        found_id = F.coalesce("component", "rep")
    return nodes.select("doc_id", F.col("n").alias("n_shingles"), found_id.alias("component_id"),
                        F.coalesce(F.col("doc_id") == found_id, F.lit(False)).alias("kept"))
