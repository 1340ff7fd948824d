"""Exact de-duplication of whole texts against immutable snapshots.

A snapshot holds the digests of what has been taken in before and, per shard of
the digest space, a static binary-fuse filter. An incoming batch is screened
shard by shard: digests that a filter does not know are new; the others join
the exact buckets, where the texts themselves are compared. Copies inside a
batch are grouped apart, by digest. Digests only choose what is compared, the
texts decide, so a collision of digests or a false positive changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm import fuse
from caselens.llm import words as W
from caselens.operators.joins import salted_lookup
from caselens.runtime import materialize

SHARD_KEYS = 250_000


def normal_text(text: str | Column) -> Column:
    """The text with every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, digest, sha)`` of every row, ``sha`` in lowercase hex. One scan, no shuffle."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), normal_text(text).alias("_norm"))
    return rows.select("doc_id", F.xxhash64("_norm").alias("digest"), F.sha2("_norm", 256).alias("sha"))


@dataclass(frozen=True)
class Snapshot:
    """Digests taken in before, and their filters ``(shard, shards, filter)``; neither is changed later."""

    digests: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def build(cls, rows: DataFrame, *, shard_keys: int = SHARD_KEYS) -> Snapshot:
        """Snapshot of ``rows`` (with ``digest``); one filter for about ``shard_keys`` digests."""
        kept = materialize(rows.select("digest").distinct(), "snapshot")
        shards = max(1, -(-kept.count() // shard_keys))

        def one(group: pa.Table) -> pa.Table:
            keys = group["digest"].to_numpy().view(np.uint64)
            return pa.table({"shard": pa.array(group["shard"].to_numpy()[:1]),
                             "filter": pa.array([fuse.build(keys)], pa.binary())})

        filters = kept.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(W.lean_group(one), "shard int, filter binary")
        return cls(kept, materialize(filters, "filters"), shards)

    def screen(self, incoming: DataFrame) -> DataFrame:
        """The digests of ``incoming`` (distinct ``digest``) that may be in the snapshot."""
        def look(batch: pa.Table, known: pa.Table) -> pa.Table:
            if batch.num_rows == 0 or known.num_rows == 0:
                return pa.table({"digest": pa.array([], pa.int64())})
            keys = batch["digest"].to_numpy()
            return pa.table({"digest": keys[fuse.contains(known["filter"][0].as_py(), keys.view(np.uint64))]})

        return (incoming.select("digest").withColumn("shard", _shard(self.shards)).groupBy("shard")
                .cogroup(self.filters.groupBy("shard")).applyInArrow(look, "digest long"))

    def bucket(self, positives: DataFrame) -> DataFrame:
        """The positives that are truly there."""
        return positives.join(self.digests, "digest", "left_semi")


def _shard(shards: int) -> Column:
    # The digest's own remainder: the filter mixes its keys again.
    return F.pmod("digest", F.lit(shards)).cast("int")


def dedup(
    docs: DataFrame,
    batches: list[Column],
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_keys: int = SHARD_KEYS,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Keep the row with the least id of equal texts, batch after batch.

    ``batches`` are conditions that deal the rows of ``docs`` into batches in
    order of arrival; what none of them takes comes last. Every batch is
    screened against the snapshots of all earlier ones.

    Returns one row per row of ``docs``: ``doc_id, keep_id, group_size, kept,
    text_sha256``. A null or empty text is the empty text; a text of white
    space only is one space. A null id is never the least; if all ids of a
    group are null, ``keep_id`` is null and all its rows count as kept. Rows
    that repeat an id and a text are kept alike. Other columns are not looked at.
    """
    number = F.lit(len(batches))
    for i, condition in reversed(list(enumerate(batches))):
        number = F.when(condition, i).otherwise(number)
    marked = docs.withColumn("_batch", number)
    base = materialize(
        digests(marked, doc_id=doc_id, text=text) if not batches else
        marked.select(F.col(doc_id).alias("doc_id"), "_batch", normal_text(text).alias("_norm"))
        .select("doc_id", "_batch", F.xxhash64("_norm").alias("digest"), F.sha2("_norm", 256).alias("sha")), "digests")
    if not batches:
        base = base.withColumn("_batch", F.lit(0))

    snapshots: list[Snapshot] = []
    suspects = None
    for i in range(len(batches) + 1):
        # A hot digest is one row per task before the shuffle.
        counted = base.where(F.col("_batch") == i).groupBy("digest").agg(F.count("*").alias("n"))
        found = counted.where("n > 1").select("digest")
        if snapshots or i < len(batches):
            counted = materialize(counted, "batch")
            found = counted.where("n > 1").select("digest")
        for old in snapshots:
            found = found.unionByName(old.bucket(old.screen(counted)))
        suspects = found if suspects is None else suspects.unionByName(found)
        if i < len(batches):
            snapshots.append(Snapshot.build(counted, shard_keys=shard_keys))
    suspects = materialize(suspects.distinct(), "suspects")

    # Byte check: only texts with a suspect digest are read again; equal texts meet map-side.
    rows = base.select("doc_id", "digest").join(suspects, "digest", "left_semi").select("doc_id").distinct()
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    texts = texts.join(rows, F.col("_id").eqNullSafe(F.col("doc_id")), "left_semi")
    groups = materialize(
        texts.select("_id", normal_text("_text").alias("_norm"))
        .groupBy("_norm").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("_norm", 256).alias("sha"), "keep_id", "group_size"), "groups")
    out = salted_lookup(base.select("doc_id", "sha"), groups, key="sha", spread_by=["doc_id"], how="left", hot_rows=hot_rows)
    lone = F.col("group_size").isNull()
    keep = F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))
