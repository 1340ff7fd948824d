"""Exact and near duplicates of texts.

Exact copies are found by window ranks limited to 1. Spark evaluates that limit
inside every map task before the shuffle, so a text that fills a third of the
table crosses the network once per map task, not once per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.text import digest, words
from caselens.operators.graph import components
from caselens.operators.joins import salted_lookup
from caselens.runtime import materialize, small_enough

#: 64-bit words of the sketch of a shingle set.
SKETCH = 8
#: Ids of texts in pairs, up to which they are sent to where the sets lie.
ASKED = 1_000_000
#: Texts, in ``hot_rows``, up to which the rows of one shingle are counted where they lie.
WINDOW = 10


def dedup_exact(df: DataFrame, *, text: str, case_id: str) -> DataFrame:
    """First row, by key, of every distinct text; null texts are dropped."""
    first = Window.partitionBy("_digest").orderBy(case_id)
    return (df.where(F.col(text).isNotNull())
            .withColumn("_digest", digest(text))
            .withColumn("_rank", F.row_number().over(first))
            .where("_rank = 1").drop("_digest", "_rank"))


def dedup_chunked(df: DataFrame, *, text: str, chunk: str) -> DataFrame:
    """Drop texts seen in an earlier chunk; copies within a chunk survive.

    Only the rows of a text's first chunk meet in one task, and a chunk has a
    fixed size.
    """
    first = Window.partitionBy("_digest").orderBy(chunk)
    return (df.where(F.col(text).isNotNull())
            .withColumn("_digest", digest(text))
            .withColumn("_rank", F.rank().over(first))
            .where("_rank = 1").drop("_digest", "_rank"))


def dedup_stats(df: DataFrame, *, text: str) -> DataFrame:
    """One row: rows, rows without text, distinct texts, rows to drop, texts with copies."""
    per_text = df.groupBy(digest(text).alias("d")).agg(F.count("*").alias("n"))
    has_text = F.col("d").isNotNull()
    return per_text.agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~has_text, F.col("n"))), F.lit(0)).alias("n_null"),
        F.count_if(has_text).alias("n_distinct"),
        F.coalesce(F.sum(F.when(has_text, F.col("n") - 1)), F.lit(0)).alias("n_dropped"),
        F.count_if(has_text & (F.col("n") > 1)).alias("n_repeated_texts"))


def shingled(df: DataFrame, *, text: str, size: int = 3) -> DataFrame:
    """Add ``shingles``: hashes of the distinct word runs; short texts count whole."""
    w = F.col("_words")
    runs = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))
    whole = F.array(F.xxhash64(F.array_join(w, " ")))
    long_enough = F.size(w) >= size
    shingles = F.when(long_enough, F.slice(runs, 1, F.size(w) - (size - 1))).otherwise(whole)
    return (df.withColumn("_words", words(F.lower(text)))
            .withColumn("shingles", F.array_distinct(shingles)).drop("_words"))


def _up(n: Column, num: int, den: int) -> Column:
    """``n * num / den``, rounded up."""
    return F.floor((n * num + (den - 1)) / den).cast("int")


def _prefixes(sets: DataFrame, num: int, den: int, hot_rows: int) -> DataFrame:
    """``(shingle, id, n, place, indexed)``: the shared shingles in the rare-first prefix of every text.

    Two sets similar enough share a shingle that lies in the long prefix of the
    larger and in the short (``indexed``) prefix of the smaller one (Xiao et al.,
    2008). Shingles of one text only come first and need no row. A text has a
    shingle once, so up to ``WINDOW`` times ``hot_rows`` texts one task can hold any
    shingle's rows (on disk if need be), and they are moved only once.
    """
    each = sets.select("id", F.explode("shingles").alias("shingle"))
    if small_enough(sets, WINDOW * hot_rows):
        shared = each.withColumn("df", F.count("*").over(Window.partitionBy("shingle"))).where("df > 1")
    else:
        counts = materialize(each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "counts")
        shared = salted_lookup(each, counts, key="shingle", spread_by=["id"], hot_rows=hot_rows, counted="df")
    ranked = shared.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("ranked"))
    n = F.col("n")
    placed = (ranked.join(sets.select("id", F.size("shingles").alias("n")), "id")
              .select("id", "n", (n - F.size("ranked")).alias("alone"), F.posexplode("ranked").alias("at", "r"))
              .select("id", "n", F.col("r.shingle").alias("shingle"), (F.col("alone") + F.col("at")).alias("place")))
    return (placed.where(F.col("place") <= n - _up(n, num, den))
            .withColumn("indexed", F.col("place") <= n - _up(n, 2 * num, num + den)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parity of the shingles in each of 512 cells. Two sets differ in at least as many shingles as sketches in bits."""
    cells = 64 * SKETCH
    for batch in batches:
        lists = batch.column(1)
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        cell = (lists.flatten().to_numpy().view(np.uint64) % np.uint64(cells)).astype(np.int64)
        odd = (np.bincount(owner * cells + cell, minlength=len(lists) * cells) & 1).astype(np.uint8)
        words = np.packbits(odd.reshape(len(lists), cells), axis=1).view(np.int64).ravel()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), lists, pa.ListArray.from_arrays(np.arange(0, len(words) + 1, SKETCH, dtype=np.int32), words)],
            ["id", "shingles", "sketch"])


def _maybe_similar(pairs: DataFrame, sets: DataFrame, num: int, den: int, hot_rows: int) -> DataFrame:
    """The pairs ``(id, lead)`` that the sizes and sketches do not rule out."""
    brief = sets.select("id", F.size("shingles").alias("n"), "sketch")
    leads = brief.select(F.col("id").alias("lead"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    both = salted_lookup(pairs, leads, key="lead", spread_by=["id"], hot_rows=hot_rows).join(brief, "id")
    apart = F.aggregate(F.zip_with("sketch", "other", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, b: a + b)
    return both.where(apart * (num + den) <= (F.col("n") + F.col("m")) * (den - num)).select("id", "lead")


def _similar(pairs: DataFrame, sets: DataFrame, num: int, den: int, hot_rows: int) -> DataFrame:
    """The pairs ``(id, lead)`` whose sets are similar enough. Only the sets of texts in a pair are moved."""
    asked = pairs.select(F.explode(F.array("id", "lead")).alias("id")).distinct()
    sets = sets.select("id", "shingles")
    if small_enough(asked, ASKED):
        sets = materialize(sets.join(F.broadcast(asked), "id", "left_semi"), "asked")
    lead_sets = sets.select(F.col("id").alias("lead"), F.col("shingles").alias("lead_shingles"))
    both = salted_lookup(pairs, lead_sets, key="lead", spread_by=["id"], hot_rows=hot_rows).join(sets, "id")
    common = F.size(F.array_intersect("shingles", "lead_shingles"))
    union = F.size("shingles") + F.size("lead_shingles") - common
    return both.where(common * den >= union * num).select("id", "lead")


def near_dup_groups(
    df: DataFrame,
    *,
    case_id: str,
    text: str,
    threshold: float = 0.8,
    shingle_size: int = 3,
    hot_rows: int = 1_000_000,
    max_star_rounds: int = 20,
) -> DataFrame:
    """``(case_id, group_id)`` for every case with text; the group is its least key.

    Groups are the connected components of all pairs of distinct texts whose
    shingle sets have a Jaccard similarity of ``threshold`` or more; the result
    is exact. Exact copies collapse first. The others meet by rare shingles of
    their prefixes, so texts that only share a form meet if what sets them
    apart is about as little as the limit allows. Where a family shares a
    shingle, its members are compared with one leader per round, and a shingle
    whose texts are connected is done. When rounds stop paying, the pairs left
    in different components are formed, each once. Sketches of the sets rule
    out nearly all pairs that are not similar; only the others are compared.
    Rounds and last step find the same links in any order, so
    ``max_star_rounds`` only decides how the work is split.
    """
    share = Fraction(str(threshold))
    num, den = share.numerator, share.denominator
    keyed = df.where(F.col(text).isNotNull()).select(F.col(case_id).alias("id"), F.col(text).alias("t"))
    copies = materialize(keyed.select("id", digest("t").alias("d")), "copies")
    firsts = copies.groupBy("d").agg(F.min("id").alias("rep"))
    distinct = dedup_exact(keyed, text="t", case_id="id")
    id_type = distinct.schema["id"].dataType.simpleString()
    sets = materialize(
        shingled(distinct, text="t", size=shingle_size).select("id", "shingles")
        .mapInArrow(_sketches, f"id {id_type}, shingles array<bigint>, sketch array<bigint>"), "shingles")
    entries = materialize(_prefixes(sets, num, den, hot_rows), "prefixes")
    # A shingle matters if a short prefix holds it and another text has it, too.
    meeting = entries.groupBy("shingle").agg(F.count("*").alias("texts"), F.bool_or("indexed").alias("found")).where("found AND texts > 1")
    open_ = materialize(salted_lookup(
        entries, meeting.select("shingle"), key="shingle", spread_by=["id"], hot_rows=hot_rows), "open")

    links, parts, before = None, None, None
    for turn in range(max_star_rounds + 1):
        if parts is not None:
            open_ = open_.drop("part").join(parts.select("id", F.col("component").alias("part")), "id", "left").withColumn(
                "part", F.coalesce("part", "id"))
        else:
            open_ = open_.withColumn("part", F.col("id"))
        sizes = open_.groupBy("shingle", "part").agg(F.count("*").alias("c"), F.sum(F.col("indexed").cast("long")).alias("i"))
        state = materialize(sizes.groupBy("shingle").agg(
            F.count("*").alias("parts"), F.sum("i").alias("indexed_texts"),
            (F.sum("i") * F.sum("c") - F.sum(F.col("i") * F.col("c"))).alias("pairs")).where("parts > 1 AND indexed_texts > 0"), "state")
        n_left, n_pairs = state.agg(F.count("*"), F.sum("pairs")).first()
        if not n_left:
            break
        open_ = materialize(salted_lookup(
            open_, state.select("shingle"), key="shingle", spread_by=["id"], hot_rows=hot_rows), "open")
        last = turn == max_star_rounds or (before is not None and n_pairs > before / 2) or n_pairs <= 2 * n_left
        if last:
            small = open_.where("indexed").select("shingle", F.col("id").alias("lead"), F.col("n").alias("m"),
                                                  F.col("place").alias("at"), F.col("part").alias("other"))
            need = _up(F.col("n") + F.col("m"), num, num + den)
            pairs = open_.join(small, "shingle").where(
                (F.col("part") != F.col("other")) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("lead") < F.col("id"))))
                & (F.col("m") * den >= F.col("n") * num)
                & (F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) >= need))
        else:
            rank = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
            leads = open_.where("indexed").groupBy("shingle").agg(
                F.min(F.struct(rank.alias("r"), F.col("id").alias("lead"), F.col("n").alias("m"), F.col("part").alias("other"))).alias("f"))
            pairs = salted_lookup(open_, leads.select("shingle", "f.lead", "f.m", "f.other"), key="shingle", spread_by=["id"], hot_rows=hot_rows)
            pairs = pairs.where((F.col("part") != F.col("other"))
                                & (F.least("n", "m") * den >= F.greatest("n", "m") * num))
        pairs = materialize(pairs.select(F.greatest("id", "lead").alias("id"), F.least("id", "lead").alias("lead")).distinct(), "pairs")
        pairs = materialize(_maybe_similar(pairs, sets, num, den, hot_rows), "pairs")
        found = materialize(_similar(pairs, sets, num, den, hot_rows), "links")
        if found.limit(1).count():
            links = found if links is None else links.unionByName(found)
            parts = components(links, src="id", dst="lead", hot_rows=hot_rows)
        if last:
            break
        before = n_pairs

    reps = firsts.select("d", F.col("rep").alias("id"))
    if parts is not None:
        reps = reps.join(parts, "id", "left")
    else:
        reps = reps.withColumn("component", F.lit(None).cast("bigint"))
    groups = reps.select("d", F.coalesce("component", "id").alias("group_id"))
    return (salted_lookup(copies, groups, key="d", spread_by=["id"], hot_rows=hot_rows)
            .select(F.col("id").alias(case_id), "group_id"))
