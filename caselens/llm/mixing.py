"""Mixing sources to target weights, on DataFrame functions only.

Every source has a budget of words. Whole passes over the source (epochs) come
first; what is left of the budget is drawn without replacement by exponential
keys (Efraimidis and Spirakis, 2006): ``-ln(u) / weight``, smallest first, with
``u`` a hash of the id, so that reruns agree.

The keys are not sorted as a whole. Words are counted per source and cell of
the key first; the budget ends in one cell of each source, and only the rows
there are sorted. What a long document leaves free is filled from all rows
behind it, by counts per cell again. A source with a third of all rows has many cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.runtime import broadcast_if_small, materialize

#: Parts of the rows of a source in the one join by source.
SLICES = 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(doc_id: Column) -> Column:
    """A number in (0, 1) that only depends on the id: 48 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(
    sizes: DataFrame, *, pattern: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0,
) -> DataFrame:
    """Add ``target`` (words) to one row per source: ``source, source_size``.

    Sources in order of code points, null last, get the weights of ``pattern``
    in turn and together ``share`` of all words. A source stops at ``most``
    times its size; the excess goes to the others by weight, until none is
    above. A null source is a source like any other.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weights = F.array(*[F.lit(w) for w in pattern])
    rows = sizes.withColumn("_n", F.row_number().over(order)).withColumn(
        "_w", F.element_at(weights, (F.pmod(F.col("_n") - 1, F.lit(len(pattern))) + 1).cast("int")))
    # The sources that stop are those of the least room per weight. With the first k of them stopped, the others
    # share the rest at `level`; the first k at which the next one is not above its room is the answer. From there on
    # the levels fall, so it is the highest one that is not above its room.
    rows = rows.withColumn("_room", F.col("source_size") * F.lit(most) / F.col("_w"))
    by_room = Window.orderBy("_room", "_n")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    rows = rows.withColumn(
        "_level", (total - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(most)) / F.sum("_w").over(onward))
    level = F.max(F.when(F.col("_level") <= F.col("_room"), F.col("_level"))).over(Window.partitionBy())
    capped = F.col("source_size") * F.lit(most)
    target = F.when(level.isNull(), capped).otherwise(F.least(capped, level * F.col("_w")))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: DataFrame | None = None,
    pattern: tuple[float, ...] = (1.0, 2.0, 3.0),
    share: float = 1.0,
    most: float = 3.0,
    cell_rows: int = 20_000,
) -> DataFrame:
    """How often each document enters the mix.

    Returns one row per row of ``docs``: ``doc_id, source, size, source_size,
    target, times, taken`` (``taken = size * times`` words). ``weights`` holds
    the quality of documents, ``doc_id, weight`` (the largest of a repeated
    id); it is joined when the texts are gone. Without a row, or null, it is 1;
    0 or less is drawn after all others. A part of a document is never taken:
    the rows of a source come in the order of their keys, and each one is taken
    that fits what is left of the target, until none does. Cells hold about
    ``cell_rows / 4`` rows of the whole table at most.

    Null or blank texts have no words, so that only whole epochs take them, and
    a null ``doc_id`` is an ordinary value. Rows equal in id and size are interchangeable. No rows give no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    if weights is not None:
        known = weights.groupBy(F.col("doc_id").alias("_id")).agg(F.max("weight").alias("_weight"))
        rows = materialize(rows, "sizes").join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    else:
        rows = rows.withColumn("_weight", F.lit(1.0))
    quality = F.coalesce("_weight", F.lit(1.0)).cast("double")
    key = F.when(quality > 0, -F.ln(unit(F.col("doc_id"))) / quality).otherwise(F.lit(float("inf")))
    rows = materialize(rows.select("doc_id", "source", "size", key.alias("key")), "keys")
    n = rows.count()
    # 1 - exp(-key) rises with the key and is even on (0, 1) at weight 1.
    cells = 4 * max(1, -(-n // cell_rows))
    cell = F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * cells)
    rows = rows.withColumn("cell", F.least(cell, F.lit(cells - 1)).cast("int"))

    counted = materialize(rows.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.count("*").alias("rows")), "cells")
    plan = targets(counted.groupBy("source").agg(F.sum("words").alias("source_size")), pattern=pattern, share=share, most=most)
    plan = (plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
            .withColumn("left", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    counted = (counted.withColumn("to_words", F.sum("words").over(upto))
               .join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    over = F.col("to_words") > F.col("left")
    # The cells before `low` fit as a whole.
    ends = materialize(
        counted.groupBy("source", "source_size", "target", "epochs", "left")
        .agg(F.min(F.when(over, F.col("cell"))).alias("low"),
             F.coalesce(F.max(F.when(~over, F.col("to_words"))), F.lit(0)).alias("inside"))
        .withColumn("low", F.coalesce("low", F.lit(cells))), "plan")

    # One row per source, repeated per slice, so that a large source is joined in many tasks.
    dealt = ends.withColumnRenamed("source", "s").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SLICES)).cast("int"))
    joined = rows.join(dealt, F.col("source").eqNullSafe(F.col("s")) & (F.col("_slice") == F.col("slice"))).drop("s", "slice", "_slice")
    settled = joined.where("cell <> low").withColumn("extra", ((F.col("cell") < F.col("low")) & (F.col("size") > 0)).cast("int"))

    # In the cell `low`, the longest prefix that fits; then rows behind it that fit the gap that is left.
    upto = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("left") - F.col("inside")
    edge = joined.where("cell = low").withColumn("run", F.sum("size").over(upto)).withColumn(
        "extra", ((F.col("run") <= room) & (F.col("size") > 0)).cast("int"))
    edge = materialize(edge.select(*_OUT, "cell", "key", "left", "inside"), "edge")
    used = edge.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("size") * F.col("extra")).alias("used"))
    gaps = (ends.where(F.col("low") < cells).join(used, F.col("source").eqNullSafe(F.col("s")), "left")
            .select("source", (room - F.coalesce("used", F.lit(0))).alias("gap")).where("gap >= 1"))
    out = settled.select(*_OUT, "cell", "key").unionByName(edge.select(*_OUT, "cell", "key"))
    if gaps.limit(1).count():
        # Equal rows are told apart by their number.
        place = F.struct("key", "doc_id", "size", "number")
        out = materialize(out.withColumn("number", F.monotonically_increasing_id()), "drawn").withColumn("place", place)
        turns = _fill(out.where("extra = 0 and size > 0").select("source", "cell", "place", "size"), gaps)
        found = turns.groupBy(F.col("source").alias("s")).agg(F.collect_list(F.struct("after", "until", "gap")).alias("turns"))
        taken = F.exists("turns", lambda t: _within(F.col("place"), t["after"], t["until"]) & (F.col("size") <= t["gap"]))
        out = (out.join(broadcast_if_small(found), F.col("source").eqNullSafe(F.col("s")), "left")
               .withColumn("extra", F.when((F.col("extra") == 0) & (F.col("size") > 0) & F.coalesce(taken, F.lit(False)), 1).otherwise(F.col("extra"))))
    times = F.col("epochs") + F.col("extra")
    return out.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def _within(place: Column, after: Column, until: Column) -> Column:
    return (after.isNull() | (place > after)) & (until.isNull() | (place < until))


def _fill(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """Fill the gap of each source with its rows in order, passing over those that do not fit, until none fits.

    Rows are ``source, cell, place, size``, gaps ``source, gap``. Returns turns ``source, after, until, gap``: taken are the
    rows between the places ``after`` and ``until`` (open where null) of at most ``gap`` words. A turn ends before the first
    row that fits no more; it is found by the words per cell, and only one cell of each source is sorted.
    """
    state = materialize(gaps.withColumn("after", F.lit(None).cast(rows.schema["place"].dataType)), "gaps")
    turns = None
    while state.limit(1).count():
        known = broadcast_if_small(state.withColumnRenamed("source", "s"))
        fits = (rows.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") <= F.col("gap"))).drop("s")
                .where(_within(F.col("place"), F.col("after"), F.lit(None))))
        upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = fits.groupBy("source", "cell", "gap", "after").agg(F.sum("size").alias("words")).withColumn("to_words", F.sum("words").over(upto))
        over = F.col("to_words") > F.col("gap")
        ends = materialize(cells.groupBy("source", "gap", "after").agg(
            F.min(F.when(over, F.col("cell"))).alias("stop"),
            F.coalesce(F.max(F.when(~over, F.col("to_words"))), F.lit(0)).alias("whole")), "ends")
        last = broadcast_if_small(ends.select(F.col("source").alias("s"), "stop", "whole"))
        run = F.sum("size").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        sorted_rows = (fits.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("stop"))).drop("s")
                       .withColumn("run", run + F.col("whole")))
        blocked = F.col("run") > F.col("gap")
        found = sorted_rows.groupBy(F.col("source").alias("s")).agg(
            F.min(F.when(blocked, F.col("place"))).alias("until"), F.max(F.when(~blocked, F.col("run"))).alias("used"))
        turn = materialize(
            ends.join(broadcast_if_small(found), F.col("source").eqNullSafe(F.col("s")), "left")
            .select("source", "after", "until", "gap", (F.col("gap") - F.coalesce("used", "whole")).alias("rest")), "turn")
        turns = turn if turns is None else turns.unionByName(turn)
        state = materialize(turn.where("until is not null and rest >= 1").select("source", F.col("rest").alias("gap"), F.col("until").alias("after")), "gaps")
    return turns


_OUT = ["doc_id", "source", "size", "source_size", "target", "epochs", "extra"]


def repeated(docs: DataFrame, mixed: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns, whatever these are called.

    Rows that repeat an id are taken as often as the one that is taken most.
    """
    how_often = mixed.where("times > 0").groupBy(F.col("doc_id").alias("id")).agg(F.max("times").alias("times"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("own"))
    return (rows.join(how_often, F.col("own").eqNullSafe(F.col("id")))
            .select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*"))
