"""Counts of the words of all texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from caselens.llm import words as W

_FLUSH = 2_000_000


def endings(words: W.Words, pick: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The last three bytes of each word (or of the picked ones) as one number; shorter words have zeros in front."""
    starts, ends = words.starts[pick], words.ends[pick]
    out = np.zeros(len(starts), np.int64)
    for k in range(1, 4):
        at = ends - k
        out |= np.where(at >= starts, words.data[np.maximum(at, 0)], 0).astype(np.int64) << (8 * (k - 1))
    return out


_COUNT = np.dtype([("word", "<u8"), ("n", "<i8"), ("ending", "<i4")])


def _summed(rows: np.ndarray) -> np.ndarray:
    order = np.argsort(rows["word"])
    word = rows["word"][order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    out = np.zeros(len(first), _COUNT)
    out["word"], out["ending"] = word[first], rows["ending"][order[first]]
    if len(first):
        out["n"] = np.add.reduceat(rows["n"][order], first)
    return out


def _count(buckets: int, ends: bool = True):
    """Counts of the words of a task, in one packed value per bucket of words; without ``ends``, endings are 0."""
    def packed(rows: np.ndarray) -> pa.RecordBatch:
        bucket = (rows["word"] >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order].astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        end = np.append(first[1:], len(bucket))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[first]), pa.array([rows[a:b].tobytes() for a, b in zip(first, end, strict=True)], pa.binary())], ["bucket", "data"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in rows:
            for _, _, words in W.batches(batch.column(0)):
                hashes = words.hashes()
                order = np.argsort(hashes) if ends else None
                hashes = hashes[order] if ends else np.sort(hashes)
                first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
                one = np.zeros(len(first), _COUNT)
                one["word"], one["n"] = hashes[first], np.diff(np.append(first, len(hashes)))
                if ends:
                    one["ending"] = endings(words, order[first])
                held.append(one)
                size += len(one)
                if size > _FLUSH:
                    held = [_summed(np.concatenate(held))]
                    size = len(held[0])
                    if size > _FLUSH // 2:
                        yield packed(held[0])
                        held, size = [], 0
        if size:
            yield packed(_summed(np.concatenate(held)))
    return run


def _merged(singly: bool):
    def run(group: pa.Table) -> pa.Table:
        rows = _summed(np.concatenate([np.frombuffer(x.as_buffer(), _COUNT) for x in group["data"]]))
        once = 0
        if not singly:
            several = rows["n"] > 1
            once, rows = len(rows) - int(several.sum()), rows[several]
        out = pa.table({"word": rows["word"].copy().view(np.int64), "ending": rows["ending"].copy(), "n": rows["n"].copy()})
        return pa.concat_tables([out, pa.table({"word": [None], "ending": [0], "n": [once]}, out.schema)]) if once else out
    return run


def word_counts(docs: DataFrame, text: str, *, buckets: int = 256, ends: bool = True, singly: bool = True) -> DataFrame:
    """``word`` (64-bit hash), ``ending`` (0 without ``ends``) and ``n`` of every word. A task sends each of its words once.

    A bucket holds one entry per distinct word and task: ``buckets`` should rise with the vocabulary.
    Without ``singly``, the words that occur once are a row per bucket, with a null ``word``.
    """
    return (docs.select(F.col(text).alias("text")).mapInArrow(W.lean(_count(buckets, ends)), "bucket int, data binary")
            .groupBy("bucket").applyInArrow(W.lean_group(_merged(singly)), "word long, ending int, n long"))


def _level() -> Column:
    return F.floor(F.log2("n") * 8 + 1e-9).cast("int")


def levels_of(counts: DataFrame) -> list[Row]:
    """Words and tokens by level of their count (eight to a doubling), the most frequent first: at most 512 rows."""
    return counts.groupBy(_level().alias("level")).agg(
        F.count("*").alias("words"), F.sum("n").alias("tokens"), F.count_if(F.col("n") == 1).alias("once"),
        F.count_if(F.col("n") == 2).alias("twice")).orderBy(F.desc("level")).collect()


def most_frequent(counts: DataFrame, most: int, levels: list[Row] | None = None) -> pa.Table:
    """The words of the highest levels, whole levels and ``most`` words at most."""
    held, least = 0, 1 << 30
    for r in levels_of(counts) if levels is None else levels:
        held += r["words"]
        if held > most:
            break
        least = r["level"]
    return counts.where(_level() >= least).toArrow()
