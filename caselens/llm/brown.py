"""Class-based n-gram language model (Brown et al., 1992) for scoring texts.

    P(text) = product of P(class | class before) * P(word | class)

Words are put in classes by exchange (Martin, Liermann and Ney, 1998): a word
moves to the class that raises the likelihood of the class bigrams most. The
most frequent words, and the last letters that all others end in, are settled
one after another. From the class of its ending, every other word above a count
floor then moves in rounds (Uszkoreit and Brants, 2008): tasks count the classes
around each word, a task finds its best class against the matrix of class
bigrams, and half of the words move at once. A round that lowers the likelihood
is taken back. Words below the floor keep the class of their ending, so every
word has one. The floor is 3; it only rises where more than ``clustered`` words,
which are shipped to the tasks with their classes, would lie above it.

Word counts, class totals and bigrams cover all training text. Counts stay a
table, however large. The counts of the most frequent words are shipped to the
tasks; the other words of a text are joined with the table.

Of each class a discount per known word is left for unknown ones. It is shared
evenly by as many unknown words as are estimated to exist (Chao, 1984), at
least as many as are known.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.llm import words as W
from caselens.llm.quality import remainder
from caselens.llm.vocabulary import endings, levels_of, most_frequent, word_counts
from caselens.runtime import materialize

#: Words whose counts, and whose classes, are shipped to the tasks at most.
SHIPPED, CLUSTERED = 1 << 18, 1 << 20
#: Words and endings settled one after another; classes besides that of the end.
TYPES, ENDINGS, CLASSES = 2_048, 1_022, 64
#: Least count of the other words that move, and their rounds; each moves one of `PARTS` parts of them.
FLOOR, ROUNDS, PARTS = 3, 2, 2
_FLUSH = 2_000_000
_GROUP_WORDS, _GROUPS = 512, 64  # words whose contexts meet in one group; groups of the class bigrams


@dataclass
class Types:
    """Type of each word: one of ``words`` (by hash), else its ending, else the last but one; the last is the end."""

    words: np.ndarray    # listed words, the most frequent first
    of_word: np.ndarray  # their types
    tails: np.ndarray    # sorted endings
    of_tail: np.ndarray
    size: int

    def __post_init__(self):
        self.lookup = W.Lookup(self.words)

    def __getstate__(self) -> dict:  # the lookup is larger than its keys, and built again by whoever gets them
        return {k: v for k, v in self.__dict__.items() if k != "lookup"}

    def __setstate__(self, state: dict):
        self.__dict__.update(state)
        self.__post_init__()

    def of(self, words: W.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Type of each word, and its place in the list or -1."""
        place = self.lookup.find(hashes)
        out = np.empty(len(place), np.int64)
        out[place >= 0] = self.of_word[place[place >= 0]]
        rare = np.flatnonzero(place < 0)
        out[rare] = self.of_ending(endings(words, rare))
        return out, place

    def of_ending(self, tail: np.ndarray) -> np.ndarray:
        if not len(self.tails):
            return np.full(len(tail), self.size - 2, np.int64)
        at = np.minimum(np.searchsorted(self.tails, tail), len(self.tails) - 1)
        return np.where(self.tails[at] == tail, self.of_tail[at], self.size - 2)


def _sequence(words: W.Words, kinds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(before, kind, text)`` of every token; the end closes each text and stands before its first word."""
    counts = words.counts()
    n = len(counts)
    owner = np.repeat(np.arange(n), counts + 1)
    stops = np.cumsum(counts + 1) - 1
    kind = np.full(len(owner), end, np.int64)
    inside = np.ones(len(owner), bool)
    inside[stops] = False
    kind[inside] = kinds
    before = np.concatenate([[end], kind[:-1]]) if len(kind) else kind
    return before, kind, owner


def _counted(keys_of, form) -> object:
    """Task that counts the keys which ``keys_of`` finds in the words of texts; ``form`` makes rows of keys and counts."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sums() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            distinct, which = np.unique(keys, return_inverse=True)
            return distinct, np.bincount(which, n, minlength=len(distinct)).astype(np.int64)

        for batch in rows:
            for _, _, words in W.batches(batch.column(0)):
                held.append(np.unique(keys_of(words), return_counts=True))
                size += len(held[-1][0])
                if size > _FLUSH:
                    held = [sums()]
                    size = len(held[0][0])
                    if size > _FLUSH // 2:
                        yield form(*held[0])
                        held, size = [], 0
        if held:
            yield form(*sums())
    return run


def _plain(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])


def _pack(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Rising keys, as their steps, and counts."""
    return zlib.compress(np.diff(keys, prepend=0).astype("<u4").tobytes() + n.astype("<u4").tobytes(), 1)


def _summed(parts: pa.ChunkedArray, size: int) -> np.ndarray:
    """Sums by key, ``size`` at most, of what was packed."""
    out = np.zeros(size)
    for part in parts:
        raw = np.frombuffer(zlib.decompress(part.as_py()), "<u4")
        half = len(raw) // 2
        out[np.cumsum(raw[:half], dtype=np.int64)] += raw[half:]
    return out


def _grouped(slots: int, groups: int):
    """Rows of the packed counts of a task: class bigrams in groups below 0, contexts by word in ``groups``."""
    def form(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        low = keys < 0
        names, data = [-1 - TaskContext.get().partitionId() % _GROUPS], [_pack(-1 - keys[low][::-1], n[low][::-1])]
        keys, n = keys[~low], n[~low]
        place, slot = keys // slots, keys % slots
        group, own = place % groups, place // groups * slots + slot
        order = np.lexsort((own, group))
        group, own, n = group[order], own[order], n[order]
        cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]]) if len(group) else group
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            names.append(int(group[a]))
            data.append(_pack(own[a:b], n[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])
    return form


def _type_pairs(types):
    def keys(words: W.Words) -> np.ndarray:
        own: Types = types.value
        kinds, _ = own.of(words, words.hashes())
        before, kind, _ = _sequence(words, kinds, own.size - 1)
        return before * own.size + kind
    return keys


@dataclass
class Classes:
    """Class of each type, and of each listed word, which may have left that of its type. The last class is the end."""

    types: Types
    of_type: np.ndarray
    of_word: np.ndarray
    n: int

    def of(self, words: W.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and its place in the list or -1."""
        kinds, place = self.types.of(words, hashes)
        out = self.of_type[kinds]
        out[place >= 0] = self.of_word[place[place >= 0]]
        return out, place


def _contexts(shipped, settled: int, upto: int, part: int):
    """Keys of class bigrams (below 0), and of the classes around the words of a part at the places ``settled`` to ``upto``.

    A word has ``2 * n + 1`` slots: classes after it, classes before it, and itself after itself.
    """
    def keys(words: W.Words) -> np.ndarray:
        own: Classes = shipped.value
        k = own.n
        klass, place = own.of(words, words.hashes())
        before, kind, _ = _sequence(words, klass, k - 1)
        out = [-1 - (before * k + kind)]
        if part >= 0 and len(place):
            at = np.full(len(kind), -1, np.int64)
            at[kind != k - 1] = place  # only ends have the last class
            i = np.flatnonzero((at >= settled) & (at < upto) & (at % PARTS == part))  # a text closes with its end, so a word has a token behind it
            slot = at[i] * (2 * k + 1)
            out += [slot + kind[i + 1], slot + k + before[i], slot[at[i + 1] == at[i]] + 2 * k]
        return np.concatenate(out)
    return keys


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int, rounds: int = 8) -> np.ndarray:
    """Class of each type, from the counts ``pairs[before, type]``. The last type (the end) is the last class alone.

    Types start in classes by rank of their counts, in turn, and are visited from the most frequent on.
    """
    size = len(pairs)
    own = size - 1
    total = pairs.sum(0)
    order = np.lexsort((np.arange(own), -total[:own]))
    at = np.empty(size, np.int64)
    at[order] = np.arange(own) % classes
    at[own] = classes
    k = classes + 1
    one = np.zeros((size, k))
    one[np.arange(size), at] = 1
    after = pairs @ one       # after[w, c]: w is followed by class c
    ahead = (one.T @ pairs).T  # ahead[w, c]: class c stands before w
    both = one.T @ after      # both[c, d]
    for _ in range(rounds):
        moved = 0
        for w in order:
            if total[w] == 0:
                continue
            a = at[w]
            self_pairs = pairs[w, w]
            row, column = after[w].copy(), ahead[w].copy()
            # Without w: its own class loses its row and column.
            both[a, :] -= row
            both[:, a] -= column
            both[a, a] += self_pairs
            row[a] -= self_pairs
            column[a] -= self_pairs
            n = both.sum(1) + column  # whichever class takes w, its neighbours keep their totals
            m = both.sum(0) + row
            # Gain of putting w into class b; pairs of w with itself fall on (b, b).
            gain = (_f(both + row) - _f(both)).sum(1) + (_f(both + column[:, None]) - _f(both)).sum(0)
            d = np.diagonal(both)
            gain += _f(d + row + column + self_pairs) - _f(d + row) - _f(d + column) + _f(d)
            out, into = row.sum() + self_pairs, column.sum() + self_pairs
            gain -= _f(n + out) - _f(n) + _f(m + into) - _f(m)
            gain[classes] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            both[b, :] += row
            both[:, b] += column
            both[b, b] += self_pairs
            if b != a:
                moved += 1
                at[w] = b
                after[:, a] -= pairs[:, w]
                after[:, b] += pairs[:, w]
                ahead[:, a] -= pairs[w, :]
                ahead[:, b] += pairs[w, :]
        if moved <= size // 200:
            break
    return at


def likelihood(both: np.ndarray) -> float:
    """Of class bigrams, up to what classes cannot change."""
    return float(_f(both).sum() - _f(both.sum(0)).sum() - _f(both.sum(1)).sum())


def best_classes(both: np.ndarray, at: np.ndarray, after: np.ndarray, ahead: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Class of each word that raises the likelihood most if it alone moves, its own where none does.

    ``after[w, c]`` and ``ahead[w, c]`` count class c behind and before w, ``twice[w]`` w behind itself.
    """
    out = at.copy()
    for low in range(0, len(at), 64):
        a, s = at[low:low + 64], twice[low:low + 64, None].astype(float)
        row, column = after[low:low + 64].astype(float), ahead[low:low + 64].astype(float)
        i = np.arange(len(a))
        rest = np.repeat(both[None].astype(float), len(a), axis=0)  # the matrix without each word
        rest[i, a, :] -= row
        rest[i, :, a] -= column
        rest[i, a, a] += s[:, 0]
        row[i, a] -= s[:, 0]
        column[i, a] -= s[:, 0]
        gain = np.zeros(row.shape)
        w, c = np.nonzero(row)  # a rare word has few classes around it
        x = rest[w, :, c]
        np.add.at(gain, w, _f(x + row[w, c][:, None]) - _f(x))
        w, c = np.nonzero(column)
        x = rest[w, c, :]
        np.add.at(gain, w, _f(x + column[w, c][:, None]) - _f(x))
        d = np.diagonal(rest, axis1=1, axis2=2)
        gain += _f(d + row + column + s) - _f(d + row) - _f(d + column) + _f(d)
        n, m = rest.sum(2) + column, rest.sum(1) + row  # whichever class takes the word, its neighbours keep their totals
        gain -= _f(n + row.sum(1, keepdims=True) + s) - _f(n) + _f(m + column.sum(1, keepdims=True) + s) - _f(m)
        gain[:, -1] = -np.inf  # the end stays alone
        b = gain.argmax(1)
        out[low:low + 64] = np.where(gain[i, b] > gain[i, a] + 1e-9, b, a)
    return out


def _bigrams(k: int):
    """Group function that adds up class bigrams: ``key, n``, one row per pair of classes."""
    def run(group: pa.Table) -> pa.Table:
        n = _summed(group["data"], k * k)
        seen = np.flatnonzero(n)
        return pa.table({"key": seen, "n": n[seen].astype(np.int64)})
    return run


def _moves(matrix, groups: int):
    """Group function that finds the best class of each word of a group: ``place, class`` of those that move."""
    def run(group: pa.Table) -> pa.Table:
        both, of_word = matrix.value
        k = len(both)
        place = np.arange(group["bucket"][0].as_py(), len(of_word), groups)
        counts = _summed(group["data"], len(place) * (2 * k + 1)).reshape(len(place), 2 * k + 1)
        met = counts.any(axis=1)
        place, counts = place[met], counts[met]
        to = best_classes(both, of_word[place], counts[:, :k], counts[:, k:2 * k], counts[:, 2 * k])
        moved = to != of_word[place]
        return pa.table({"place": place[moved], "class": to[moved].astype(np.int64)})
    return run


def _exchange_all(texts: DataFrame, start: Classes, both: np.ndarray, settled: int, upto: int, rounds: int) -> tuple[Classes, np.ndarray]:
    """Classes after rounds over the words at the places ``settled`` to ``upto``, and their class bigrams."""
    spark, k = texts.sparkSession, start.n
    groups = -(-upto // _GROUP_WORDS)
    best = (likelihood(both), start, both)
    now = start
    if settled >= upto or not rounds:
        return start, both
    for turn in range(rounds + 1):  # the last turn only measures
        part = turn % PARTS if turn < rounds else -1
        keys = _contexts(spark.sparkContext.broadcast(now), settled, upto, part)
        counted = texts.mapInArrow(W.lean(_counted(keys, _grouped(2 * k + 1, groups))), "bucket int, data binary")
        if part >= 0:
            counted = materialize(counted, "contexts")
        found = counted.where("bucket < 0").groupBy("bucket").applyInArrow(W.lean_group(_bigrams(k)), "key long, n long").toArrow()
        measured = np.bincount(found["key"].to_numpy(), found["n"].to_numpy(), minlength=k * k).reshape(k, k)
        if likelihood(measured) < best[0] - 1e-6 * abs(best[0]):
            break
        best = (likelihood(measured), now, measured)
        if part < 0:
            break
        moved = counted.where("bucket >= 0").groupBy("bucket").applyInArrow(
            W.lean_group(_moves(spark.sparkContext.broadcast((measured, now.of_word)), groups)), "place long, class long").toArrow()
        of_word = now.of_word.copy()
        of_word[moved["place"].to_numpy()] = moved["class"].to_numpy()
        now = Classes(now.types, now.of_type, of_word, k)
    return best[1], best[2]


@dataclass
class Model:
    classes: Classes
    counts: np.ndarray      # of the first listed words
    transition: np.ndarray  # log10 P(class | class before)
    log_size: np.ndarray    # log10 of the tokens of each class
    log_unseen: float       # log10 of the tokens that an unknown word stands for
    unseen: float           # unknown words that are reckoned with
    discount: float
    tokens: int             # N
    words: int              # V, the end included
    texts: int


def _log10(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def train(docs: DataFrame, *, text: str = "text", shipped: int = SHIPPED, types: int = TYPES, tails: int = ENDINGS,
          classes: int = CLASSES, floor: int = FLOOR, rounds: int = ROUNDS,
          clustered: int = CLUSTERED) -> tuple[Model, DataFrame]:
    """Model and table of all word counts (``word, ending, n``) of ``docs``."""
    spark = docs.sparkSession
    counts = materialize(word_counts(docs, text), "word-counts")
    texts = docs.count()
    levels = levels_of(counts)
    total = sum(r["tokens"] for r in levels) + texts
    distinct = sum(r["words"] for r in levels) + (1 if texts else 0)
    above = sum(r["words"] for r in levels if r["level"] >= int(8 * math.log2(floor) + 1e-9))  # and some below it
    top = most_frequent(counts, max(shipped, min(above, clustered)), levels)
    by = np.lexsort((top["word"].to_numpy(), -top["n"].to_numpy()))
    words, n, ending = (top[c].to_numpy()[by] for c in ("word", "n", "ending"))
    upto = min(clustered, int((n >= floor).sum()))
    listed = max(shipped, upto)
    words, n, ending = words[:listed], n[:shipped], ending[:listed]
    head = words[:types]
    frequent = spark.createDataFrame([(int(w),) for w in head], "word long")
    rest = counts.join(F.broadcast(frequent), "word", "left_anti")
    found = rest.groupBy("ending").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").limit(tails).toArrow()
    tail = np.sort(found["ending"].to_numpy().astype(np.int64))
    size = len(head) + len(tail) + 2
    kinds = Types(words.view(np.uint64), np.zeros(len(words), np.int64), tail, len(head) + np.arange(len(tail)), size)
    kinds.of_word = np.concatenate([np.arange(len(head)), kinds.of_ending(ending[len(head):].astype(np.int64))]).astype(np.int32)

    only = docs.select(F.col(text).alias("text"))
    rows = only.mapInArrow(W.lean(_counted(_type_pairs(spark.sparkContext.broadcast(kinds)), _plain)), "key long, n long").groupBy("key").agg(
        F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(size * size)  # bounded by the number of types
    pairs[rows["key"].to_numpy()] = rows["n"].to_numpy()
    pairs = pairs.reshape(size, size)
    at = exchange(pairs, classes)

    k = classes + 1
    one = np.zeros((size, k))
    one[np.arange(size), at] = 1
    own, both = _exchange_all(only, Classes(kinds, at, at[kinds.of_word].astype(np.int16), k), one.T @ pairs @ one, len(head), upto, rounds)
    n_class, n_before, kinds_after = both.sum(0), both.sum(1), (both > 0).sum(1)
    alone = (n_class + 1) / (n_class.sum() + k)
    # Witten-Bell: as many unseen transitions as there are kinds of seen ones.
    weight = np.maximum(kinds_after, 1)[:, None]
    transition = _log10((both + weight * alone) / (n_before[:, None] + weight))

    once, twice = sum(r["once"] for r in levels), sum(r["twice"] for r in levels)
    discount = min(0.95, max(0.05, once / max(once + 2 * twice, 1)))
    unseen = max(once * (once - 1) / (2 * (twice + 1)), distinct, 1)
    # A class leaves `discount` for each of its words, and has its share of the unknown words.
    model = Model(own, n, transition, _log10(np.maximum(n_class, 1)), math.log10(discount * max(distinct, 1) / unseen), unseen, discount,
                  total, distinct, texts)
    return model, counts


def _score(shipped):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shipped.value
        end = len(m.log_size) - 1
        top_base, top_model = np.log10(m.counts + 1.0), np.log10(m.counts - m.discount)
        start = TaskContext.get().partitionId() << 33
        for batch in rows:
            for a, b, words in W.batches(batch.column(1)):
                n = b - a
                hashes = words.hashes()
                klass, place = m.classes.of(words, hashes)
                before, kind, owner = _sequence(words, klass, end)
                path = np.bincount(owner, m.transition[before, kind] - m.log_size[kind], minlength=n)
                word_owner = np.repeat(np.arange(n), words.counts())
                known = (place >= 0) & (place < len(m.counts))
                of, at = word_owner[known], place[known]
                stop = math.log10(max(m.texts - m.discount, 1e-9)) if m.texts else m.log_unseen
                base = np.bincount(of, top_base[at], minlength=n) + math.log10(m.texts + 1.0)
                model = path + np.bincount(of, top_model[at], minlength=n) + stop
                # The other words of each text, each once.
                rare = np.flatnonzero(~known)
                salted = hashes[rare] ^ W.mix(word_owner[rare].astype(np.uint64) + np.uint64(1))
                _, first, times = np.unique(salted, return_index=True, return_counts=True)
                pick = rare[first]
                order = np.argsort(word_owner[pick], kind="stable")
                pick, times = pick[order], times[order]
                ends = np.concatenate([[0], np.cumsum(np.bincount(word_owner[pick], minlength=n))]).astype(np.int32)
                listed = pa.StructArray.from_arrays(
                    [pa.array(hashes[pick].view(np.int64)), pa.array(times.astype(np.int32))], ["word", "times"])
                counts = words.counts()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(start + np.arange(n)), batch.column(0).slice(a, n), pa.array(counts + 1),
                     pa.array(np.bincount(of, minlength=n) + (1 if m.texts else 0)), pa.array(base), pa.array(model),
                     pa.ListArray.from_arrays(pa.array(ends), listed)],
                    ["row_id", "doc_id", "n_tokens", "n_known", "base", "model", "rare"])
                start += n
    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    The end of a text counts as a token. ``base_score`` sums
    ``log10((c + 1) / (N + V + 1))``; ``score`` is the model's log10
    probability; an unknown word has one share of what its class leaves for
    unknown words. A null or empty text is its end alone. Ids may be null or repeat.
    """
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        W.lean(_score(docs.sparkSession.sparkContext.broadcast(model))),
        f"row_id long, doc_id {kind}, n_tokens long, n_known long, base double, model double, "
        "rare array<struct<word:long,times:int>>"), "scores")
    each = rows.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", "r.times")
    joined = each.join(counts.select("word", "n"), "word", "left")
    sums = joined.groupBy("row_id").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("base_more"),
        F.sum(F.col("times") * F.coalesce(F.log10(F.col("n") - model.discount), F.lit(model.log_unseen))).alias("model_more"))
    out = rows.drop("rare").join(sums, "row_id", "left")
    more = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + more("known")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more("base_more") - F.col("n_tokens") * math.log10(model.tokens + model.words + 1)).alias("base_score"),
        (F.col("model") + more("model_more")).alias("score"))


def report(docs: DataFrame, *, fold: int = 2, folds: int = 7, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Scores of all rows by a model of those outside the fold, with ``held_out``."""
    model, counts = train(docs.where(remainder(F.col(doc_id), folds) != fold), text=text, **how)
    out = score(docs, model, counts, doc_id=doc_id, text=text)
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == fold).alias("held_out"),
                      "n_tokens", "n_known", "train_tokens", "base_score", "score")
