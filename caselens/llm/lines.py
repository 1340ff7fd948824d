"""Near-duplicate lines across documents, by an exact set-similarity join.

A line's set holds its distinct words. Of two lines whose sets have a Jaccard
similarity of ``threshold`` or more, the later one (by document, then line) is
removed; a line is compared with all earlier ones, removed or not.

Words are ordered from rare to frequent. Two similar sets share a word of their
prefixes, so only prefixes are exchanged (Chaudhuri et al., 2006; Xiao et al.,
"Efficient similarity joins for near duplicate detection", 2008). Where two
prefixes meet, the sizes, the positions of the shared word and a 128-bit parity
sketch of the sets bound what they can have in common; pairs that pass are
verified on the sets. A line needs one earlier match only: it is tried with the
earliest few candidates of each word first, and only lines that none of these
removes are compared with all the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselens.llm import words as W
from caselens.llm.vocabulary import most_frequent, word_counts
from caselens.runtime import broadcast_if_small, materialize

#: Frequent words that are shipped with their counts; entries of a bucket; rows of a word before its entries are split.
SHIPPED, BUCKET_ENTRIES, PART_ROWS = 1 << 18, 1 << 19, 1_000_000
#: Candidates of a line and word that are tried first, if there are more than ``ALL``; else all of them.
FIRST, ALL = 6, 192
#: Lines compared with all others in one go.
SLOW_LINES = 200_000
#: Pairs of entries that are looked at together; few enough for the processor's cache.
PAIRS = 1 << 15

_NOT_LINE = ~W.classes((0x0A, 0x0A))
PAIR, EQUAL, DOC, MORE = range(4)
_OUT = "kind int, doc long, line int, other_doc long, other_line int"

#: One prefix word of one line; the key is a hash of the word, as entries of a bucket only. `at` is the position, at
#: most 32,767, with the top bit for lines that are compared with all others.
_ENTRY = np.dtype([("doc", "<i8"), ("low", "<u8"), ("high", "<u8"), ("key", "<u4"), ("set", "<u4"), ("line", "<i4"), ("size", "<i4"), ("at", "<u2")])
_SLOW = 1 << 15


def need(total: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least common elements of similar sets with ``total`` elements together."""
    return -(-num * total // (num + den))


class Order:
    """Words from rare to frequent: those not shipped by hash, then the shipped ones by count and hash."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        by = np.lexsort((words, counts))
        self.counts = counts[by]
        self.lookup = W.Lookup(words[by])

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """Below 2**44; two words that are not shipped may share a rank."""
        place = self.lookup.find(hashes)
        return np.where(place >= 0, (1 << 43) + place, (hashes >> np.uint64(21)).astype(np.int64))

    def parts(self, hashes: np.ndarray) -> np.ndarray:
        """Into how many parts the entries of a word go."""
        place = self.lookup.find(hashes)
        out = np.ones(len(hashes), np.int64)
        out[place >= 0] += self.counts[place[place >= 0]] // PART_ROWS
        return out


@dataclass
class Lines:
    """Lines with words: their text, their number in it (from 1), and their distinct words from rare to frequent."""

    text: np.ndarray
    number: np.ndarray
    start: np.ndarray
    value: np.ndarray

    def size(self) -> np.ndarray:
        return np.diff(self.start)

    def take(self, pick: np.ndarray) -> Lines:
        size = self.size()[pick]
        at = np.repeat(self.start[pick] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return Lines(self.text[pick], self.number[pick], np.concatenate([[0], np.cumsum(size)]).astype(np.int64), self.value[at])

    def ids(self, salt: int) -> np.ndarray:
        """One 64-bit number per set."""
        if not len(self.text):
            return np.zeros(0, np.uint64)
        return W.mix(np.add.reduceat(W.mix(self.value ^ np.uint64(salt)), self.start[:-1]) + self.size().astype(np.uint64))

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """Parity of the words in each of 128 cells. Two sets differ in at least as many words as sketches in bits."""
        if not len(self.text):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        cell = W.mix(self.value.copy())
        bit = np.uint64(1) << (cell >> np.uint64(58))
        upper = (cell & np.uint64(1)).astype(np.uint64)
        return (np.bitwise_xor.reduceat(bit * (np.uint64(1) - upper), self.start[:-1]),
                np.bitwise_xor.reduceat(bit * upper, self.start[:-1]))


def lines_of(words: W.Words, offsets: np.ndarray, order: Order | None, wanted=None) -> Lines:
    """Lines of a slice of texts. ``wanted(text, number, hashes)`` may give a mask of words whose lines are left out."""
    breaks = np.flatnonzero(words.data == 0x0A)
    text = np.repeat(np.arange(len(offsets) - 1), words.counts())
    before = np.cumsum(np.bincount(np.searchsorted(words.starts, breaks), minlength=len(text) + 1))[:len(text)]  # breaks before each word
    number = before - np.searchsorted(breaks, offsets)[text] + 1
    hashes = words.hashes()
    if wanted is not None and len(text):
        keep = wanted(text, number, hashes)
        text, number, hashes = text[keep], number[keep], hashes[keep]
    if not len(text):
        none = np.zeros(0, np.int64)
        return Lines(none, none, np.zeros(1, np.int64), np.zeros(0, np.uint64))
    new = np.concatenate([[True], (number[1:] != number[:-1]) | (text[1:] != text[:-1])])
    line = np.cumsum(new) - 1
    rank = order.rank(hashes) if order is not None else (hashes >> np.uint64(20)).astype(np.int64)
    if line[-1] < 1 << 19:
        key = (line << 44) | rank
        by = np.argsort(key)
        key, h = key[by], hashes[by]
        same = key[1:] == key[:-1]
        tied = bool((same & (h[1:] != h[:-1])).any())
    else:
        tied = True
    if tied:
        by = np.lexsort((hashes, rank, line))
        h = hashes[by]
    of = line[by]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
    start = np.concatenate([[0], np.cumsum(np.bincount(of[first]))])
    return Lines(text[new], number[new], start, h[first])


def _batch_lines(texts: pa.Array, order: Order | None, wanted=None) -> Lines:
    """Lines of all texts of a batch."""
    return _sliced_lines(*W.texts_buffer(texts), order, wanted)


def _sliced_lines(data: np.ndarray, offsets: np.ndarray, order: Order | None, wanted=None) -> Lines:
    found = []
    for a, b in W.slices(offsets):
        part = offsets[a:b + 1]
        own = part - part[0]
        ask = None if wanted is None else (lambda t, n, h, a=a: wanted(t + a, n, h))
        one = lines_of(W.words(data[part[0]:part[-1]], own), own, order, ask)
        one.text += a
        found.append(one)
    if not found:
        none = np.zeros(0, np.int64)
        return Lines(none, none, np.zeros(1, np.int64), np.zeros(0, np.uint64))
    size = np.concatenate([x.size() for x in found])
    return Lines(np.concatenate([x.text for x in found]), np.concatenate([x.number for x in found]),
                 np.concatenate([[0], np.cumsum(size)]).astype(np.int64), np.concatenate([x.value for x in found]))


def prefixes(own: Lines, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix words of each line: ``(line, position, word)``."""
    size = own.size()
    length = size - (-(-num * size // den)) + 1
    line = np.repeat(np.arange(len(size)), length)
    position = np.arange(len(line)) - np.repeat(np.cumsum(length) - length, length)
    return line, position, own.value[own.start[line] + position]


def _entries(own: Lines, doc: np.ndarray, ident: np.ndarray, order: Order, num: int, den: int, words=None) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket hash, entries)`` of the prefixes; ``words`` (sorted): of these words only."""
    line, position, word = prefixes(own, num, den)
    if words is not None:
        keep = words[np.minimum(np.searchsorted(words, word), len(words) - 1)] == word
        line, position, word = line[keep], position[keep], word[keep]
    low, high = own.signatures()
    out = np.zeros(len(line), _ENTRY)
    for field, x in (("doc", doc[line]), ("set", (ident >> np.uint64(32))[line]), ("line", own.number[line]), ("low", low[line]), ("high", high[line]), ("size", own.size()[line]),
                     ("at", np.minimum(position, _SLOW - 1))):
        out[field] = x
    # The entries of a very frequent word are dealt into parts, and every two parts meet in a block of their own.
    parts = order.parts(word)
    block = np.zeros(len(out), np.int64)
    if len(parts) and parts.max() > 1:
        part = (W.mix(out["doc"].astype(np.uint64) * np.uint64(31) + out["line"].astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
        copies = np.repeat(np.arange(len(out)), parts)
        other = np.arange(len(copies)) - np.repeat(np.cumsum(parts) - parts, parts)
        mine = part[copies]
        block = np.minimum(mine, other) * parts[copies] + np.maximum(mine, other)
        out, word = out[copies], word[copies]
    key = W.mix(word + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out["key"] = key & np.uint64(0xFFFFFFFF)
    return key >> np.uint64(40), out


def _emit(order, num: int, den: int, buckets: int, slow=None):
    """Prefix entries of the first line of each distinct set of a batch, the other lines, and line counts.

    ``slow`` (documents, lines, words): only entries of these words, the given lines marked.
    """
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: Order = order.value
        docs, numbers, asked = slow.value if slow is not None else (None, None, None)
        for batch in W.smaller(rows):
            names = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            wanted = None
            if asked is not None:
                words = W.Lookup(asked)

                def wanted(text, number, hashes, words=words):  # lines that hold one of the words
                    line = np.cumsum(np.concatenate([[True], (number[1:] != number[:-1]) | (text[1:] != text[:-1])])) - 1
                    return np.bincount(line, words.find(hashes) >= 0)[line] > 0

            own = _batch_lines(batch.column(1), ranks, wanted)
            doc = names[own.text]
            one, two = own.ids(0x452821E638D01377), own.ids(0xBE5466CF34E90C6C)
            by = _by_set(one, two, doc, own.number)
            head = np.concatenate([[True], (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])]) if len(by) else np.zeros(0, bool)
            lead = by[head]
            if slow is None:
                rest = by[~head]
                of = lead[(np.cumsum(head) - 1)[~head]]
                later = (doc[rest] != doc[of]) | (own.number[rest] != own.number[of])
                rest, of = rest[later], of[later]
                table = np.zeros(len(rest) + len(names), _ROW)
                table["kind"][:len(rest)] = EQUAL
                for field, x in (("doc", doc[rest]), ("line", own.number[rest]), ("other_doc", doc[of]), ("other_line", own.number[of])):
                    table[field][:len(rest)] = x
                table["kind"][len(rest):] = DOC
                table["doc"][len(rest):] = names
                table["line"][len(rest):] = np.bincount(own.text, minlength=len(names))
                anywhere = W.mix(table["doc"].astype(np.uint64))
                yield from _pack((anywhere % np.uint64(buckets)).astype(np.int64), table, "rows")
                sets = np.zeros(len(lead), _SET)
                for field, x in (("one", one[lead]), ("two", two[lead]), ("doc", doc[lead]), ("line", own.number[lead])):
                    sets[field] = x
                yield from _pack(((one[lead] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), sets, "sets")
            lead = np.sort(lead)
            kept = own.take(lead)
            where, entries = _entries(kept, doc[lead], one[lead], ranks, num, den, asked)
            if slow is not None and len(entries):
                ref, refs = _ref(entries["doc"], entries["line"]), np.sort(_ref(docs, numbers))
                entries["at"] |= np.where(np.isin(ref, refs), _SLOW, 0).astype(np.uint16)
            yield from _pack((where % np.uint64(buckets)).astype(np.int64), entries, "entries")
    return run


def _by_set(one: np.ndarray, two: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Lines by set, document and number; only those that share ``one`` are compared further."""
    by = np.argsort(one)
    same = one[by][1:] == one[by][:-1]
    several = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(by) else by
    part = by[several]
    by[several] = part[np.lexsort((line[part], doc[part], two[part], one[part]))]
    return by


def _ref(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    out = np.zeros(len(doc), [("d", "<i8"), ("l", "<i4")])
    out["d"], out["l"] = doc, line
    return out


_ROW = np.dtype([("doc", "<i8"), ("other_doc", "<i8"), ("kind", "<i4"), ("line", "<i4"), ("other_line", "<i4")])
_SET = np.dtype([("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("line", "<i4")])
_KINDS = {"rows": _ROW, "sets": _SET, "entries": _ENTRY}


def _pack(bucket: np.ndarray, values: np.ndarray, what: str) -> Iterator[pa.RecordBatch]:
    if len(bucket) and bucket.max() < 1 << 16:  # sorted by digits
        bucket = bucket.astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket, values = bucket[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    end = np.append(first[1:], len(bucket))
    if len(first):
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[first].astype(np.int32)), pa.array([what] * len(first)),
             pa.array([values[a:b].tobytes() for a, b in zip(first, end, strict=True)], pa.binary())], ["bucket", "what", "data"])


def _runs(x: np.ndarray) -> np.ndarray:
    """Start of the run of equal values that each position is in."""
    first = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(first, np.arange(len(x)), 0)) if len(x) else np.zeros(0, np.int64)


def candidates(e: np.ndarray, num: int, den: int, keep: int | None, most: int = ALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of entries that may be similar, ``(earlier, later)``, and later entries of pairs that were left out.

    With ``keep``, the earliest ``keep`` partners of each later entry that has more than ``most``, and all of the
    others; without, all pairs with a marked entry. Lines of equal sets (same size, sketch and 32 bits of the set's
    hash) have equal keys: the earliest one stands for them, as the others are removed anyway.
    """
    e = _first_of_sets(e)
    n = len(e)
    size, low, high = e["size"].astype(np.int64), e["low"].copy(), e["high"].copy()
    at, slow = (e["at"] & (_SLOW - 1)).astype(np.int64), e["at"] >= _SLOW
    place = _places(e)
    # Sizes rise within a key: partners of i from i + 1 on, up to the largest size that can match.
    joint = _runs(e["key"]) * (int(size.max()) * den + 1 if n else 1) + size
    top = np.searchsorted(joint, joint - size + size * den // num, "right")
    count = top - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(count)])
    early, late = np.zeros(0, np.int64), np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    done = held = 0
    while done < n:
        end = max(done + 1, int(np.searchsorted(total, total[done] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(done, end), count[done:end])
        j = i + 1 + np.arange(len(i)) - (total[i] - total[done])
        done = end
        if keep is None:
            some = slow[i] | slow[j]
            i, j = i[some], j[some]
        both = size[i] + size[j]
        common = need(both, num, den)
        ok = 1 + np.minimum(size[i] - at[i] - 1, size[j] - at[j] - 1) >= common
        i, j, room = i[ok], j[ok], (both - 2 * common)[ok]
        ok = np.bitwise_count(low[i] ^ low[j]).astype(np.int64) + np.bitwise_count(high[i] ^ high[j]) <= room
        i, j = i[ok], j[ok]
        other = place[i] != place[j]
        i, j = i[other], j[other]
        swap = place[i] > place[j]
        found.append((np.where(swap, j, i), np.where(swap, i, j)))
        held += len(i)
        if keep is not None and held > 2_000_000:  # one more than `most` tells that there are too many
            early, late = _earliest(*map(np.concatenate, zip(*found, strict=True)), place, most + 1)
            found, held = [(early, late)], len(early)
    if found:
        early, late = map(np.concatenate, zip(*found, strict=True))
    left_out = np.zeros(0, np.int64)
    if keep is not None and len(late):
        early, late = _earliest(early, late, place, most + 1)
        begin = _runs(late)
        many = np.bincount(begin, minlength=len(late))[begin] > most
        out = many & (np.arange(len(late)) - begin >= keep)
        left_out = np.unique(late[out])
        early, late = early[~out], late[~out]
    # Two lines that meet by several words are one pair.
    once = np.unique(place[late] * (n + 1) + place[early], return_index=True)[1]
    early, late = early[once], late[once]
    return e[early], e[late], e[left_out]


def _first_of_sets(e: np.ndarray) -> np.ndarray:
    """Entries by key and size, the first line of each set only; entries that share their key with no other are left out."""
    joint = e["key"].astype(np.uint64) << np.uint64(32) | e["size"].astype(np.uint64)
    order = np.argsort(joint)
    joint = joint[order]
    key = joint >> np.uint64(32)
    meet = key[1:] == key[:-1]
    meet = np.flatnonzero(np.concatenate([meet, [False]]) | np.concatenate([[False], meet])) if len(e) else order
    e, joint = e[order[meet]], joint[meet]
    if len(e) < 2:
        return e
    same = joint[1:] == joint[:-1]
    several = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    part = e[several]
    part = part[np.lexsort((part["line"], part["doc"], part["set"], part["high"], part["low"], joint[several]))]
    e[several] = part
    new = np.ones(len(e), bool)
    new[1:] = ~same
    for field in ("low", "high", "set"):
        new[1:] |= e[field][1:] != e[field][:-1]
    first = np.flatnonzero(new)
    marked = np.maximum.reduceat(e["at"] & _SLOW, first)
    e = e[first]
    e["at"] |= marked
    return e


def _places(e: np.ndarray) -> np.ndarray:
    """Numbers in order of the lines, equal ones for entries of the same line."""
    order = np.lexsort((e["line"], e["doc"]))
    doc, line = e["doc"][order], e["line"][order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])]) if len(e) else np.zeros(0, bool)
    out = np.empty(len(e), np.int64)
    out[order] = np.cumsum(new)
    return out


def _earliest(early: np.ndarray, late: np.ndarray, place: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` earliest partners of each later entry."""
    order = np.lexsort((place[early], late))
    early, late = early[order], late[order]
    kept = np.arange(len(late)) - _runs(late) < most
    return early[kept], late[kept]


def _meet(num: int, den: int, keep: int | None, most: int = ALL):
    def run(group: pa.Table) -> pa.Table:
        def joined(what: str) -> np.ndarray:
            rows = group.filter(pa.array(np.array(group["what"].to_pylist()) == what))
            return np.concatenate([np.zeros(0, _KINDS[what])] + [np.frombuffer(x.as_buffer(), _KINDS[what]) for x in rows["data"]])

        out = [joined("rows")]
        sets = joined("sets")
        sets = sets[_by_set(sets["one"], sets["two"], sets["doc"], sets["line"])]
        lead = np.maximum(_runs(sets["one"]), _runs(sets["two"]))
        rest = np.flatnonzero((sets["doc"] != sets["doc"][lead]) | (sets["line"] != sets["line"][lead]))
        out.append(_rows(EQUAL, sets[rest], sets[lead[rest]]))
        early, late, more = candidates(joined("entries"), num, den, keep, most)
        out += [_rows(PAIR, late, early), _rows(MORE, more, more)]
        every = np.concatenate(out)
        return pa.table({"kind": every["kind"], "doc": every["doc"], "line": every["line"],
                         "other_doc": every["other_doc"], "other_line": every["other_line"]})
    return run


def _rows(kind: int, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    out = np.zeros(len(own), _ROW)
    out["kind"] = kind
    out["doc"], out["line"], out["other_doc"], out["other_line"] = own["doc"], own["line"], other["doc"], other["line"]
    return out


def similar_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: tuple[int, int] = (4, 5),
                  shipped: int = SHIPPED, first: int = FIRST, all_up_to: int = ALL, bucket_entries: int = BUCKET_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """``(removed, counts)``: the lines to remove (``doc, line``) and ``doc, lines`` of every row with an id."""
    spark = docs.sparkSession
    num, den = threshold
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    counts = materialize(word_counts(rows, "text", ends=False, singly=False), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = most_frequent(counts.where("word is not null"), shipped)
    order = spark.sparkContext.broadcast(Order(top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()))
    buckets = 1
    while buckets * bucket_entries < 0.2 * total:
        buckets *= 2

    def exchange(keep: int | None, slow=None) -> DataFrame:
        packed = rows.mapInArrow(W.lean(_emit(order, num, den, buckets, slow)), "bucket int, what string, data binary")
        return materialize(packed.groupBy("bucket").applyInArrow(W.lean_group(_meet(num, den, keep, all_up_to)), _OUT), "lines")

    found = exchange(first)
    equal = found.where(F.col("kind") == EQUAL).select("doc", "line", "other_doc", "other_line")
    removed = equal.select("doc", "line")

    def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The later lines of the pairs that are similar."""
        a = sets.select("doc", "line", F.col("words").alias("a"))
        b = sets.select(F.col("doc").alias("other_doc"), F.col("line").alias("other_line"), F.col("words").alias("b"))
        both = pairs.join(a, ["doc", "line"]).join(b, ["other_doc", "other_line"])
        common = F.size(F.array_intersect("a", "b"))
        return materialize(both.where(common * den >= (F.size("a") + F.size("b") - common) * num).select("doc", "line").distinct(), "similar")

    def settle(pairs: DataFrame) -> DataFrame:
        # Words that a pair shares in the prefixes: the partner with most of them is tried first.
        pairs = materialize(pairs.groupBy("doc", "line", "other_doc", "other_line").agg(F.count("*").alias("votes")), "pairs")
        sets = _sets(rows, pairs.select("doc", "line").union(pairs.select("other_doc", "other_line")).distinct())
        best = Window.partitionBy("doc", "line").orderBy(F.desc("votes"), "other_doc", "other_line")
        ranked = pairs.withColumn("rank", F.row_number().over(best)).drop("votes")
        gone = similar(ranked.where("rank = 1").drop("rank"), sets)
        rest = materialize(ranked.where("rank > 1").drop("rank").join(gone, ["doc", "line"], "left_anti"), "pairs")
        return gone.unionByName(similar(rest, sets)) if rest.limit(1).count() else gone

    gone = settle(found.where(F.col("kind") == PAIR))
    removed = removed.unionByName(gone)
    more = found.where(F.col("kind") == MORE).select("doc", "line").distinct()
    more = materialize(more.join(removed.distinct(), ["doc", "line"], "left_anti"), "more")
    rounds = -(-more.count() // SLOW_LINES)
    for turn in range(rounds):
        own = more.where(F.pmod(F.xxhash64("doc", "line"), F.lit(rounds)) == turn)
        refs = own.toArrow()  # about SLOW_LINES rows
        words = _prefix_words(rows, own, order, num, den).toArrow()["word"].to_numpy().view(np.uint64)
        slow = spark.sparkContext.broadcast((refs["doc"].to_numpy(), refs["line"].to_numpy(), np.sort(words)))
        removed = removed.unionByName(settle(exchange(None, slow).where(F.col("kind") == PAIR)))
    return removed.distinct(), found.where(F.col("kind") == DOC).select("doc", F.col("line").alias("lines"))


def _wanted(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Documents with the lines asked for, as ``doc, text, lines``."""
    lines = refs.groupBy("doc").agg(F.collect_set("line").alias("lines"))  # at most the lines of one document
    return rows.join(broadcast_if_small(lines), "doc")


def _asked(batch: pa.RecordBatch, order: Order | None) -> Lines:
    """The lines of a batch that its third column asks for. They are cut out first, so that no other words are looked at."""
    lists = batch.column(2)
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    asked = np.unique(owner.astype(np.int64) << 32 | lists.flatten().to_numpy().astype(np.int64))
    text, number = asked >> 32, asked & 0xFFFFFFFF
    data, offsets = W.texts_buffer(batch.column(1))
    breaks = np.flatnonzero(data == 0x0A)
    before = np.searchsorted(breaks, offsets)
    there = number <= np.diff(before)[text] + 1  # rows that repeat an id may have fewer lines
    text, number = text[there], number[there]
    # A line is what lies between two breaks; each text has one in front, and one at its end.
    first = before[text] + number - 1
    cuts = np.concatenate([[-1], breaks, [len(data)]])
    start = np.maximum(cuts[first] + 1, offsets[text])
    end = np.minimum(cuts[first + 1], offsets[text + 1])
    size = end - start
    total = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    own = _sliced_lines(data[np.repeat(start - total[:-1], size) + np.arange(total[-1])], total, order)
    return Lines(text[own.text], number[own.text], own.start, own.value)


def _sets(rows: DataFrame, refs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.smaller(batches):
            own = _asked(batch, None)
            names = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[own.text]), pa.array(own.number.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(own.start.astype(np.int32)), pa.array(own.value.view(np.int64)))], ["doc", "line", "words"])
    return materialize(_wanted(rows, refs).mapInArrow(W.lean(run), "doc long, line int, words array<long>").dropDuplicates(["doc", "line"]), "sets")


def _prefix_words(rows: DataFrame, refs: DataFrame, order, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.smaller(batches):
            _, _, word = prefixes(_asked(batch, order.value), num, den)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(word).view(np.int64))], ["word"])
    return _wanted(rows, refs).mapInArrow(W.lean(run), "word long").distinct()


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` of every row; ``removed`` lists line numbers (from 1), comma-joined.

    Lines are parted by line feeds; ``n_lines`` counts those that hold a word
    (a run without ASCII white space, A-Z in lower case), and no other is
    removed. Null or empty texts have no lines. Ids are integers; a row
    without one takes no part and has nulls. Rows that repeat an id share its
    lines: lines at the same place of equal ids are not later than each other.
    """
    removed, counts = similar_lines(docs, doc_id=doc_id, text=text, **how)
    own = removed.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("gone"))  # at most the lines of one document
    out = counts.join(own, "doc", "left")
    known = out.select(
        F.col("doc").alias("doc_id"), F.col("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.concat_ws(",", F.col("gone").cast("array<string>")), F.lit("")).alias("removed"))
    nulls = docs.where(F.col(doc_id).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_lines"),
        F.lit(None).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("removed"))
    return known.unionByName(nulls)


def clean(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the removed lines; the columns stay."""
    removed, _ = similar_lines(docs, doc_id=doc_id, text=text, **how)
    own = removed.groupBy("doc").agg(F.collect_set("line").alias("gone"))
    # Rows travel as one column, so that no name of theirs can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id")).join(own, F.col("id") == F.col("doc"), "left")
    body = F.col("row").getField(text)
    kept = F.array_join(F.filter(F.split(body, "\n", -1), lambda x, i: ~F.array_contains("gone", i + 1)), "\n")
    kept = F.when(F.col("gone").isNull(), body).otherwise(kept)
    return rows.select(*[(kept if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
