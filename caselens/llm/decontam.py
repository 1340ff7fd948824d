"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every stretch of consecutive words of every test item.
Training texts are streamed through it word by word; the longest match that
ends at a word tells which windows end there. Before that, a filter on hashes
of short word runs, as array operations, leaves only stretches that can match,
so almost no word of a clean text is streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from caselens.llm import words as W
from caselens.runtime import materialize

WINDOW = 13
#: Words per automaton; more items make several automata, applied one after the other.
AUTOMATON_WORDS = 250_000
_GRAM = 4
_BITS = 22


class Automaton:
    """Suffix automaton of several word sequences, and where windows and short items end in it."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[str, int] = {}
        self.next: dict[tuple[int, int], int] = {}
        self.link, self.length = [-1], [0]
        self.out: list[list[int]] = [[]]  # the words that lead on from a state
        runs = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, run in runs:
            last = 0
            for c in run:
                last = self._extend(last, c)
        self.items: dict[int, set[str]] = {}                     # state of a window: items with it
        self.short: dict[int, list[tuple[int, set[str]]]] = {}   # state of a short item: its length, items
        for name, run in runs:
            state = 0
            for i, c in enumerate(run):
                state = self.next[state, c]
                if i + 1 >= window:
                    self.items.setdefault(self.at_length(state, window), set()).add(name)
            if len(run) < window:
                held = self.short.setdefault(self.at_length(state, len(run)), [])
                if not held:
                    held.append((len(run), set()))
                held[0][1].add(name)
        del self.out

    def _state(self, length: int, link: int, source: int | None = None) -> int:
        new = len(self.link)
        self.link.append(link)
        self.length.append(length)
        self.out.append([])
        if source is not None:
            for c in self.out[source]:
                self._put(new, c, self.next[source, c])
        return new

    def _put(self, state: int, c: int, to: int) -> None:
        if (state, c) not in self.next:
            self.out[state].append(c)
        self.next[state, c] = to

    def _split(self, state: int, c: int, to: int) -> int:
        """The state of the stretches of ``to`` that are one word longer than ``state``."""
        if self.length[to] == self.length[state] + 1:
            return to
        part = self._state(self.length[state] + 1, self.link[to], to)
        self.link[to] = part
        while state != -1 and self.next.get((state, c)) == to:
            self._put(state, c, part)
            state = self.link[state]
        return part

    def _extend(self, last: int, c: int) -> int:
        known = self.next.get((last, c))
        if known is not None:
            return self._split(last, c, known)
        new = self._state(self.length[last] + 1, 0)
        state = last
        while state != -1 and (state, c) not in self.next:
            self._put(state, c, new)
            state = self.link[state]
        if state != -1:
            self.link[new] = self._split(state, c, self.next[state, c])
        return new

    def at_length(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a match in ``state``."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def stream(self, run: list[str]) -> Iterator[tuple[int, int, set[str]]]:
        """``(end, words, items)`` of every window and short item that ends in ``run``."""
        state = length = 0
        for i, word in enumerate(run):
            c = self.ids.get(word)
            if c is None:
                state = length = 0
                continue
            while state and (state, c) not in self.next:
                state = self.link[state]
                length = self.length[state]
            state = self.next.get((state, c), 0)
            length = length + 1 if state else 0
            if length >= self.window:
                found = self.items.get(self.at_length(state, self.window))
                if found:
                    yield i + 1, self.window, found
            if self.short:
                back = state
                while back:
                    for size, found in self.short.get(back, ()):
                        if size <= length:
                            yield i + 1, size, found
                    back = self.link[back]


class Scanner:
    """Finds the windows of one automaton in slices of texts."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.automaton = Automaton(items, window)
        lengths = [len(ws) for _, ws in items if ws]
        self.least = min([window, *lengths])
        # Items of fewer words than a gram are matched by the hash of the whole item first.
        self.grams: dict[int, np.ndarray] = {}
        sizes = {min(n, _GRAM, window) for n in lengths}
        for size in sizes:
            table = np.zeros(1 << _BITS, bool)
            for _, ws in items:
                if len(ws) >= size and (len(ws) == size or size == min(_GRAM, window)):
                    table[self._slot(W.windows(word_hashes(ws), size))] = True
            self.grams[size] = table
        self.long = min((n for n in lengths if n >= min(_GRAM, window)), default=0)
        self.long = min(self.long, window)

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - _BITS)).astype(np.int64)

    def stretches(self, words: W.Words) -> list[tuple[int, int]]:
        """Ranges of words that hold all matches, in order and apart."""
        hashes = words.hashes()
        mark = np.zeros(len(hashes) + 1, np.int32)
        for size, table in self.grams.items():
            grams = W.windows(hashes, size)
            if not len(grams):
                continue
            hit = table[self._slot(grams)] & W.within(words.offsets, size)
            need = max(self.long - size + 1, 1) if size == min(_GRAM, self.automaton.window) else 1
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            keep = b - a >= need
            np.add.at(mark, a[keep], 1)
            np.add.at(mark, b[keep] + size - 1, -1)
        inside = np.cumsum(mark) > 0
        edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))

    def scan(self, words: W.Words) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By text: the hit word ranges (merged, in order) and the items found. Texts without hits are left out."""
        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for a, b in self.stretches(words):
            # A stretch may run on into the next text.
            i = int(np.searchsorted(words.offsets, a, "right")) - 1
            while a < b:
                end = min(b, int(words.offsets[i + 1]))
                if end > a:
                    first = int(words.offsets[i])
                    for stop, size, found in self.automaton.stream([words.word(k) for k in range(a, end)]):
                        spans, items = out.setdefault(i, ([], set()))
                        spans.append((a - first + stop - size, a - first + stop))
                        items |= found
                a, i = max(a, end), i + 1
        return {i: (merge(spans), items) for i, (spans, items) in out.items()}


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_hashes(words: list[str]) -> np.ndarray:
    data, offsets = W.texts_buffer(pa.array(words, pa.large_string()))
    return W.words(data, offsets, np.ones(256, bool), lower=False).hashes()


def item_words(text: str | None) -> list[str]:
    found = W.words(*W.texts_buffer(pa.array([text], pa.large_string())), W.ALNUM)
    return [found.word(k) for k in range(len(found.starts))]


_SCANNERS: dict[str, Scanner] = {}


def _scanner(key: str, items: list[tuple[str, str]], window: int) -> Scanner:
    if key not in _SCANNERS:
        _SCANNERS.clear()
        W.keep("decontam", _SCANNERS.clear)  # until another operator's task
        _SCANNERS[key] = Scanner([(name, item_words(text)) for name, text in items], window)
    return _SCANNERS[key]


_SPANS = "array<struct<first:long,end:long,from:long,to:long>>"
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("from", pa.int64()), ("to", pa.int64())]))


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """Where test items occur: ``row`` (all columns of ``docs``), ``n_words``, ``spans``, ``items``.

    ``spans`` are the merged hit ranges, in words (``first`` to ``end``) and in
    bytes of the UTF-8 text (``from`` to ``to``); ``items`` the ids as sorted
    strings. A null or empty text has no words and no hits; items without
    words are never found; items that repeat a text are all found. The order
    and number of rows stay. ``benchmark`` is cut into automata of about
    ``automaton_words`` words, each of which is shipped to the tasks.
    """
    spark = docs.sparkSession
    sized = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).alias("text"))
    total = sized.agg(F.sum(F.regexp_count("text", F.lit(r"\s+")) + 1)).first()[0] or 0
    shards = max(1, -(-int(total) // automaton_words))
    fields = [StructField("row", docs.schema), StructField("n_words", LongType()),
              StructField("spans", _spans_type()), StructField("items", ArrayType(StringType()))]
    out = docs.select(F.struct("*").alias("row"), F.lit(0).cast("long").alias("n_words"),
                      F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    for shard in range(shards):
        own = sized.where(F.pmod(F.xxhash64("name", "text"), F.lit(shards)) == shard)
        items = [(r["name"], r["text"]) for r in own.collect()]  # bounded by automaton_words
        key = hashlib.sha256(repr((items, window)).encode()).hexdigest()
        if shard:
            out = materialize(out, "spans")
        out = out.mapInArrow(W.lean(_finder(spark.sparkContext.broadcast((key, items)), text, window), keeps="decontam"), StructType(fields))
    return out


def _spans_type() -> ArrayType:
    return ArrayType(StructType([StructField(n, LongType()) for n in ("first", "end", "from", "to")]))


def _finder(shipped, text: str, window: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*shipped.value, window)
        for batch in rows:
            row = batch.column(0)
            texts = row.field(row.type.get_field_index(text))
            for a, b, words in W.batches(texts, W.ALNUM):
                own = batch.slice(a, b - a)
                found = scanner.scan(words)
                spans, items = own.column(2).to_pylist(), own.column(3).to_pylist()
                starts = text_starts(words, texts, a, b) if found else None
                for i, (ranges, names) in found.items():
                    first = int(words.offsets[i])
                    old = [(s["first"], s["end"]) for s in spans[i]]
                    spans[i] = [{"first": x, "end": y, "from": int(words.starts[first + x] - starts[i]),
                                 "to": int(words.ends[first + y - 1] - starts[i])} for x, y in merge(old + ranges)]
                    items[i] = sorted(names.union(items[i]))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array(words.counts()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))],
                    ["row", "n_words", "spans", "items"])
    return run


def text_starts(words: W.Words, texts: pa.Array, a: int, b: int) -> np.ndarray:
    """Where each text of a slice starts in ``words.data``."""
    _, offsets = W.texts_buffer(texts.slice(a, b - a))
    return offsets


def report(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", coverage: int = 20,
           **how) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row.

    Contaminated: at least one word in ``coverage`` is hit.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = find(slim, benchmark, **how).select("row.doc_id", "n_words", hit_words().alias("n_hit"), "items")
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words"))).alias("contaminated"))


def hit_words() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", coverage: int = 20, long_span: int = 50,
                  **how) -> DataFrame:
    """``docs`` without test items; the columns stay.

    A document of which at least one word in ``coverage`` is hit goes. In the
    others, a hit stretch of ``long_span`` words or more is cut out and the rest
    stays; shorter hits below the coverage limit stay as they are, so a
    document without either is returned as it was.
    """
    rows = find(docs, benchmark, text=text, **how)
    clean = rows.where(~((hit_words() > 0) & (hit_words() * coverage >= F.col("n_words"))))
    cut = F.filter("spans", lambda s: s["end"] - s["first"] >= long_span)
    body = F.col("row").getField(text)
    raw = body.cast("binary")
    # Byte ranges between the cuts: from the end of one to the start of the next.
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut, lambda s: s["to"]))
    ends = F.concat(F.transform(cut, lambda s: s["from"]), F.array(F.octet_length(body).cast("long")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")),
                         lambda p: F.decode(F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), "UTF-8"))
    text_out = F.when(F.size(cut) > 0, F.array_join(pieces, "")).otherwise(body)
    return clean.select(*[text_out.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
