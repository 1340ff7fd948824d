"""Token ids of whole texts in compact files.

A token file set is a folder with two Parquet tables that Spark writes and
reads on any store:

* ``codebook``: ``id, length``, the canonical code over global counts;
* ``blocks``: one row per independent block, in ascending order of documents
  over ``(part, block)``: ``at`` (ids before it in its part), the documents
  (``doc_ids`` as int64, ``sizes`` as int64, little-endian), ``n`` ids packed
  into ``payload``, and ``checkpoints`` (bit offsets as uint32).

A document lies in one block; a block closes at ``block_ids`` ids.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselens.llm import huffman
from caselens.llm import words as W
from caselens.runtime import materialize, new_path

BLOCK_IDS = 1 << 18
PART_IDS = 1 << 23

#: The character that byte-level models know a byte by: bytes that can be seen stand for themselves, others for U+0100 and on.
_BYTE_CHARS = np.arange(256, dtype="<u2")
_BYTE_CHARS[~W.classes((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))] = np.arange(256, 256 + 68)


def _alpha(data: np.ndarray) -> np.ndarray:
    return (data | np.uint8(0x20)) - np.uint8(0x61) < 26


def _seen(data: np.ndarray) -> np.ndarray:
    """ASCII that is no white space."""
    return data - np.uint8(0x21) < 94


def _marks(data: np.ndarray) -> np.ndarray:
    """, . : ; ! ?"""
    return (data == 0x2C) | (data == 0x2E) | (data - np.uint8(0x3A) < 2) | (data == 0x21) | (data == 0x3F)


def _leads(data: np.ndarray) -> np.ndarray:
    """First bytes of U+00C0 to U+017F: letters but for two signs, no white space."""
    return data - np.uint8(0xC3) < 3


def _letter_leads(data: np.ndarray) -> np.ndarray:
    """First bytes of the letters among these; the last byte given is left out."""
    out = _leads(data)
    out[:-1] &= (data[:-1] != 0xC3) | ((data[1:] != 0x97) & (data[1:] != 0xB7))
    out[-1:] = False
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts (UTF-8, cut by ``offsets``) can be cut without a change of their ids: byte positions, text starts included.

    For byte-level tokenizers with the usual pattern (a word takes the one
    space before it; letters, digits, marks and white space part) and no
    normaliser: before a single space between two characters of which one is
    surely no white space, between a letter and a mark or line break, and
    behind a mark or a single line break before a letter.
    """
    n = len(data)
    pad = np.zeros(n + 4, np.uint8)  # pad[i + 2] is byte i; zeros count as white space
    pad[2:n + 2] = data

    def beside(of: np.ndarray, k: int = 0) -> np.ndarray:
        return of[2 + k:n + 2 + k]

    alpha, seen, marks, leads, letters = _alpha(pad), _seen(pad), _marks(pad), _leads(pad), _letter_leads(pad)
    here = beside(pad)
    letter_start = beside(alpha) | beside(letters)
    # Of the character that ends right before each byte.
    letter_end = beside(alpha, -1) | beside(letters, -2)
    seen_end = beside(seen, -1) | beside(leads, -2)
    seen_next = beside(seen, 1) | beside(leads, 1)
    cut = (here == 0x20) & (beside(pad, -1) > 0x20) & (beside(pad, 1) > 0x20) & (seen_end | seen_next)
    cut |= beside(marks) & letter_end
    cut |= beside(marks, -1) & letter_start
    line = (here == 0x0A) & seen_end
    cut |= line
    cut[1:] |= line[:-1] & letter_start[1:]
    # The bytes next to the ends of a text look at another text.
    inner = offsets[1:-1]
    for at in (inner - 1, inner, inner + 1):
        cut[at[(at >= 0) & (at < n)]] = False
    starts = offsets[:-1][np.diff(offsets) > 0]
    cut[starts] = True
    return np.flatnonzero(cut)


def _plain(tokenizer) -> bool:
    """True if a word of letters with a space or none before it goes to the model as it is, byte by byte."""
    told = json.loads(tokenizer.to_str())
    first = told["pre_tokenizer"] or {}
    added = [np.frombuffer(t["content"].encode(), np.uint8) for t in told["added_tokens"]]
    return (not told["normalizer"] and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first["add_prefix_space"]
            and all(_seen(t).any() and not _alpha(t[_seen(t)]).all() for t in added))


def _words(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of the pieces that begin at ``start`` are letters, with a space or none before them."""
    letters = _letter_leads(data)
    fits = _alpha(data) | letters
    fits[1:] |= letters[:-1]
    last = np.append(start[1:], len(data)) - 1
    fits[start[(data[start] == 0x20) & (last > start)]] = True
    return np.logical_and.reduceat(fits, start)


class PieceEncoder:
    """Encode texts piece by piece, each distinct piece once (see ``cuts``).

    Pieces that are one word of letters go to the tokenizer's model, others to the whole tokenizer.
    Pieces are known by two 64-bit hashes; were two pieces ever to share the
    first, the second tells, and the text is encoded whole.
    """

    def __init__(self, path: str, end_id: int, most_bytes: int = 48 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = _plain(self.tokenizer)
        self.end_id = end_id
        self.most = most_bytes
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted, with the row of each
        self.key_rows = np.zeros(0, np.int32)
        self.checks = np.zeros(1, np.uint64)  # by row: second hash, where its ids start, how many they are
        self.start = np.zeros(1, np.int32)
        self.count = np.zeros(1, np.int32)  # row 0 has no ids
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.near_keys = np.zeros(1 << 19, np.uint64)  # the last piece seen of each slot
        self.near_rows = np.zeros(1 << 19, np.int32)

    def held(self) -> int:
        """Bytes that the known pieces take."""
        return sum(x.nbytes for x in (self.keys, self.key_rows, self.checks, self.start, self.count)) + self.used * self.flat.itemsize

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[list[list[int]]]:
        """Ids of the pieces at these places, some at a time."""
        size = end - start
        at = np.cumsum(size) - size
        own = data[np.repeat(start - at, size) + np.arange(int(size.sum()))]
        word = _words(own, at) if self.plain else np.zeros(len(at), bool)
        chars = _BYTE_CHARS[own].tobytes().decode("utf-16-le")
        raw = own.tobytes()
        model = self.tokenizer.model
        ends, words = (at + size).tolist(), word.tolist()
        begins = at.tolist()
        for i in range(0, len(begins), 2_000):  # an encoding takes far more memory than its ids
            places = list(zip(begins[i:i + 2_000], ends[i:i + 2_000], words[i:i + 2_000], strict=True))
            rest = iter(self._encode([raw[a:b].decode("utf-8") for a, b, one in places if not one]))
            yield [[t.id for t in model.tokenize(chars[a:b])] if one else next(rest) for a, b, one in places]

    def _learn(self, keys: np.ndarray, checks: np.ndarray, pieces: Iterator[list[list[int]]]) -> np.ndarray:
        """Rows of new pieces, given by their ids; ``keys`` are sorted."""
        counts, flats = [], []
        for ids in pieces:
            counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flats.append(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(counts[-1].sum())))
        count, flat = np.concatenate(counts), np.concatenate(flats)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used:self.used + len(flat)] = flat
        rows = len(self.count) + np.arange(len(count))
        self.start = np.concatenate([self.start, (self.used + np.cumsum(count) - count).astype(np.int32)])
        self.count = np.concatenate([self.count, count.astype(np.int32)])
        self.checks = np.concatenate([self.checks, checks])
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.key_rows = np.insert(self.key_rows, at, rows.astype(np.int32))
        return rows

    def _rows(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        slot = (keys >> np.uint64(45)).astype(np.int64)
        row = np.where(self.near_keys[slot] == keys, self.near_rows[slot], 0)
        far = np.flatnonzero(row == 0)
        if len(far):
            distinct, first, which = np.unique(keys[far], return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
            known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
            found = np.zeros(len(distinct), np.int64)
            found[known] = self.key_rows[at[known]]
            new = np.flatnonzero(~known)
            if len(new):
                one = far[first[new]]
                found[new] = self._learn(distinct[new], checks[one], self._new(data, start[one], end[one]))
            row[far] = found[which]
            self.near_keys[slot[far]] = keys[far]
            self.near_rows[slot[far]] = row[far]
        return row

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, sizes)`` of the texts that ``offsets`` cut ``data`` (UTF-8) into, each with the end id."""
        if self.held() > self.most:
            self._clear()
        start = cuts(data, offsets) if len(data) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(data)) if len(start) else start
        pieces = W.Words(data, start, end, np.searchsorted(start, offsets))
        keys, checks = pieces.hashes(), pieces.hashes(second=True)
        row = self._rows(data, start, end, keys, checks)
        # The ids of all pieces, each text followed by the end id.
        count = self.count[row].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        ends = total[pieces.offsets[1:]] + np.arange(1, len(offsets))
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        ids[ends - 1] = self.end_id
        inside = np.ones(len(ids), bool)
        inside[ends - 1] = False
        ids[inside] = self.flat[np.repeat(self.start[row] - total[:-1], count) + np.arange(int(total[-1]))]
        sizes = np.diff(ends, prepend=0)
        wrong = np.flatnonzero(self.checks[row] != checks)
        if not len(wrong):
            return ids, sizes
        bad = set(np.searchsorted(pieces.offsets, wrong, "right") - 1)
        runs = np.split(ids, ends[:-1])
        for i in bad:
            text = data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8")
            runs[i] = np.array([*self._encode([text])[0], self.end_id], np.uint32)
        return np.concatenate(runs), np.array([len(r) for r in runs], np.int64)


@functools.lru_cache(maxsize=1)
def _encoder(path: str, end_id: int) -> PieceEncoder:
    W.keep("tokens", _encoder.cache_clear)  # until another operator's task
    return PieceEncoder(path, end_id)


def encode(docs: DataFrame, path: str, *, end_id: int, doc_id: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """``(doc_id, n, ids)``: ids of each text and ``end_id``, ``width`` bytes an id, little-endian."""
    kind = f"<u{width}"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end_id)
        for batch in rows:
            names = batch.column(0)
            texts, offsets = W.texts_buffer(batch.column(1))
            for a, b in W.slices(offsets, 1 << 20):
                part = offsets[a:b + 1]
                ids, sizes = encoder(texts[part[0]:part[-1]], part - part[0])
                if len(ids) and int(ids.max()) >> (8 * width):
                    raise ValueError(f"an id does not fit {width} bytes")
                data = ids.astype(kind).tobytes()
                ends = np.concatenate([[0], np.cumsum(sizes)]) * width
                yield pa.RecordBatch.from_arrays(
                    [names.slice(a, b - a), pa.array(sizes),
                     pa.array([data[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())],
                    ["doc_id", "n", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        W.lean(run, keeps="tokens"), "doc_id long, n long, ids binary")


def id_counts(encoded: DataFrame, vocabulary: int, width: int = 2) -> np.ndarray:
    """How often each id occurs. A task sends one row per id it has seen."""
    kind = f"<u{width}"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in rows:
            ids = batch.column(0).cast(pa.large_binary())
            ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset:ids.offset + len(ids) + 1]
            for a, b in W.slices(ends - ends[0]):
                own = np.frombuffer(ids.buffers()[2], np.uint8)[ends[a]:ends[b]]
                total += np.bincount(own.view(kind) if own.ctypes.data % width == 0 else own.copy().view(kind), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(W.lean(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for r in rows.collect():  # at most one row per id of the vocabulary
        counts[r["id"]] = r["n"]
    return counts


def write(encoded: DataFrame, path: str, *, vocabulary: int, width: int = 2,
          block_ids: int = BLOCK_IDS, part_ids: int = PART_IDS, limit: int = 16) -> None:
    """Write encoded rows (``doc_id, n, ids``; on storage, as they are read twice) as a token file set.

    Documents are in ascending order of ``doc_id`` (null first), rows that
    repeat an id in order of their ids. No rows give a set without blocks.
    """
    spark = encoded.sparkSession
    counts = id_counts(encoded, vocabulary, width)
    lengths = huffman.code_lengths(counts, limit)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(
        f"{path}/codebook")
    kind = f"<u{width}"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = huffman.Code(lengths)
        part = TaskContext.get().partitionId()
        block, at = 0, 0
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal block, at, names, held, size
            ids = np.frombuffer(b"".join(held), kind)
            payload, checkpoints, bits = code.pack(ids.astype(np.int64))
            row = {"part": part, "block": block, "at": at, "n": len(ids), "bits": bits,
                   "doc_ids": names, "sizes": [len(x) // width for x in held], "checkpoints": checkpoints, "payload": payload}
            block, at, names, held, size = block + 1, at + len(ids), [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        for batch in rows:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if names and size + len(ids) // width > block_ids:
                    yield close()
                names.append(name)
                held.append(ids)
                size += len(ids) // width
        if names:
            yield close()

    parts = max(1, -(-int(counts.sum()) // part_ids))
    (encoded.select("doc_id", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
     .mapInArrow(W.lean(run), _BLOCK_DDL).write.option("compression", "none").parquet(f"{path}/blocks"))


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("bits", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                    ("checkpoints", pa.binary()), ("payload", pa.binary())])
_BLOCK_DDL = ("part int, block int, at long, n long, bits long, doc_ids array<long>, sizes array<long>, "
              "checkpoints binary, payload binary")


def read(spark: SparkSession, path: str, *, ids: bool = False) -> DataFrame:
    """Decode a token file set: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` (uint32, little-endian)."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # at most one row per id of the vocabulary
    lengths = np.zeros(1 + max((r["id"] for r in book), default=0), np.uint8)
    for r in book:
        lengths[r["id"]] = r["length"]
    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = huffman.Code(lengths)
        for batch in rows:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("part", "at", "n", "doc_ids", "sizes", "checkpoints", "payload")}
                data = code.unpack(row["payload"], row["checkpoints"], row["n"]).astype("<u4").tobytes()
                ends = np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64))])
                own = [data[4 * a:4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                columns = [pa.array([row["part"]] * len(own), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                           pa.array(ends[:-1] + row["at"]), pa.array(np.diff(ends)), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    columns + ([pa.array(own, pa.binary())] if ids else []),
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32"] + (["ids"] if ids else []))

    blocks = spark.read.parquet(f"{path}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("part").agg(F.sum("n").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # one row per part
    rows = blocks.select("part", "at", "n", "doc_ids", "sizes", "checkpoints", "payload").mapInArrow(W.lean(run), schema)
    return rows.join(offsets, "part").withColumn("start", F.col("start") + F.col("_before")).drop("part", "_before")


def tokenize(docs: DataFrame, path: str, *, end_id: int, vocabulary: int, doc_id: str = "doc_id", text: str = "text",
             out: str | None = None) -> str:
    """Encode ``docs`` and write a token file set; returns its folder.

    Every row gives one document; a null or empty text is the end id alone.
    Other columns are not looked at.
    """
    width = 2 if vocabulary <= 1 << 16 else 4
    encoded = materialize(encode(docs, path, end_id=end_id, doc_id=doc_id, text=text, width=width), "ids")
    out = out or new_path(docs.sparkSession, "tokens")
    write(encoded, out, vocabulary=vocabulary, width=width)
    return out
