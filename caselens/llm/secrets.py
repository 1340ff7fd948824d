"""Secrets in texts: known forms, and strings that look drawn at random.

Known forms (assignments, access keys, long hexadecimal runs) are patterns.
Every other long run of encoding characters goes through a battery of tests, and
so do its long pieces between + and /, between - and _, and between all four.
The alphabet is inferred from the characters; then

* chi-squared: do the characters agree with even draws from that alphabet?
* runs: do they cross the middle of the alphabet as often as even draws do?
* serial correlation: are neighbours unrelated?

A string that fails one of them is not random. For one that passes, the null
"ordinary text" says that its characters follow each other as they do in the
corpus (pairs of characters, counted over all texts, without case). Its p-value
is the likelihood under the null over that under even draws: a ratio of
likelihoods is under x with a chance of x at most. Discoveries are controlled
per alphabet and length band (Benjamini-Hochberg). Of discoveries that overlap,
the least ordinary one stays.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from caselens.llm import words as W
from caselens.runtime import materialize

#: Names of kinds, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")

#: Least length of what is assigned, of an access key and of a hexadecimal run.
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

_HEX = W.classes((0x30, 0x39), (0x61, 0x66))
_CODE = W.classes((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2F, 0x2F), (0x2D, 0x2D), (0x5F, 0x5F))

#: Pieces of a run between + and /, between - and _, and between all four.
_CUTS = tuple(re.compile(rb"[^" + cut + rb"]+") for cut in (rb"+/", rb"\-_", rb"+/\-_"))

_DIGITS, _UPPER, _LOWER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Alphabets from narrow to wide; a string has the first that holds all its characters.
ALPHABETS = (
    ("hex", _DIGITS + b"abcdef"), ("HEX", _DIGITS + b"ABCDEF"), ("base32", _UPPER + b"234567"), ("lower", _LOWER),
    ("lower36", _DIGITS + _LOWER), ("upper36", _DIGITS + _UPPER), ("base62", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + b"+/"), ("base64url", _UPPER + _LOWER + _DIGITS + b"-_"),
)
#: Characters without case, for the pairs of the corpus; all others have one code.
_PLAIN = _DIGITS + _LOWER + b"+/-_"
_OTHER = len(_PLAIN)
_FOLD = np.full(256, _OTHER, np.int64)
_FOLD[list(_PLAIN)] = np.arange(_OTHER)
_FOLD[list(_UPPER)] = _FOLD[list(_LOWER)]
_RANK = np.full((len(ALPHABETS), 256), -1, np.int64)
for _i, (_, _letters) in enumerate(ALPHABETS):
    _RANK[_i, list(_letters)] = np.arange(len(_letters))

#: Least length of a string that is tested, level of the three tests, share of false discoveries.
LEAST_RANDOM, LEVEL, FALSE_SHARE = 20, 0.001, 0.01
#: Weight of the single characters against the pairs that begin with a character.
_BACK_OFF = 10.0
_BINS = 400  # of -10 * log10(p)
_BLOCK = 1 << 16  # characters


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(value: bytes) -> tuple[int, int, bool] | None:
    """``(alphabet, coincidences, random)`` of a string: pairs of equal characters, and whether no test speaks against
    even draws. None if there is no alphabet for it or it is all digits."""
    raw = np.frombuffer(value, np.uint8)
    seen = np.bincount(raw, minlength=256)
    fitting = np.flatnonzero((_RANK[:, seen > 0] >= 0).all(axis=1))
    if not len(fitting) or not seen[0x3A:].any():
        return None
    kind = int(fitting[0])
    n, k = len(raw), len(ALPHABETS[kind][1])
    rank = _RANK[kind].astype(np.uint8)[raw]
    counts = seen[list(ALPHABETS[kind][1])]
    pairs = int((counts * (counts - 1)).sum())  # chi-squared is k / n * (pairs + n) - n
    z_chi = (pairs - n * (n - 1) / k) / math.sqrt(2 * n * (n - 1) * (1 / k - 1 / k**2))
    high = rank >= k / 2
    a = int(high.sum())
    b = n - a
    if a == 0 or b == 0:
        return kind, pairs, False
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 2 * a * b / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = (runs - mean) / math.sqrt(spread) if spread > 0 else 0.0
    # Whole sums, block by block: a long string costs a few bytes a character.
    places = np.arange(k)
    total, squares = int((counts * places).sum()), int((counts * places * places).sum())
    following = sum(int(rank[i:i + _BLOCK].astype(np.int64) @ rank[i + 1:i + 1 + _BLOCK].astype(np.int64)) if i + _BLOCK < n
                    else int(rank[i:n - 1].astype(np.int64) @ rank[i + 1:].astype(np.int64)) for i in range(0, n, _BLOCK))
    # Both sums of squares and products around the mean, times n.
    power = n * squares - total * total
    product = n * following - total * (2 * total - int(rank[0]) - int(rank[-1])) + total * total * (n - 1) / n
    serial = product / power if power else 1.0
    z_serial = (serial + 1 / n) * math.sqrt(n)
    return kind, pairs, all(2 * _tail(abs(z)) >= LEVEL for z in (z_chi, z_runs, z_serial))


def neighbours(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each character follows each other one within the texts, by codes without case."""
    codes = _FOLD[data]
    if len(codes) < 2:
        return np.zeros((_OTHER + 1, _OTHER + 1), np.int64)
    pairs = codes[:-1] * (_OTHER + 1) + codes[1:]
    cuts = offsets[1:-1]
    pairs[cuts[(cuts > 0) & (cuts < len(data))] - 1] = (_OTHER + 1) ** 2 - 1  # from text to text
    return np.bincount(pairs, minlength=(_OTHER + 1) ** 2).reshape(_OTHER + 1, -1)


class Ordinary:
    """The null of ordinary text against even draws, from the ``neighbours`` of all texts."""

    def __init__(self, pairs: np.ndarray):
        self.first, self.then = [], []
        for _, letters in ALPHABETS:
            even = np.bincount(_FOLD[list(letters)], minlength=_OTHER)[:_OTHER] / len(letters)
            held = even > 0
            single = np.where(held, pairs.sum(axis=0)[:_OTHER] + 1.0, 0.0)
            single /= single.sum()
            double = np.where(held, pairs[:_OTHER, :_OTHER], 0) + _BACK_OFF * single
            double /= double.sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.first.append(np.log10(single / even))
                self.then.append(np.log10(double / even))

    def log_p(self, kind: int, value: bytes) -> float:
        """Decimal logarithm of the p-value, 0 at most."""
        codes = _FOLD[np.frombuffer(value, np.uint8)]
        return min(0.0, float(self.first[kind][codes[0]] + self.then[kind][codes[:-1], codes[1:]].sum()))


def band(n: int) -> int:
    """Length band: three to a doubling."""
    return int(3 * math.log2(n))


def cutoffs(histogram: dict[tuple[int, int], np.ndarray], share: float) -> dict[tuple[int, int], int]:
    """Per group the lowest bin that is a discovery (Benjamini-Hochberg on bins of ``-10 log10 p``)."""
    out = {}
    for group, bins in histogram.items():
        over = np.cumsum(bins[::-1])[::-1]  # with p of at most 10 ** (-bin / 10)
        good = np.flatnonzero(bins.sum() * 10.0 ** (-np.arange(_BINS) / 10) <= share * over)
        out[group] = int(good[0]) if len(good) else _BINS
    return out


def bin_of(p: float) -> int:
    return bin_of_log(math.log10(max(p, 1e-300)))


def bin_of_log(log_p: float) -> int:
    return min(_BINS - 1, int(-10 * log_p))


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``(text, start, end)`` in bytes of ``data`` of all maximal runs of ``least`` member bytes or more."""
    found = W.words(data, offsets, member, lower=False)
    long = np.flatnonzero(found.ends - found.starts >= least)
    text = np.searchsorted(found.offsets, long, "right") - 1
    return list(zip(text.tolist(), found.starts[long].tolist(), found.ends[long].tolist(), strict=True))


def pieces(value: bytes) -> list[tuple[int, int]]:
    """Ranges of a run that are tested: the whole of it, and its long pieces between separators."""
    out = {(0, len(value))}
    for cut in _CUTS:
        out.update(m.span() for m in cut.finditer(value) if m.end() - m.start() >= LEAST_RANDOM)
    return sorted(out)


def apart(spans: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Of ``(log p, start, end)`` the ranges that are left when each one hides those of a higher p that overlap it."""
    kept: list[tuple[int, int]] = []
    for _, a, b in sorted(spans, key=lambda s: (s[0], s[1], -s[2])):
        at = bisect.bisect_left(kept, (a, b))
        if (at == len(kept) or b <= kept[at][0]) and (at == 0 or kept[at - 1][1] <= a):
            kept.insert(at, (a, b))
    return kept


def scan_text(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of assignments and access keys, in code points."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out


_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_TESTED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("alphabet", pa.int32()), ("value", pa.binary())]))
_FOUND_DDL = "array<struct<kind:int,start:int,end:int>>"
_TESTED_DDL = "array<struct<start:int,end:int,alphabet:int,value:binary>>"  # no value: not random


def _scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is found and tested in every row; a last row without either has the pairs of the task's texts."""
    pairs = np.zeros((_OTHER + 1, _OTHER + 1), np.int64)
    ids = None
    for batch in rows:
        ids = batch.column(0).type
        texts = batch.column(1)
        data, offsets = W.texts_buffer(texts)
        for a, b in W.slices(offsets):
            part = offsets[a:b + 1]
            raw, ends = data[part[0]:part[-1]], part - part[0]
            found = [scan_text(t) if t else [] for t in texts.slice(a, b - a).to_pylist()]
            tested: list[list[dict]] = [[] for _ in found]

            def points(i: int, start: int, end: int, raw=raw, ends=ends) -> tuple[int, int]:
                before = raw[ends[i]:start]
                at = int(np.count_nonzero((before & 0xC0) != 0x80))
                return at, at + end - start  # the runs are ASCII

            for i, start, end in runs(raw, ends, _HEX, LEAST_HEX):
                x, y = points(i, start, end)
                found[i].append((x, 2, y))
            for i, start, end in runs(raw, ends, _CODE, LEAST_RANDOM):
                run, first = raw[start:end].tobytes(), None
                for c, d in pieces(run):
                    value = run[c:d]
                    result = battery(value)
                    if result:
                        first = points(i, start, end)[0] if first is None else first
                        x, y = first + c, first + d
                        if not any(x < e and s < y for s, _, e in found[i]):
                            tested[i].append({"start": x, "end": y, "alphabet": result[0], "value": value if result[2] else None})
            pairs += neighbours(raw, ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a),
                 pa.array([[{"kind": k, "start": s, "end": e} for s, k, e in sorted(spans)] for spans in found], _FOUND),
                 pa.array(tested, _TESTED), pa.nulls(b - a, pa.list_(pa.int64()))],
                ["doc_id", "found", "tested", "neighbours"])
    if ids is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, ids), pa.nulls(1, _FOUND), pa.nulls(1, _TESTED), pa.array([pairs.ravel().tolist()], pa.list_(pa.int64()))],
            ["doc_id", "found", "tested", "neighbours"])


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """``doc_id`` and ``spans`` (``kind, start, end`` in code points, in order) of every row.

    The known forms are always kept. Strings that look random are added where
    they do not overlap a known form. A null or empty text has no spans; ids
    may be null or repeat.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = StructType([StructField("doc_id", rows.schema["doc_id"].dataType)])
    names = kind.simpleString()[len("struct<"):-1].replace("doc_id:", "doc_id ", 1)
    seen = materialize(rows.mapInArrow(W.lean(_scan), f"{names}, found {_FOUND_DDL}, tested {_TESTED_DDL}, neighbours array<long>"), "secrets")

    pairs = np.zeros((_OTHER + 1) ** 2, np.int64)
    for r in seen.where("neighbours is not null").select(F.posexplode("neighbours")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        pairs[r["pos"]] = r["n"]  # 1,681 rows
    ordinary = Ordinary(pairs.reshape(_OTHER + 1, -1))

    seen = seen.where("found is not null")
    tested = seen.where(F.size("tested") > 0)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for row in batch.column(0).to_pylist():
                for t in row:
                    at = bin_of_log(ordinary.log_p(t["alphabet"], t["value"])) if t["value"] else 0
                    out.append((t["alphabet"], band(t["end"] - t["start"]), at))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int32()) for i in range(3)], ["alphabet", "band", "bin"])

    # All tested strings count as hypotheses; at most alphabets x bands x bins rows come back.
    histogram: dict[tuple[int, int], np.ndarray] = {}
    for r in tested.select("tested").mapInArrow(bins, "alphabet int, band int, bin int").groupBy("alphabet", "band", "bin").count().collect():
        histogram.setdefault((r["alphabet"], r["band"]), np.zeros(_BINS, np.int64))[r["bin"]] = r["count"]
    limits = cutoffs(histogram, false_share)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found, strings in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                random = []
                for t in strings:
                    log_p = ordinary.log_p(t["alphabet"], t["value"]) if t["value"] else 0.0
                    if t["value"] and bin_of_log(log_p) >= limits.get((t["alphabet"], band(t["end"] - t["start"])), _BINS):
                        random.append((log_p, t["start"], t["end"]))
                found += [{"kind": 3, "start": a, "end": b} for a, b in apart(random)]
                out.append(sorted(found, key=lambda s: (s["start"], s["kind"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _FOUND)], ["doc_id", "spans"])

    return seen.select("doc_id", "found", "tested").mapInArrow(choose, f"{names}, spans {_FOUND_DDL}")


def report(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` of every row; spans as ``kind:start:end``."""
    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return find(docs, **how).select(
        "doc_id", *[count(k) for k in range(len(KINDS))],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
