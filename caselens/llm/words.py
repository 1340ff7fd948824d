"""Words of whole texts as arrays, without a Python loop over words.

Texts are handled in slices of a few MB, so memory is bounded by the slice (or
by the one text that is longer). A word is known by a 64-bit hash of its bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Words are hashed so many bytes at a time, or one longer word; numbers are mixed so many at a time.
BLOCK_BYTES, MIX_VALUES = 1 << 15, 1 << 14

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they can be divided by
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def classes(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the byte values in ``ranges`` (both ends included)."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: ``[^\x20\x09-\x0D]``
NOT_SPACE = ~classes((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z
ALNUM = ~classes((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def lower_case(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case. Sums over bytes, as a table would be looked up one byte after another."""
    return data | ((data - np.uint8(0x41) < 26).view(np.uint8) << np.uint8(5))


def _members(data: np.ndarray, member: np.ndarray) -> np.ndarray:
    if member is NOT_SPACE:
        return (data != 0x20) & (data - np.uint8(9) > 4)
    return member[data]


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place, as much at a time as stays in the processor's cache."""
    if z.ndim == 1 and len(z) > MIX_VALUES:
        for k in range(0, len(z), MIX_VALUES):
            mix(z[k:k + MIX_VALUES])
        return z
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse, modulo 2**64. Tables longer than a block are not kept."""
    if base in _POWERS and len(_POWERS[base][0]) >= n:
        return _POWERS[base]
    tables = []
    for b in (base, pow(base, -1, 1 << 64)):
        table = np.full(max(n, BLOCK_BYTES + 1), b, np.uint64)
        table[0] = 1
        tables.append(np.multiply.accumulate(table))
    if n <= BLOCK_BYTES + 1:
        _POWERS[base] = (tables[0], tables[1])
    return tables[0], tables[1]


@dataclass
class Words:
    """Words of consecutive texts. Word ``k`` of text ``i`` is ``offsets[i] + k``."""

    data: np.ndarray     # bytes of all texts, A-Z in lower case if asked for
    starts: np.ndarray   # byte range of each word in ``data``
    ends: np.ndarray
    offsets: np.ndarray  # words before each text, and the total

    def hashes(self, *, second: bool = False) -> np.ndarray:
        """One 64-bit hash per word, the same wherever the word stands; ``second`` is another one."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            low = int(self.starts[at])
            end = max(at + 1, int(np.searchsorted(self.ends, low + BLOCK_BYTES, "right")))
            data = self.data[low:int(self.ends[end - 1])]
            starts = self.starts[at:end] - low
            up, down = _powers(len(data) + 1, _BASES[second])
            terms = data.astype(np.uint64)
            terms += np.uint64(1)
            terms *= up[:len(terms)]
            total = np.zeros(len(terms) + 1, np.uint64)
            np.cumsum(terms, out=total[1:])
            part = total[self.ends[at:end] - low]
            part -= total[starts]
            part *= down[starts]
            out[at:end] = part
            at = end
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def word(self, k: int) -> str:
        return self.data[self.starts[k]:self.ends[k]].tobytes().decode("utf-8", "replace")


def texts_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string array; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``limit`` bytes each, or of one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end
        at = end


def smaller(rows: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches whose second column, texts, holds up to ``limit`` bytes (or one longer text)."""
    for batch in rows:
        _, offsets = texts_buffer(batch.column(1))
        for a, b in slices(offsets, limit):
            yield batch.slice(a, b - a)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = NOT_SPACE, *, lower: bool = True) -> Words:
    """Words (runs of member bytes) of the texts that ``offsets`` cut ``data`` into."""
    data = lower_case(data) if lower else data
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _members(data, member)
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    # A word that runs over the end of a text is cut there.
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    if len(cuts):
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def batches(texts: pa.Array, member: np.ndarray = NOT_SPACE, *, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """``(first, end, words)`` of slices of a string array."""
    data, offsets = texts_buffer(texts)
    for a, b in slices(offsets):
        part = offsets[a:b + 1]
        yield a, b, words(data[part[0]:part[-1]], part - part[0], member, lower=lower)


def windows(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every ``size`` consecutive word hashes (none if there are fewer)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for k in range(size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k:k + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def within(offsets: np.ndarray, size: int) -> np.ndarray:
    """Positions at which a window of ``size`` words stays in its text."""
    n = int(offsets[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for k in range(1, size):
        at = offsets[1:-1] - k
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def release() -> None:
    """Give freed memory back to the system: Python workers are kept, and what they hold is missed elsewhere."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


_KEPT: dict[str, Callable[[], None]] = {}


def keep(owner: str, drop: Callable[[], None]) -> None:
    """Tell that this worker keeps something for the next task of ``owner``, and how to drop it."""
    _KEPT[owner] = drop


def forget(besides: str | None = None) -> None:
    """Drop what earlier tasks of this worker kept, but for one owner's."""
    for owner in [o for o in _KEPT if o != besides]:
        _KEPT.pop(owner)()


def lean(run, *, keeps: str | None = None):
    """A function over the batches of a task that releases memory when it is done, and what other operators kept before."""
    @functools.wraps(run)
    def wrapped(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            yield from run(rows)
        finally:
            release()
    return wrapped


def lean_group(run):
    """A function over one group that releases memory when it is done."""
    @functools.wraps(run)
    def wrapped(group: pa.Table) -> pa.Table:
        forget()
        out = run(group)
        release()
        return out
    return wrapped


class Lookup:
    """Positions of 64-bit keys in a fixed array of distinct keys, for many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.bits = max(10, int(4 * len(keys)).bit_length())
        self.tables = []
        left = np.arange(len(keys))
        for turn in range(2):
            table = np.full(1 << self.bits, -1, np.int32)
            slot = self._slot(self.keys[left], turn)
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]
        order = np.argsort(self.keys[left])
        self.rest, self.rest_keys = left[order], self.keys[left][order]

    def _slot(self, keys: np.ndarray, turn: int) -> np.ndarray:
        return ((keys >> np.uint64(64 - self.bits)) if turn == 0 else (keys & np.uint64((1 << self.bits) - 1))).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is not in the array."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = self.tables[0][self._slot(keys, 0)].astype(np.int64)
        out[self.keys[out] != keys] = -1
        miss = np.flatnonzero(out < 0)
        second = self.tables[1][self._slot(keys[miss], 1)].astype(np.int64)
        second[self.keys[second] != keys[miss]] = -1
        out[miss] = second
        if len(self.rest):
            miss = miss[second < 0]
            at = np.minimum(np.searchsorted(self.rest_keys, keys[miss]), len(self.rest) - 1)
            hit = self.rest_keys[at] == keys[miss]
            out[miss[hit]] = self.rest[at[hit]]
        return out
