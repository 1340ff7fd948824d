"""Canonical Huffman codes of limited length: building, packing, table-driven unpacking.

A packed block stands alone. ``STEP`` ids apart it holds the bit offset of a
checkpoint; unpacking follows all checkpoints at once, one id of each per
round, as array operations.
"""

from __future__ import annotations

import numpy as np

#: Ids between two checkpoints of a block.
STEP = 128


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Lengths (0: not coded) that are best under ``limit``, by package-merge.

    ``counts[i]`` is how often id ``i`` occurs. The limit is raised if there
    are more ids than it has codes for.
    """
    used = np.flatnonzero(counts > 0)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(n - 1).bit_length())
    if limit > 24:
        raise ValueError("more than 2**24 ids")
    order = np.argsort(counts[used], kind="stable")
    leaves = counts[used][order].astype(np.float64)
    merged, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(merged) // 2 * 2
        both = np.concatenate([leaves, merged[0:even:2] + merged[1:even:2]])
        by = np.argsort(both, kind="stable")
        merged = both[by]
        is_leaf.append(by < n)
    depth = np.zeros(n, np.uint8)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        leaf = int(flags[:take].sum())
        depth[:leaf] += 1
        take = 2 * (take - leaf)
    lengths[used[order]] = depth
    return lengths


class Code:
    """Canonical code given by its lengths: shorter codes first, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(self.lengths)
        used = used[np.lexsort((used, self.lengths[used]))]
        size = self.lengths[used]
        self.width = int(size.max()) if len(used) else 1
        # Codes of full width start where the codes before them end.
        room = np.left_shift(np.int64(1), self.width - size)
        first = np.cumsum(room) - room
        if len(used) and int(first[-1] + room[-1]) > 1 << self.width:
            raise ValueError("these lengths are no prefix code")
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[used] = first >> (self.width - size)
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.step = np.ones(1 << self.width, np.int64)
        filled = int(room.sum())
        self.symbol[:filled] = np.repeat(used, room)
        self.step[:filled] = np.repeat(size, room)

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes, int]:
        """``(payload, checkpoints as uint32, bits)`` of ``ids``."""
        size = self.lengths[ids]
        if len(ids) and size.min() == 0:
            raise ValueError("an id without a code")
        end = np.cumsum(size)
        at = end - size
        bits = int(end[-1]) if len(ids) else 0
        if bits >= 1 << 32:
            raise ValueError("block too large")
        value = self.codes[ids] << (64 - 8 - (at & 31) - size)  # 56 bits from the start of a 32-bit cell
        cell = at >> 5
        cells = (bits >> 5) + 2
        # Codes do not overlap, so sums are unions; every sum stays below 2**32 and is exact.
        packed = np.bincount(cell, weights=(value >> 24).astype(np.float64), minlength=cells)
        packed += np.bincount(cell + 1, weights=((value & 0xFFFFFF) << 8).astype(np.float64), minlength=cells)
        payload = packed.astype(np.uint64).astype(">u4").tobytes()[:(bits + 7) >> 3]
        return payload, at[::STEP].astype("<u4").tobytes(), bits

    def unpack(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The ``n`` ids of a block."""
        if n == 0:
            return np.zeros(0, np.uint32)
        raw = np.frombuffer(payload + bytes(8 + STEP * 4), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        out = np.empty((STEP, len(at)), np.uint32)
        last = len(window) - 1
        mask, shift = (1 << self.width) - 1, 32 - self.width
        for k in range(STEP):
            seen = window[np.minimum(at >> 3, last)].astype(np.int64)
            code = (seen >> (shift - (at & 7))) & mask
            out[k] = self.symbol[code]
            at = at + self.step[code]
        return out.T.ravel()[:n]  # only the last checkpoint runs past the end
