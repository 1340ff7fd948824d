"""Static binary-fuse filters over 64-bit keys (Graf and Lemire, 2022), in numpy.

A filter is one ``bytes`` value: a header and an array of 16-bit fingerprints,
about 18 bits a key and one false positive in 65,536. It has no false
negatives and cannot be changed once built.
"""

from __future__ import annotations

import struct

import numpy as np

_HEADER = struct.Struct("<QQQ")  # seed, segment length, segment count


def mix(keys: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    z = keys.astype(np.uint64, copy=True)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def _places(hashed: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three slots of every key: one in each of three neighbouring segments."""
    first = ((hashed >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    base = first.astype(np.int64) * length
    low = length - 1
    a = base + (hashed & np.uint64(low)).astype(np.int64)
    b = base + length + ((mix(hashed) >> np.uint64(7)) & np.uint64(low)).astype(np.int64)
    c = base + 2 * length + ((mix(hashed ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)) & np.uint64(low)).astype(np.int64)
    return np.stack([a, b, c])


def _prints(hashed: np.ndarray) -> np.ndarray:
    return (mix(hashed + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """Filter of distinct ``keys`` (uint64). Slots hit by one open key are peeled, a whole front at a time."""
    n = len(keys)
    length = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) if n > 1 else 4.0
    segments = max(1, int(np.ceil(n * factor / length)) - 2)
    for attempt in range(1, 200):
        seed = (0x9E3779B97F4A7C15 * attempt) & 0xFFFFFFFFFFFFFFFF
        hashed = mix(keys ^ np.uint64(seed))
        places = _places(hashed, length, segments)
        slots = (segments + 2) * length
        count = np.bincount(places.ravel(), minlength=slots)
        held = np.zeros(slots, np.int64)  # xor of the open keys of a slot
        index = np.arange(n, dtype=np.int64)
        for row in places:
            np.bitwise_xor.at(held, row, index)
        open_key = np.ones(n, bool)
        fronts: list[tuple[np.ndarray, np.ndarray]] = []
        front = np.flatnonzero(count == 1)
        while len(front):
            owners, at = np.unique(held[front], return_index=True)
            fresh = open_key[owners]
            owners, at = owners[fresh], front[at][fresh]
            if not len(owners):
                break
            fronts.append((owners, at))
            open_key[owners] = False
            touched = places[:, owners]
            np.subtract.at(count, touched.ravel(), 1)
            for row in touched:
                np.bitwise_xor.at(held, row, owners)
            near = np.unique(touched)
            front = near[count[near] == 1]
        if not open_key.any():
            break
        if attempt % 10 == 0:
            segments += max(1, segments // 10)
    else:
        raise RuntimeError("no filter found: the keys are not distinct")
    prints = np.zeros(slots, np.uint16)
    wanted = _prints(hashed)
    for owners, at in reversed(fronts):
        # The slots that one front fills belong to one of its keys each, so all are set at once.
        seen = prints[places[0, owners]] ^ prints[places[1, owners]] ^ prints[places[2, owners]] ^ prints[at]
        prints[at] = wanted[owners] ^ seen
    return _HEADER.pack(seed, length, segments) + prints.tobytes()


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """True where a key may be in the filter, False where it is certainly not."""
    seed, length, segments = _HEADER.unpack_from(blob)
    prints = np.frombuffer(blob, np.uint16, offset=_HEADER.size)
    hashed = mix(keys ^ np.uint64(seed))
    a, b, c = _places(hashed, length, segments)
    return (prints[a] ^ prints[b] ^ prints[c]) == _prints(hashed)
