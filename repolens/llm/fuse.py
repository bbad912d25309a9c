"""Static binary fuse filters (3-wise, 8-bit fingerprints) over 64-bit keys, built and probed with NumPy.

A filter takes about 9 bits a key, never misses a key it was built from, and passes about 1 in 256 others.
"""

from __future__ import annotations

import struct

import numpy as np

_HEADER = struct.Struct("<QIII")


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A finalising mixer over 64 bits (the constants are fixed values of the public MurmurHash3 mixer)."""
    x = keys.astype(np.uint64) + np.uint64(seed)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _places(h: np.ndarray, segment: int, count: int) -> np.ndarray:
    """Three slots a key, in three consecutive segments; shape (3, n)."""
    first = ((h >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = first + np.uint64(segment)
    third = first + np.uint64(2 * segment)
    second ^= (h >> np.uint64(18)) & mask
    third ^= h & mask
    return np.stack([first, second, third]).astype(np.int64)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """Serialised filter of the distinct ``keys``."""
    keys = np.unique(np.asarray(keys).astype(np.uint64))
    n = len(keys)
    if n == 0:
        return _HEADER.pack(0, 4, 0, 0)
    segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    room = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
    count = max(1, int(np.ceil(n * room / segment)) - 2)
    for seed in range(1, 200):
        h = _mixed(keys, seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
        places = _places(h, segment, count)
        size = (count + 2) * segment
        order = _peeled(places, size)
        if order is None:
            count += max(1, count // 16) if seed % 4 == 0 else 0
            continue
        slots = np.zeros(size, np.uint8)
        marks = _fingerprint(h)
        for who, slot in reversed(order):
            three = slots[places[:, who]]
            slots[slot] = marks[who] ^ three[0] ^ three[1] ^ three[2]  # its own slot is still 0
        return _HEADER.pack(seed * 0x9E3779B97F4A7C15 & (2**64 - 1), segment, count, n) + slots.tobytes()
    raise ValueError("no binary fuse filter found for these keys")


def _peeled(places: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot that only they use), or None if some keys never come free."""
    n = places.shape[1]
    degree = np.bincount(places.ravel(), minlength=size)
    total = np.bincount(places.ravel(), weights=np.tile(np.arange(n, dtype=np.float64), 3), minlength=size)
    order, done = [], 0
    candidates = np.flatnonzero(degree == 1)
    while len(candidates):
        who, first = np.unique(total[candidates].astype(np.int64), return_index=True)
        order.append((who, candidates[first]))
        done += len(who)
        touched = places[:, who].ravel()
        np.subtract.at(degree, touched, 1)
        np.subtract.at(total, touched, np.tile(who.astype(np.float64), 3))
        touched = np.unique(touched)
        candidates = touched[degree[touched] == 1]
    return order if done == n else None


def contains(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    seed, segment, count, n = _HEADER.unpack_from(filter_bytes)
    if n == 0:
        return np.zeros(len(keys), bool)
    slots = np.frombuffer(filter_bytes, np.uint8, offset=_HEADER.size)
    h = _mixed(np.asarray(keys), seed)
    three = slots[_places(h, segment, count)]
    return _fingerprint(h) == three[0] ^ three[1] ^ three[2]
