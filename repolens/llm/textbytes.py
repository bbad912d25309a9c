"""NumPy passes over the bytes of Arrow text columns: words, their hashes, and shingles.

Texts are read in place from the Arrow buffers and worked on in pieces of about ``PIECE`` bytes, so memory does not grow
with the batch or with a long text (a piece ends at white space).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_ROOT_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


class _Powers:
    """Powers of the hash base and of its inverse, grown to the longest piece seen."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, root in (("up", _ROOT), ("down", _ROOT_INVERSE)):
                steps = np.full(max(n, PIECE + 4096), root)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalising 64-bit mixer (the constants are fixed values of the public SplitMix64 generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    if places is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, int, int, bool]]:
    """(first text, last text + 1, low, high, ends): runs of whole texts of about ``limit`` bytes; a longer text comes alone,
    in parts that end at white space, and only its last part has ``ends``."""
    i, n = 0, len(offsets) - 1
    while i < n:
        low = offsets[i]
        if offsets[i + 1] - low > limit:
            high = offsets[i + 1]
            while high - low > limit:
                near = np.flatnonzero(IS_SPACE[data[low + limit // 2 : low + limit]])
                if len(near):
                    cut = low + limit // 2 + near[-1] + 1
                else:
                    after, step = low + limit, None
                    while step is None and after < high:
                        found = np.flatnonzero(IS_SPACE[data[after : min(high, after + limit)]])
                        step = after + found[0] + 1 if len(found) else None
                        after += limit
                    cut = high if step is None else step
                if cut >= high:
                    break
                yield i, i + 1, low, cut, False
                low = cut
            yield i, i + 1, low, high, True
            i += 1
        else:
            j = int(np.searchsorted(offsets, low + limit, side="right")) - 1
            j = max(i + 1, min(j, n))
            yield i, j, low, offsets[j], True
            i = j


def words_of(data: np.ndarray, starts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of the piece; a word never crosses one of the text ``starts``."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts[starts <= len(data)]] = True
    edge[0] = edge[-1] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    begin = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    up, down = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=sums[1:])
    value = (sums[end] - sums[begin]) * down[begin]
    return mixed(value + (end - begin).astype(np.uint64) * _ROOT), begin, end


def word_hashes(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, hashes of its words and those of the texts after it, word counts), text by text in runs."""
    data, offsets = buffers(column)
    held: list[np.ndarray] = []
    for i, j, low, high, ends in pieces(data, offsets):
        starts = offsets[i:j] - low
        h, begin, _ = words_of(data[low:high], starts[starts >= 0], lower)
        if not ends:
            held.append(h)
            continue
        if held:
            h = np.concatenate([*held, h])
            held = []
            yield i, h, np.array([len(h)])
            continue
        bounds = np.searchsorted(begin, np.concatenate([starts, [high - low]]))
        yield i, h, np.diff(bounds)


def shingle_sets(column: pa.Array | pa.ChunkedArray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles; with fewer words, of the whole sequence."""
    for _, h, counts in word_hashes(column):
        n = len(h)
        if n >= k:
            run = h[: n - k + 1] * _PLACE[0]
            for j in range(1, k):
                run += mixed(h[j : n - k + 1 + j]) * _PLACE[j]
            run = mixed(run)
        at = 0
        for c in counts:
            if c >= k:
                yield np.unique(run[at : at + c - k + 1])
            elif c:
                part = (mixed(h[at : at + c]) * _PLACE[32 : 32 + c]).sum(dtype=np.uint64) + np.uint64(c)
                yield mixed(np.array([part], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += c
