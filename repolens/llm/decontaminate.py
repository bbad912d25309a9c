"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised (lower case, runs of white space and ASCII punctuation as one blank) and compared as UTF-8 bytes.  The windows of
a benchmark item are all its stretches of ``WINDOW`` bytes, one from each byte on (a shorter item is one window).  A window
of w bytes occurs in a document if some stretch of it is within e = w // 20 edits.

Filter: an occurrence with at most e edits shares at least w - q + 1 - e q q-grams with the window, on diagonals that
differ by at most e.  Shared q-grams are laid per item in bands of diagonals that overlap by half, so every such stretch
lies within one band; in the order of their places, wherever as many as the bound lie within a window, the windows around
them are verified, all at once, by banded alignment.  The filter loses nothing, and windows are never listed before it.

Repetitive texts cost no more than others.  Of the windows of an item that are equal only the first is looked for, with the
q-grams in it, and stands for all; a window that a text is known to hold unchanged is not aligned there again; and a stretch of a
text with very many shared q-grams is halved until they are few enough to sort.

An item of fewer than ``MIN_ITEM`` normalised bytes has too few q-grams for that and none to spare for edits: it is looked
for as it stands, from the start of a word to the end of one, whatever its length.

The benchmark's q-grams go to the tasks in blocks of items of about ``BLOCK_BYTES``.  A larger benchmark takes a pass over
the documents for each block, whose findings are written before the next one is made, so neither a task, the driver nor a
plan ever holds more than one block.

Defined results: null and empty texts match nothing, and items without any letter or digit are found nowhere; repeated rows
are each reported; items with equal text are each reported; a null
doc_id is reported as null; empty tables give no rows.  Extra columns are ignored (or kept, when filtering).  Long texts are
read in overlapping stretches.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from repolens.llm.common import materialise, scratch_path, whole_row
from repolens.llm.textbytes import IS_SPACE, buffers, mixed

Q = 12
WINDOW, STRIDE = 64, 1
EDIT_SHARE = 20
#: Shorter items are matched whole.
MIN_ITEM = 24
BLOCK_BYTES = 4 << 20
STRETCH = 1 << 19
#: Windows aligned at once; more edits than any budget.
ALIGNED, NEVER = 1 << 13, 256
#: Shared q-grams that are sorted at once.
MOST_HITS = 1 << 20
_BITS = 22
_WHOLE = np.random.default_rng(9).integers(0, 2**64, MIN_ITEM, dtype=np.uint64) | np.uint64(1)
_BLANK = IS_SPACE.copy()
_BLANK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the normalised texts, each ended by a byte 0 that nothing matches."""
    data, offsets = buffers(pc.utf8_lower(pc.fill_null(column, "")))
    space = _BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[: len(data)]
    again = space & np.concatenate([[False], space[:-1]]) & ~first
    keep = ~again
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    n = len(offsets) - 1
    out = np.zeros(kept[-1] + n, np.uint8)
    where = np.arange(kept[-1]) + np.repeat(np.arange(n), np.diff(kept))
    out[where] = np.where(space, 32, data)[keep]
    return out, kept + np.arange(n + 1)


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``Q`` bytes from each place on."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    head = np.ndarray((n,), "<u8", data, 0, (1,))
    tail = np.ndarray((n,), "<u4", data, 8, (1,)).astype(np.uint64)
    return (head * np.uint64(0x9E3779B97F4A7C15)) ^ (tail * np.uint64(0xD6E8FEB86659FD93)) ^ (head >> np.uint64(29))


def _whole(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` bytes from each place on, for ``n`` under ``MIN_ITEM``."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out += (data[at + k].astype(np.uint64) + np.uint64(1)) * _WHOLE[k]
    return out


def _places(text: np.ndarray, codes: np.ndarray, weight: np.ndarray, low: int, n: int, w: int) -> np.ndarray:
    """The places of the q-grams of an item of ``n`` bytes from ``low`` on that lie in the first of some equal windows of ``w`` bytes;
    notes in ``weight`` how many each stands for."""
    starts = np.arange(low, low + n - w + 1)
    # equal windows have equal hashes, of the q-grams that cover them; whether the bytes are equal is looked up after
    h = np.zeros(len(starts), np.uint64)
    for k in [*range(0, w - Q, Q), w - Q]:
        h = mixed(h ^ codes[starts + k])
    _, first, which, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    if len(first) < len(starts):
        again = np.flatnonzero(first[which] != np.arange(len(starts)))
        same = np.ones(len(again), bool)
        for k in range(w):
            same &= text[starts[again] + k] == text[starts[first[which[again]]] + k]
        if not same.all():  # two windows of one hash: each stands for itself
            first, times = np.arange(len(starts)), np.ones(len(starts), np.int64)
    weight[starts[first]] = times
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, first, 1)
    np.add.at(covered, first + (w - Q + 1), -1)
    return low + np.flatnonzero(np.cumsum(covered)[: n - Q + 1] > 0)


@dataclass
class Index:
    """The items of a block, each with the width of its windows, and the places of their q-grams."""

    items: list
    text: np.ndarray
    low: np.ndarray
    last: np.ndarray
    width: np.ndarray
    budget: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    places: np.ndarray
    maybe: np.ndarray
    #: by place: how many windows of the item are equal to the one from there on, 0 for all but the first of them
    weight: np.ndarray
    #: short items by length: their sorted hashes, with the place and the number of each
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[tuple[object, str]]) -> Index:
        text, offsets = normalised(pa.array([x[1] or "" for x in items], pa.string()))
        low, length = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64) - 1
        width = np.minimum(length, WINDOW)
        budget = np.maximum(np.minimum(width // EDIT_SHARE, (width - Q) // Q), 0)
        weight = np.zeros(len(text) + 1, np.int64)
        all_grams = grams(text)
        own = [_places(text, all_grams, weight, int(a), int(n), int(w)) for a, n, w in zip(low, length, width, strict=True) if n >= MIN_ITEM]
        places = np.concatenate([np.zeros(0, np.int64), *own])
        code = all_grams[places] if len(places) else np.zeros(0, np.uint64)
        by = np.argsort(code, kind="stable")
        keys, first = np.unique(code[by], return_index=True)
        maybe = np.zeros(1 << _BITS, bool)
        maybe[mixed(keys) >> np.uint64(64 - _BITS)] = True
        by_length: dict[int, list[tuple[int, int]]] = {}
        for k, (a, n) in enumerate(zip(low, length, strict=True)):
            # a blank at either end stands for punctuation
            a, n = (a + 1, n - 1) if n and text[a] == 32 else (a, n)
            n -= int(n > 0 and text[a + n - 1] == 32)
            if 0 < n and length[k] < MIN_ITEM:
                by_length.setdefault(int(n), []).append((int(a), k))
        short = {}
        for n, found in by_length.items():
            place, number = np.array(found).T
            code = _whole(text, place, n)
            order = np.argsort(code, kind="stable")
            short[n] = code[order], place[order], number[order]
        return cls(
            [x[0] for x in items], text, low, low + length - width, width, budget, width - Q + 1 - budget * Q,
            keys, np.append(first, len(by)), places[by], maybe, weight, short,
        )

    def item_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, place, side="right") - 1

    def windows(self, item: int) -> int:
        """How many windows an item has."""
        return int(self.last[item] - self.low[item]) // STRIDE + 1

    def hits(self, data: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(place in the data, place in the items) of every shared q-gram; None if there are more than ``most``."""
        code = grams(data)
        at = np.flatnonzero(self.maybe[mixed(code) >> np.uint64(64 - _BITS)])
        if not len(self.keys):
            return at[:0], at[:0]
        k = np.searchsorted(self.keys, code[at])
        k[k == len(self.keys)] = 0
        real = self.keys[k] == code[at]
        at, k = at[real], k[real]
        times = self.first[k + 1] - self.first[k]
        if times.sum() > most:
            return None
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(at, times), self.places[np.repeat(self.first[k], times) + step]

    def whole(self, data: np.ndarray, bound: bool) -> Iterator[tuple[int, int]]:
        """(item, end in the data) of every short item that stands in the data between blanks or the ends of a text;
        ``bound`` says whether a word can begin at the first byte."""
        if not self.short:
            return
        gap = np.concatenate([[bound], data <= 32, [True]])
        starts = np.flatnonzero(gap[:-2] & ~gap[1:-1])
        for n, (codes, places, numbers) in self.short.items():
            at = starts[starts + n <= len(data)]
            at = at[gap[at + n + 1]]
            code = _whole(data, at, n)
            low, high = np.searchsorted(codes, code, "left"), np.searchsorted(codes, code, "right")
            for i in np.flatnonzero(high > low):
                for k in range(low[i], high[i]):
                    if np.array_equal(self.text[places[k] : places[k] + n], data[at[i] : at[i] + n]):
                        yield int(numbers[k]), int(at[i] + n)

    def search(self, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place of a window in the items, end of its best occurrence in the data, edits), the best for each separate
        occurrence that is found."""
        # halves overlap by more than any occurrence is long
        short = len(data) <= 16 * WINDOW
        found = self.hits(data, len(data) * len(self.places) if short else MOST_HITS)
        if found is None:
            half = len(data) // 2
            yield from self.search(data[: half + 2 * WINDOW])
            for window, end, edits in self.search(data[half - 2 * WINDOW :]):
                yield window, end + half - 2 * WINDOW, edits
            return
        at, place = found
        if not len(at):
            return
        item = self.item_of(place)
        # the diagonal as the place where the items' text would start, never negative
        shift = len(self.text) + WINDOW
        band = (at - place + shift) // (self.budget[item] + 1)
        # band b covers the diagonals of steps b and b + 1, so neighbours overlap by half
        key = (np.concatenate([item, item]) << 40) | np.concatenate([band, band - 1])
        place = np.concatenate([place, place])
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        i = np.arange(len(key))
        ahead = i + self.bound[key >> 40] - 1
        i = i[ahead < len(key)]
        ahead = ahead[i]
        reach = self.width[key[i] >> 40] - Q
        enough = (key[ahead] == key[i]) & (place[ahead] - place[i] <= reach)
        i, ahead, reach = i[enough], ahead[enough], reach[enough]
        key, item = key[i], key[i] >> 40
        # the windows that hold these q-grams; within a band both ends grow, so what is new is a range
        low, high = np.maximum(place[ahead] - reach, self.low[item]), np.minimum(place[i], self.last[item])
        low[1:] = np.where(key[1:] == key[:-1], np.maximum(low[1:], high[:-1] + 1), low[1:])
        times = np.maximum(high - low + 1, 0)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        key, window = np.repeat(key, times), np.repeat(low, times) + step
        some = self.weight[window] > 0
        key, window = key[some], window[some]
        item = key >> 40
        width = self.budget[item] + 1
        start = (key & ((1 << 40) - 1)) * width - shift + window
        ends = np.flatnonzero(data == 0)
        for w in np.unique(self.width[item]):
            own = np.flatnonzero(self.width[item] == w)
            # a window and the text (they end with a byte 0) it is looked for in: the first place of each comes first
            sought = np.searchsorted(ends, np.clip(start[own], 0, len(data))) * len(self.weight) + window[own]
            by = np.argsort(sought, kind="stable")
            fresh = np.concatenate([[True], sought[by][1:] != sought[by][:-1]])[: len(by)]
            nth = np.arange(len(by)) - np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))
            by = by[np.argsort(nth, kind="stable")]
            own, sought = own[by], sought[by]
            done = np.zeros(0, np.int64)
            for k in range(0, len(own), ALIGNED):
                left = ~np.isin(sought[k : k + ALIGNED], done)
                some, of = own[k : k + ALIGNED][left], sought[k : k + ALIGNED][left]
                if not len(some):
                    continue
                budget = int(self.budget[item[some[0]]])
                patterns = self.text[window[some][:, None] + np.arange(w)]
                edits, end = aligned(patterns, data, start[some] - budget - 1, 4 * budget + 5, budget)
                done = np.union1d(done, of[edits == 0])
                for x in np.flatnonzero(edits <= budget):
                    yield int(window[some[x]]), int(end[x]), int(edits[x])


def aligned(patterns: np.ndarray, data: np.ndarray, low: np.ndarray, n: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(fewest edits, end) of each pattern, one a row, against a stretch of ``data`` that starts at one of the ``n`` places
    from its ``low`` on: only the cells on those diagonals are filled, and no stretch goes over a byte 0.  A pattern with all
    cells over ``budget`` is dropped on the way and gets ``NEVER``."""
    count, w = patterns.shape
    padded = np.concatenate([np.zeros(1, np.uint8), data, np.zeros(1, np.uint8)])
    near = padded[np.clip(low[:, None] + np.arange(1, w + n + 1), 0, len(data) + 1)]
    wall = (near == 0).astype(np.int16) * NEVER
    diagonals = low[:, None] + np.arange(n)
    row = np.where((diagonals >= 0) & (diagonals <= len(data)), 0, NEVER).astype(np.int16)
    alive = np.arange(count)
    for i in range(w):
        # diagonal d has its cell of row i + 1 after data[d + i]
        closed = wall[:, i : i + n]
        cell = row + (near[:, i : i + n] != patterns[:, i, None]) + closed
        np.minimum(cell[:, :-1], row[:, 1:] + 1, out=cell[:, :-1])
        for _ in range(budget):
            np.minimum(cell[:, 1:], cell[:, :-1] + closed[:, 1:] + 1, out=cell[:, 1:])
        row = np.minimum(cell, NEVER)
        if i % 16 == 15:
            some = row.min(axis=1) <= budget
            if not some.all():
                alive, row, near, wall, patterns = alive[some], row[some], near[some], wall[some], patterns[some]
    edits, end = np.full(count, NEVER, np.int64), np.full(count, -1, np.int64)
    if len(alive):
        best = row.argmin(axis=1)
        edits[alive] = row[np.arange(len(row)), best]
        end[alive] = low[alive] + best + w
    return edits, end


def matches(index: Index, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, windows found, windows of the item, fewest edits) for the texts of a column."""
    for at in range(0, len(column), 128):
        data, offsets = normalised(column.slice(at, 128))
        best: dict[tuple[int, int], int] = {}
        short: set[tuple[int, int]] = set()
        for start in range(0, len(data), STRETCH):
            # stretches overlap by more than any occurrence is long
            part = data[start : start + STRETCH + 4 * WINDOW]
            for window, end, edits in index.search(part):
                text = int(np.searchsorted(offsets, start + end - 1, side="right")) - 1
                best[text, window] = min(edits, best.get((text, window), edits))
            for item, end in index.whole(part, start == 0 or data[start - 1] <= 32):
                short.add((int(np.searchsorted(offsets, start + end - 1, side="right")) - 1, item))
        found: dict[tuple[int, int], list[int]] = {}
        for (text, window), edits in best.items():
            found.setdefault((text, int(index.item_of(window))), []).append((int(index.weight[window]), edits))
        found |= {key: [(1, 0)] for key in short}
        for (text, item), each in sorted(found.items()):
            yield at + text, item, sum(n for n, _ in each), index.windows(item), min(edits for _, edits in each)


def indexes(benchmark: DataFrame, block_bytes: int | None = None) -> Iterator[Index]:
    """The benchmark in blocks of about ``block_bytes`` (``BLOCK_BYTES``), one index at a time."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + size // (block_bytes or BLOCK_BYTES)
    for b in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        items = [(x["item_id"], x["text"]) for x in own.select("item_id", "text").orderBy("item_id", "text").collect()]
        if items:
            yield Index.of(items)


FOUND = "doc_id long, item_id long, windows_found int, windows int, edits int"


def _passes(benchmark: DataFrame, found_in: Callable[[Index], DataFrame], schema: str) -> DataFrame:
    """What ``found_in`` finds with each block's index: as it is if there is one block, else written block by block."""
    spark = benchmark.sparkSession
    blocks = indexes(benchmark)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return spark.createDataFrame([], schema)
    if second is None:
        return found_in(first)
    path = scratch_path(spark, "contaminated")
    for index in itertools.chain((first, second), blocks):
        found_in(index).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, windows_found, windows, edits: the items that occur in each document, in whole or in part."""

    def found_in(index: Index) -> DataFrame:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch["doc_id"]
                rows = [(ids[t].as_py(), index.items[k], a, b, e) for t, k, a, b, e in matches(index, batch["text"])]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "windows_found", "windows", "edits"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, FOUND)

    return _passes(benchmark, found_in, FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns."""
    blocks = indexes(benchmark)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return docs if first is None else docs.where(_clean(first)(F.col("text")))
    # several passes: rows get numbers, and each pass writes those of the rows that go
    rows = materialise(docs.select(whole_row(docs).alias("doc"), F.monotonically_increasing_id().alias("row")), "decontaminate-rows")
    path = scratch_path(docs.sparkSession, "dirty")
    for index in itertools.chain((first, second), blocks):
        rows.where(~_clean(index)(F.col("doc.text"))).select("row").write.mode("append").parquet(path)
    dirty = docs.sparkSession.read.parquet(path).distinct()
    return rows.join(dirty, "row", "left_anti").select("doc.*")


def _clean(index: Index):  # noqa: ANN202
    @F.arrow_udf(BooleanType())
    def clean(text: pa.Array) -> pa.Array:
        keep = np.ones(len(text), bool)
        for t, *_ in matches(index, text):
            keep[t] = False
        return pa.array(keep)

    return clean


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``: one row per document and item found in it."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
