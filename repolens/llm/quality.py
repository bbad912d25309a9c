"""Quality classification by a generalised additive model with pairwise interactions.

Features describe the whole text: lengths, shares of character classes, repetition of words and shingles.  Each feature
has a lookup table over quantile bins, learnt by cyclic boosting: in turn each feature gets a tree of at most three leaves
fitted to the current gradient.  Then the pairs of features that explain most of what is left get 8 x 8 tables by shallow
trees with one cut a side.  A score is a sum of table entries, gathered for whole batches at once.

Learning uses a bounded sample of labelled rows (``MAX_TRAIN``, by smallest hash of doc_id); the model is a few kilobytes
and travels with the scoring function.

Defined results: a null text is scored like an empty one; a label that is null, or a doc_id with none, teaches nothing;
repeated labels of a doc_id count as their majority (a tie is 1); without two classes to learn from every score is the
share of label 1 (0.5 without labels); an empty table gives no rows.  Extra columns are ignored (or kept, when filtering).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from repolens.llm.textbytes import buffers, mixed, pieces, word_hashes

#: Most labelled rows that a model is learnt from.
MAX_TRAIN = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, SMOOTH = 60, 30, 0.15, 5.0

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "newline", "punctuation", "symbol", "exclaim",
    "non_ascii", "unique_words", "top_word", "unique_shingles", "symbols_a_word", "capitals_a_word",
)

_KIND = np.zeros(256, np.int64)  # 0: other
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\x0b\x0c\r", "\n", ".,;:'\"?-()", "#$%&*@^~|<>=+_/\\{}[]`", "!"), 1):
    for _c in _chars:
        _KIND[ord(_c)] = _k
_KIND[128:192] = 9  # bytes after the first of a character
_KIND[192:] = 10
_KINDS = 11


def features(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row of ``FEATURES`` for each text of a string column; null is empty."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    kinds = np.zeros((n, _KINDS))
    for i, j, low, high, _ in pieces(data, offsets):
        ends = np.clip(offsets[i : j + 1], low, high)
        row = np.repeat(np.arange(j - i), np.diff(ends))
        kinds[i:j] += np.bincount(row * _KINDS + _KIND[data[low:high]], minlength=(j - i) * _KINDS).reshape(-1, _KINDS)
    words, unique, top, shingles = np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n)
    for i, h, counts in word_hashes(column):
        at = 0
        for k, c in enumerate(counts, i):
            own, times = np.unique(h[at : at + c], return_counts=True)
            words[k], unique[k], top[k] = c, len(own), times.max() if c else 0
            if c > 2:
                run = mixed(h[at : at + c - 2] * np.uint64(3) + mixed(h[at + 1 : at + c - 1] * np.uint64(5) + mixed(h[at + 2 : at + c])))
                shingles[k] = len(np.unique(run)) / len(run)
            at += c
    size = np.maximum(kinds.sum(axis=1), 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 10], 1)
    some = np.maximum(words, 1)
    return np.column_stack([
        np.log1p(kinds.sum(axis=1)), np.log1p(words), (size - kinds[:, 4] - kinds[:, 5]) / some, kinds[:, 1] / letters, kinds[:, 3] / size,
        kinds[:, 4] / size, kinds[:, 5] / size, kinds[:, 6] / size, kinds[:, 7] / size, kinds[:, 8] / size,
        (kinds[:, 9] + kinds[:, 10]) / size, unique / some, top / some, shingles, kinds[:, 7] / some, kinds[:, 1] / some,
    ])


@dataclass
class AdditiveModel:
    """Lookup tables over binned features and feature pairs."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, k], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + SMOOTH)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTH)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf value for each bin of a tree over ordered bins, cut greedily where the gain is largest."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        best = (1e-9, 0, 0)
        for s, (a, b) in enumerate(spans):
            if b - a > 1:
                left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                total_g, total_h = g[a:b].sum(), h[a:b].sum()
                gain = _gain(left_g, left_h) + _gain(total_g - left_g, total_h - left_h) - _gain(total_g, total_h)
                at = int(np.argmax(gain))
                best = max(best, (float(gain[at]), s, a + at + 1))
        if not best[2]:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best quadrant tree (one cut a side) over a grid: its gain and its table."""
    cum = lambda m: np.pad(m, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    cg, ch = cum(g), cum(h)
    best = (0.0, np.zeros_like(g))
    base = _gain(cg[-1, -1], ch[-1, -1])
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [(c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j]) for c in (cg, ch)]
            gain = sum(_gain(a, b) for a, b in zip(*parts, strict=True)) - base
            if gain > best[0]:
                leaf = [_leaf(a, b) for a, b in zip(*parts, strict=True)]
                table = np.empty_like(g)
                table[:i, :j], table[:i, j:], table[i:, :j], table[i:, j:] = leaf
                best = (float(gain), table)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Learn a model; ``y`` is 0 or 1."""
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    model = AdditiveModel(bias=float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    n, width = x.shape
    model.edges = [_cuts(x[:, k], BINS) for k in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    margin = np.full(n, model.bias)
    for _ in range(ROUNDS):
        for k in range(width):
            p = 1 / (1 + np.exp(-margin))
            size = len(model.tables[k])
            step = RATE * _tree(np.bincount(bins[k], y - p, size), np.bincount(bins[k], p * (1 - p), size))
            model.tables[k] += step
            margin += step[bins[k]]

    model.pair_edges = [_cuts(x[:, k], PAIR_BINS) for k in range(width)]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.pair_edges)]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], values, shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-margin))
    gains = [(_pair_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)))[0], a, b) for a in range(width) for b in range(a + 1, width)]
    model.pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-margin))
            step = RATE * _pair_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)))[1]
            model.pair_tables[k] += step
            margin += step[coarse[a], coarse[b]]
    return model


def remainder(modulus: int):  # noqa: ANN201
    """crc32 of doc_id as text, mod ``modulus``; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> AdditiveModel:
    """Fit the model to at most ``max_train`` rows of ``labels`` (doc_id, quality) and their texts."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("mean"))
    known = known.select("doc_id", (F.col("mean") >= 0.5).cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
    sample = known.orderBy("h", "doc_id").limit(max_train)
    # at most max_train rows of two numbers: small enough to broadcast whatever the tables' size
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("h", "y", "text")
    names = [f"f{k}" for k in range(len(FEATURES))]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["h"], batch["y"], *[pa.array(x[:, k]) for k in range(x.shape[1])]], names=["h", "y", *names])

    rows = texts.mapInArrow(measured, "h long, y int, " + ", ".join(f"{k} double" for k in names)).orderBy("h").limit(2 * max_train).toPandas()
    return fit(rows[names].to_numpy(), rows["y"].to_numpy().astype(float))


def scorer(model: AdditiveModel):  # noqa: ANN201
    """Column function: text to score."""

    @F.arrow_udf(DoubleType())
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(features(text)))

    return score


def _training(labels: DataFrame) -> DataFrame:
    return labels.where(remainder(3) != 1)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns."""
    score = scorer(learn(docs, _training(labels)))
    return docs.where(score(F.col("text")) >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learnt without the rows of remainder 1, scored on every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    score = scorer(learn(docs, _training(spark.read.parquet(f"{sf_dir}/labels.parquet"))))
    scored = docs.select("doc_id", (remainder(3) == 1).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
