"""Vector functions: cosine similarity in the JVM and a deterministic embedder."""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 384


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null if either has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def cosine_score(a: Column, b: Column) -> Column:
    """(1 + cosine) / 2, from 0 to 1."""
    return (cosine(a, b) + 1) / 2


def mean_pooled(states: Column, mask: Column) -> Column:
    """The mean of the vectors that ``mask`` marks with 1, scaled to length 1; empty without any, or for a mean of length 0.

    ``states`` is an array of vectors of one length, one a token, ``mask`` an array of 0 and 1 of as many entries.
    """
    kept = F.transform(F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["s"])
    add = lambda a, b: F.when(F.size(a) == 0, F.transform(b, lambda x: x.cast("double"))).otherwise(F.zip_with(a, b, lambda x, y: x + y.cast("double")))
    total = F.aggregate(kept, F.array().cast("array<double>"), add)
    size = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(total, lambda x: x / size)).otherwise(F.array().cast("array<double>"))


class OnnxEmbedder:
    """A sentence model from files: token states of an ONNX model, mean-pooled over the tokens and scaled to length 1.

    Both files must be where the tasks run.  The model is loaded once a process, at the first text.  Needs the packages
    ``onnxruntime`` and ``tokenizers``.
    """

    def __init__(self, model: str, tokenizer: str, most_tokens: int = 256) -> None:
        self.model, self.tokenizer, self.most_tokens = model, tokenizer, most_tokens

    def __call__(self, text: str | None) -> list[float]:
        session, tokenizer = _loaded(self.model, self.tokenizer, self.most_tokens)
        made = tokenizer.encode(text or "")
        given = {"input_ids": made.ids, "attention_mask": made.attention_mask, "token_type_ids": made.type_ids}
        names = {x.name for x in session.get_inputs()}
        states = session.run(None, {k: np.array([v], np.int64) for k, v in given.items() if k in names})[0][0]
        return pooled(np.asarray(states), np.array(made.attention_mask))


def pooled(states: np.ndarray, mask: np.ndarray) -> list[float]:
    """As ``mean_pooled``, for one text's array of token states."""
    total = states[mask == 1].sum(axis=0, dtype=np.float64) if (mask == 1).any() else np.zeros(0)
    size = float(np.sqrt((total * total).sum()))
    return (total / size).tolist() if size else []


@functools.cache
def _loaded(model: str, tokenizer: str, most_tokens: int):  # noqa: ANN202
    import onnxruntime  # noqa: PLC0415
    from tokenizers import Tokenizer  # noqa: PLC0415

    made = Tokenizer.from_file(tokenizer)
    made.enable_truncation(most_tokens)
    return onnxruntime.InferenceSession(model), made


class HashingEmbedder:
    """Word and part-word features hashed into ``dimensions`` signed sums, scaled to length 1.

    A stand-in without a model: equal words give similar vectors, meaning plays no part.
    """

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions

    def __call__(self, text: str | None) -> list[float]:
        out = [0.0] * self.dimensions
        for word in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[^\W\d_]+", text or ""):
            word = word.lower()
            for feature, weight in ((word, 1.0), *((word[i : i + 3], 0.3) for i in range(len(word) - 2))):
                h = zlib.crc32(feature.encode())
                out[h % self.dimensions] += weight if h & (1 << 31) else -weight
        size = math.sqrt(sum(x * x for x in out))
        return [x / size for x in out] if size else []


def embedder_udf(embed: Callable[[str | None], list[float]]):  # noqa: ANN201
    """A column function of an embedder; an error or an empty vector gives an empty array."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> list[float]:
            try:
                return embed(text)
            except Exception:  # noqa: BLE001  a text that can't be embedded is left without a vector
                return []

        for texts in batches:
            yield texts.map(one)

    return run
