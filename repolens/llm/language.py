"""Language identification: script ranges narrow the candidates, then Viterbi labels spans of words.

Each word gets a score per language, the sum over its byte trigrams (with a blank at either end) of log probabilities
learnt from labelled documents.  Words are runs of letters and their marks; digits and punctuation of any block only part
them, so a typographic apostrophe or dash tells no more than a plain one.  The script of a word, read from the ranges that
the code points of its letters fall in, rules out languages that are hardly ever written in it.  Viterbi over the words of
a text, with a penalty for each switch, gives spans of one language; a text's language is that of most of its letters.
Texts of a batch go through Viterbi side by side, one word of each at a time.

Learning counts trigrams over at most about ``MAX_PER_LANGUAGE`` documents (those with the smallest hashes) of each of the
``MAX_LANGUAGES`` most frequent languages; counting is distributed, and only totals reach the driver (languages x 65,536
numbers at most).

Defined results: ``und`` with score 0 for a text that is null or has no letter; null languages teach nothing; a language
never seen in learning, or of those beyond ``MAX_LANGUAGES`` that sort last by rows and then name, can't be predicted;
without any labelled row every prediction is ``und``; an empty table gives no rows.  Extra columns are ignored by learning
and kept by ``identify``, whose own ``lang_pred`` and ``score`` replace columns of these names.  The score is the share of
letters in the winning language; ties go to the language that sorts first.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from repolens.llm.textbytes import buffers, pieces

#: Documents per language that a model is learnt from, about (a hash threshold picks them).
MAX_PER_LANGUAGE = 1_000
#: Languages that a model knows at most: it holds languages x 65,536 numbers in every task.
MAX_LANGUAGES = 256
SWITCH_PENALTY = 8.0
#: A language is a candidate for a script if at least this share of its words has the script.
SCRIPT_SHARE = 0.001
GROUP_BYTES = 4 << 20
_TABLE = 1 << 16

#: Scripts as ranges of code points (fixed values of the Unicode blocks), in the order in which one in a word outranks the
#: ones before; a letter in none of them is of the last script, "other".
SCRIPTS = {
    "Latin": ((0x41, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x530, 0x58F), (0xFB13, 0xFB17)), "Hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)), "Syriac": ((0x700, 0x74F), (0x860, 0x86F)), "Thaana": ((0x780, 0x7BF),),
    "Devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)), "Bengali": ((0x980, 0x9FF),), "Gurmukhi": ((0xA00, 0xA7F),), "Gujarati": ((0xA80, 0xAFF),), "Oriya": ((0xB00, 0xB7F),),
    "Tamil": ((0xB80, 0xBFF),), "Telugu": ((0xC00, 0xC7F),), "Kannada": ((0xC80, 0xCFF),), "Malayalam": ((0xD00, 0xD7F),), "Sinhala": ((0xD80, 0xDFF),),
    "Thai": ((0xE00, 0xE7F),), "Lao": ((0xE80, 0xEFF),), "Tibetan": ((0xF00, 0xFFF),), "Myanmar": ((0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)), "Ethiopic": ((0x1200, 0x139F), (0x2D80, 0x2DDF)), "Khmer": ((0x1780, 0x17FF),), "Mongolian": ((0x1800, 0x18AF),),
    "Han": ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
    "Kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)), "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)),
}
N_SCRIPTS = len(SCRIPTS) + 2
#: Code points from here on hold no letters.
_END = 0x40000


@functools.cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its script (0: neither a letter nor a mark, or a mark of all scripts) and whether it is a letter."""
    kind = [unicodedata.category(chr(c))[0] for c in range(_END)]
    letter = np.array([k == "L" for k in kind])
    script = np.where(letter, N_SCRIPTS - 1, 0).astype(np.uint8)
    own = letter | np.array([k == "M" for k in kind])
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            script[low : high + 1] = np.where(own[low : high + 1], number, 0)
    return script, letter


_ASCII_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_ASCII_PLAIN = np.where(_ASCII_LETTER | (np.arange(256) >= 128), np.arange(256), 32).astype(np.uint8)


def _read(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with all but letters and marks as blanks, and the script and the number of letters at the first byte of
    each character."""
    plain, letters = _ASCII_PLAIN[data], _ASCII_LETTER[data].astype(np.int64)
    scripts = letters.astype(np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        script, letter = _kinds()
        first = data[lead]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first.astype(np.int64) & (0x7F >> size)
        for k in range(1, 4):
            code = np.where(k < size, (code << 6) | (data[np.minimum(lead + k, len(data) - 1)] & 0x3F), code)
        code = np.minimum(code, _END - 1)
        scripts[lead], letters[lead] = script[code], letter[code]
        # marks that go with any script stay in their word
        none = (script[code] == 0) & ~((code >= 0x300) & (code <= 0x36F))
        for k in range(4):
            plain[lead[none & (k < size)] + k] = 32
    return plain, scripts, letters


def _trigrams(data: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """A table slot for the trigram around each byte; a blank stands where a text begins or ends (``inner`` is false)."""
    before = np.concatenate([[32], data[:-1]]).astype(np.uint32)
    after = np.concatenate([data[1:], [32]]).astype(np.uint32)
    before[~inner[:-1]] = 32
    after[~inner[1:]] = 32
    code = (before << np.uint32(16)) | (data.astype(np.uint32) << np.uint32(8)) | after
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def _segments(column: pa.Array) -> Iterator[tuple[int, int, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece: first text, last + 1, whether it ends there, text of each word, word starts, letters, scripts, and
    (blanked bytes, trigram slots) as one pair of arrays."""
    data, offsets = buffers(pc.utf8_lower(pc.fill_null(column, "")))
    for i, j, low, high, ends in pieces(data, offsets):
        raw = data[low:high]
        plain, script, letter = _read(raw)
        inner = np.ones(len(raw) + 1, bool)
        edges = np.clip(offsets[i : j + 1], low, high) - low
        inner[edges] = False
        inner[0] = inner[-1] = False
        solid = plain != 32
        if not len(raw) or not solid.any():
            empty = np.zeros(0, np.int64)
            yield i, j, ends, empty, empty, empty, empty, (plain, np.zeros(len(raw), np.uint32))
            continue
        before = np.concatenate([[False], solid[:-1]]) & inner[:-1]
        begin = np.flatnonzero(solid & ~before)
        letters = np.add.reduceat(letter, begin)
        scripts = np.maximum.reduceat(script, begin)
        text = np.searchsorted(edges, begin, side="right") - 1 + i
        yield i, j, ends, text, begin, letters, scripts, (plain, _trigrams(plain, inner))


@dataclass
class LanguageModel:
    """log probabilities (slots x languages) and the languages that each script allows (scripts x languages)."""

    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray

    def emissions(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(text, letters, scores, texts that are complete) of the words, piece by piece."""
        for _, j, ends, text, begin, letters, scripts, (plain, slots) in _segments(column):
            if not len(begin):
                yield text, letters, np.zeros((0, len(self.languages)), np.float32), j if ends else j - 1
                continue
            each = self.weights[slots]
            each[plain == 32] = 0
            scores = np.add.reduceat(each, begin, axis=0)
            scores[~self.allowed[scripts]] -= 50.0
            yield text, letters, scores, j if ends else j - 1


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word for texts laid end to end (``counts`` words each)."""
    out = np.zeros(len(scores), np.int16)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    if not len(counts) or not counts[0]:
        return out
    longest = int(counts[0])
    active = np.searchsorted(-counts, -np.arange(longest), side="left")  # texts with more than t words
    stays = np.ones(scores.shape, bool)
    best = np.zeros(len(scores), np.int16)  # where a switch into the word comes from
    state = scores[starts[: active[0]]].astype(np.float64)
    last = np.zeros(len(counts), np.int16)
    for t in range(1, longest):
        n = active[t]
        if n < len(state):
            last[n : len(state)] = state[n:].argmax(axis=1)
            state = state[:n]
        at = starts[:n] + t
        top = state.argmax(axis=1)
        limit = (state[np.arange(n), top] - penalty)[:, None]
        stay = state >= limit
        stays[at], best[at] = stay, top
        state = np.where(stay, state, limit) + scores[at]
    last[: len(state)] = state.argmax(axis=1)
    now = last.copy()
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        out[at] = now[:n]
        if t:
            now[:n] = np.where(stays[at, now[:n]], now[:n], best[at])
    return out


def labelled(model: LanguageModel, column: pa.Array, penalty: float = SWITCH_PENALTY) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, letters, language) of the words of a column, for groups of whole texts."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, letters, scores = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        _, counts = np.unique(text, return_counts=True)
        return text, letters, viterbi(scores, counts, penalty)

    done = 0
    for text, letters, scores, complete in model.emissions(column):
        held.append((text, letters, scores))
        size += len(text)
        if size * 6 > GROUP_BYTES and complete > done:
            whole = not len(text) or text[-1] < complete
            if whole:
                yield flush()
                size, done = 0, complete
    if held:
        yield flush()


def predict(model: LanguageModel | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    n = len(column)
    if model is None or not model.languages:
        return ["und"] * n, np.zeros(n)
    width = len(model.languages)
    mass = np.zeros((n, width))
    for text, letters, language in labelled(model, column):
        mass += np.bincount(text * width + language, letters, n * width).reshape(n, width)
    total = mass.sum(axis=1)
    win = mass.argmax(axis=1)
    score = np.where(total > 0, mass[np.arange(n), win] / np.maximum(total, 1), 0.0)
    return [model.languages[k] if some else "und" for k, some in zip(win, total > 0, strict=True)], score


def spans(model: LanguageModel, column: pa.Array) -> list[list[tuple[str, int, int]]]:
    """For each text its spans (language, first word, last word + 1)."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(column))]
    for text, _, language in labelled(model, column):
        cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (language[1:] != language[:-1])]))
        first = np.searchsorted(text, text[cut])
        for a, b, base in zip(cut, [*cut[1:], len(text)], first, strict=True):
            out[text[a]].append((model.languages[language[a]], int(a - base), int(b - base)))
    return out


def learn(docs: DataFrame, max_per_language: int = MAX_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> LanguageModel | None:
    """Learn from ``docs`` (doc_id, text, lang); None without a labelled row."""
    known = docs.where("lang is not null")
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
    sizes = {x["lang"]: x["count"] for x in most.collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    place = {k: i for i, k in enumerate(languages)}
    limits = F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, max_per_language / sizes[k])))]), F.col("lang"))
    known = known.where(F.col("lang").isin(languages))
    # a hash as a number from 0 to 1: the rows of a language below its limit are its sample
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([place[k] for k in batch["lang"].to_pylist()])
            for i, j, _, text, begin, _, script, (plain, slots) in _segments(batch["text"]):
                if not len(begin):
                    continue
                solid = np.flatnonzero(plain != 32)
                row = own[text[np.searchsorted(begin, solid, side="right") - 1]]
                for kind, width, codes in ((0, _TABLE, row * _TABLE + slots[solid]), (1, N_SCRIPTS, own[text] * N_SCRIPTS + script)):
                    code, n = np.unique(codes, return_counts=True)
                    which, slot = (code // width).astype(np.int32), (code % width).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind, np.int32)), pa.array(which), pa.array(slot), pa.array(n)], names=["kind", "language", "slot", "n"])

    counts = known.where(part < limits).select("lang", "text").mapInArrow(counted, "kind int, language int, slot int, n long")
    totals = counts.groupBy("kind", "language", "slot").agg(F.sum("n").alias("n")).toPandas()
    grams, scripts = np.zeros((_TABLE, len(languages))), np.zeros((N_SCRIPTS, len(languages)))
    for table, kind in ((grams, 0), (scripts, 1)):
        rows = totals[totals["kind"] == kind]
        table[rows["slot"].to_numpy(), rows["language"].to_numpy()] = rows["n"].to_numpy()
    weights = np.log((grams + 0.1) / (grams.sum(axis=0) + 0.1 * _TABLE)).astype(np.float32)
    allowed = scripts >= np.maximum(SCRIPT_SHARE * scripts.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True  # a script that no language has narrows nothing
    return LanguageModel(languages, weights, allowed)


def _learning(docs: DataFrame) -> DataFrame:
    from_id = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", "text", "lang", (F.pmod(from_id, F.lit(5)) == 0).alias("held_out"))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` (its columns, with ``text``) plus lang_pred and score, and without text."""
    docs = docs.drop("lang_pred", "score")
    names = [c for c in docs.columns if c != "text"]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = predict(model, batch["text"])
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(found, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    kept = [x for x in docs.schema if x.name != "text"]
    return docs.mapInArrow(predicted, StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learnt without the rows of remainder 0, predicted for every document."""
    docs = _learning(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = learn(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model)


