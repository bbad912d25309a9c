"""The Merkle manifest, spelling variants and SentencePiece pieces, each against a plain version or the library."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repolens.llm import merkle, pieces, spelling

# -- merkle -------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):  # noqa: ANN001, ANN201
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(row: list[str]) -> list[list[str]]:
    levels = [row]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_siblings(levels: list[list[str]], i: int) -> list[str | None]:
    out = []
    for row in levels[:-1]:
        out.append(row[i ^ 1] if i ^ 1 < len(row) else None)
        i //= 2
    return out


def plain_fold(h: str, i: int, siblings: list[str | None]) -> str:
    for other in siblings:
        h = digest(h) if other is None else digest(other, h) if i % 2 else digest(h, other)
        i //= 2
    return h


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, plain_leaf(*r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: plain_tree([leaf for _, leaf in groups[g]]) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (r, leaf) in enumerate(groups[g]):
            own, above = plain_siblings(trees[g], i), plain_siblings(top, k)
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            claimed = plain_leaf(*r[:4], r[4] + 1) if hit else leaf
            folded = plain_fold(plain_fold(claimed, i, own), k, above)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], digest(*[s for s in own + above if s]), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "block", "parts"), [(0, 12, 1), (1, 12, 1), (3, 2, 3), (40, 12, 5), (40, 2, 5), (700, 3, 9)])
def test_manifest(spark, n, block, parts):
    rng = random.Random(n * 100 + block)
    rows = [
        (rng.choice([i, i, None, 3]), rng.choice([None, "", "x", "é" * rng.randint(0, 9), "long " * 20_000]), rng.choice([None, "en", "de", "", "é", "fr"]), rng.choice(["a", None]), rng.choice([None, i, 5]))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    got = merkle.verify(merkle.manifest(merkle.leaves(df.withColumn("grp", F.lit(1)).withColumn("at", F.lit("x")).withColumn("a.b", F.lit(0))), block))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_one_row_repeated(spark):
    """A third of all rows are copies of one: places go on, and the tree is whole whatever the shuffled joins."""
    rows = [(7, "same", "en", "s", 4)] * 300 + [(i, str(i), "en" if i % 2 else None, None, i) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, merkle.verify(merkle.manifest(merkle.leaves(df), 4)).collect()), key=repr) == plain_manifest(rows)


def test_manifest_by_shuffled_joins(spark, monkeypatch):
    from repolens.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    rows = [(i, str(i), "en" if i % 3 else None, None, i) for i in range(150)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, merkle.verify(merkle.manifest(merkle.leaves(df), 3)).collect()), key=repr) == plain_manifest(rows)


# -- spelling -----------------------------------------------------------------------------------------


def plain_words(rows: list[tuple]) -> dict[str, int]:
    found = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                found[w] += 1
    return {w: n for w, n in found.items() if n >= 5}


def plain_near(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words: dict[str, int]) -> list[tuple]:
    forms, near = {}, {}
    for w, n in words.items():
        met = [x for x in words if plain_near(w, x)]
        best = min(met, key=lambda x: (-words[x], x), default=None)
        forms[w], near[w] = (best if best is not None and words[best] >= 5 * n else None), len(met)
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, near[w], words.get(forms[w])))
    return sorted(out, key=repr)


def spelt(df):  # noqa: ANN001, ANN201
    runs = spelling.occurrences(df).select(spelling.damaged(F.col("doc_id"), F.col("run")).alias("word"))
    return sorted(map(tuple, spelling.variants(spelling.vocabulary(runs)).collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 150])
def test_spelling(spark, n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abéAB÷ß") for _ in range(rng.choice([5, 6, 6, 7])))
    rows = [(rng.choice([i, None]), rng.choice([None, "", " ".join(word() for _ in range(400)), "x" * 50_000])) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("a.b", F.lit(1))
    assert spelt(df) == plain_variants(plain_words(rows))


def test_spelling_chains_ties_and_hot_words(spark, monkeypatch):
    counts = {"abcdefgh": 6, "abcdefgx": 40, "abcdefxx": 300, "abcdefxxy": 1600, "tiebreak": 5, "tiebrexk": 30, "tiebreax": 30, "ännderung": 5, "änderung": 25}
    rows = [(None, f"{w} ") for w, n in counts.items() for _ in range(n)]
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: r for r in spelling.variants(words).collect()}
    assert [got["abcdefgh"][c] for c in ("form", "root", "n_near", "form_n")] == ["abcdefgx", "abcdefxxy", 1, 40]
    assert got["tiebreak"]["form"] == "tiebreax" and got["tiebreak"]["n_near"] == 2
    assert got["ännderung"]["form"] == "änderung" and got["änderung"]["form"] is None
    assert sorted(map(tuple, spelling.variants(words).collect()), key=repr) == plain_variants(counts)
    from repolens.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, spelling.variants(words).collect()), key=repr) == plain_variants(counts)
    assert spelt(spark.createDataFrame(rows, "doc_id long, text string")) == plain_variants(plain_words(rows))


# -- pieces -------------------------------------------------------------------------------------------

try:
    import public_tokenizers

    MODEL = public_tokenizers.path("piece_bpe_32k.model")
except ImportError:
    MODEL = None
has_model = pytest.mark.skipif(MODEL is None, reason="the public vocabularies are not here")
BITS = [" ", "▁", "\n", "\r", "\t", "a", "e", "th", "the", "ing", "▁▁", "  ", "\x00", "é", "ü", "中", "😀", "́", "　", "﻿", "<s>", "</s>", "<unk>", "<0x41>", ".", "),", "”", "0", "42", "A"]


@cache
def reference():  # noqa: ANN201
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture
def library():  # noqa: ANN201
    return reference()


@has_model
@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=25).map("".join) | st.text(max_size=40), max_size=6))
def test_pieces_as_the_library(texts):
    sp = reference()
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids = pieces.encode_texts(texts, MODEL)
    assert ids == [sp.encode(t, add_eos=True) for t in texts]
    assert pieces.decode_ids(ids, MODEL) == [sp.decode(i) for i in ids]


@has_model
@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, 31999), max_size=12))
def test_any_ids_decode_as_the_library(ids):
    assert pieces.decode_ids([ids], MODEL)[0] == reference().decode(ids)


@has_model
def test_agenda_alone_and_side_by_side(library):
    """Both forms of the agenda merge alike, parts without cuts too, and forgetting changes nothing."""
    v = pieces.vocabulary(MODEL)
    rng = random.Random(6)
    parts = ["▁" + "".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(1, 31))) for _ in range(500)]
    assert v.merged_many(parts) == [v.merged(p) for p in parts]
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(60_000))
    assert pieces.encode_texts([long, ""], MODEL, end=False) == library.encode([long, ""])
    v.known.clear()
    assert pieces.encode_texts(["a b a"], MODEL) == library.encode(["a b a"], add_eos=True)


@has_model
def test_a_difference_is_an_error():
    v = pieces.Vocabulary(MODEL)
    with pytest.raises(RuntimeError, match="the library encodes"):
        v.check(["▁the"], [[1, 2]])


@has_model
def test_digests_of_rows(spark, library):
    rows = [(1, None, 0), (2, "", 0), (3, " two  words\n", 0), (3, " two  words\n", 0), (None, "ünï ▁ 😀\x00", 0), (5, "word, " * 30_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumn("a.b", F.lit(1))
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_eos=True)
        want.append((doc_id, len(ids), hexed(" ".join(map(str, ids))), hexed(library.decode(ids))))
    assert sorted(map(tuple, pieces.digests(df, MODEL).collect()), key=repr) == sorted(want, key=repr)
    coded = pieces.encode(df, MODEL)
    assert sorted(map(tuple, pieces.decode(coded, MODEL).collect()), key=repr) == sorted(((d, library.decode(library.encode(t or ""))) for d, t, _ in rows), key=repr)
    assert pieces.digests(df.limit(0), MODEL).count() == 0


@has_model
def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(MODEL, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="byte pair"):
        pieces.Vocabulary(str(tmp_path / "m.model"))
