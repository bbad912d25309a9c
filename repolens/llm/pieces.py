"""SentencePiece encoding and decoding for vocabularies of merge type (byte pair encoding with byte fallback).

A text is cut into symbols of one code point.  All adjacent pairs of symbols whose concatenation is a piece wait in an
agenda ordered by the piece's score (higher first) and then by place (left first); the best pair is merged, which puts its
new neighbours on the agenda, until none waits.  Symbols that are no piece become the pieces of their UTF-8 bytes.

Most vocabularies have no piece that goes on after a word's end, none of Latin letters and ASCII punctuation side by side, and none with control
characters, so no merge crosses from another symbol to a space sign, between letters and punctuation, or next to a control
character; a text is the sequence of the parts between these places.  This is read off the vocabulary when it is loaded,
and parts are cut only where it holds.  The same parts come again and again, so
each is encoded once and remembered.  Every part that is encoded is also given to the sentencepiece library, one call a
batch of Arrow rows, and a difference is an error: a wrong id never goes unnoticed.

Defined results: a null text counts as empty; an empty text has the end id alone and decodes to the empty string; texts
of any length are encoded whole, in memory that grows with one text and its parts; repeated rows each get a row; an empty
table gives no rows; extra columns are ignored by ``encode`` and ``op13_pieces``.  Vocabularies that merge otherwise are refused with a ValueError:
other models than byte pair encoding, a character map, removal of blanks, user-defined or unused pieces, no byte fallback.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from repolens.llm.common import text_of

#: The sign that stands for a space.
BLANK = "▁"
#: Control characters that texts are full of, of which a vocabulary may have no piece.
CUTS = "\t\n\x0b\x0c\r"
#: Latin letters and ASCII punctuation, of which most vocabularies have no piece with one beside the other.
LETTERS, SIGNS = "A-Za-z\u00c0-\u024f", re.escape(string.punctuation)
#: Parts whose ids a Python process remembers.
REMEMBERED = 1 << 19
#: Parts of at most so many symbols, all of them pieces, are merged side by side.
LONGEST = 32
#: Rows that are encoded together.
ROWS = 256


class Vocabulary:
    """Pieces and scores of a model file, and the parts it has encoded so far."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.path = path
        with open(path, "rb") as f:
            data = f.read()
        model = sentencepiece_model_pb2.ModelProto.FromString(data)
        kind, rules, trained = sentencepiece_model_pb2.ModelProto.SentencePiece, model.normalizer_spec, model.trainer_spec
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("only byte pair encoding with byte fallback is read")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("a vocabulary that changes characters or removes blanks is not read")
        if {p.type for p in model.pieces} & {kind.USER_DEFINED, kind.UNUSED}:
            raise ValueError("user-defined and unused pieces are not read")
        self.prefix = BLANK if rules.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == kind.CONTROL}
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN}
        self.unknown_surface = trained.unk_surface
        self.bytes = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        if len(self.byte_ids) != 256:
            raise ValueError("a piece for each byte is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.end = self.library.eos_id()
        #: part -> its ids, each with a space before it; such ids -> their text
        self.known: dict[str, str] = {}
        self.texts: dict[str, str] = {}
        self._cut()
        self._tabulate()

    def _cut(self) -> None:
        """The pattern of a part, as far as the pieces allow cutting."""
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        used = set(chain.from_iterable(self.ids))
        cuts = "".join(c for c in CUTS if c not in used)
        self.markable = "\n" in cuts
        if not cuts or BLANK not in self.ids or any(b == BLANK != a for a, b in pairs):
            self.part = re.compile(f"[{re.escape(cuts)}]|[^{re.escape(cuts)}]+" if cuts else r"(?s:.+)")
            return
        stop = BLANK + re.escape(cuts)
        rest = f"[^{stop}]+"
        if not any(re.match(f"[{a}][{b}]", p) for p in pairs for a, b in ((LETTERS, SIGNS), (SIGNS, LETTERS))):
            rest = f"(?:[{LETTERS}]+(?=[{SIGNS}{stop}]|\\Z)|[{SIGNS}]+(?=[{LETTERS}{stop}]|\\Z)|{rest})"
        self.part = re.compile(f"{BLANK}*{rest}|[{re.escape(cuts)}]|{BLANK}+")

    def _tabulate(self) -> None:
        """The pairs of pieces that make a piece, sorted by (left id, right id), the ids they make and the places of these
        in the order of scores; a last row that no pair has."""
        rank = {x: i for i, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        pairs = []
        for piece, made in self.ids.items():
            for i in range(1, len(piece)):
                left, right = self.ids.get(piece[:i]), self.ids.get(piece[i:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, made, rank[self.scores[piece]]))
        self.none = len(rank)
        self.pairs, self.made, self.rank = (np.array(x) for x in zip(*sorted(pairs), (2**62, 0, self.none), strict=True))
        self.singles = {p: i for p, i in self.ids.items() if len(p) == 1}
        self.spelt = [f" {i}" for i in range(len(self.pieces))]
        self.shown = [p.replace(BLANK, " ") for p in self.pieces]

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``none`` if they make no piece) and id of what each pair makes."""
        at = np.searchsorted(self.pairs, left << 32 | right)
        at[self.pairs[at] != (left << 32 | right)] = len(self.pairs) - 1
        return self.rank[at], self.made[at]

    def merged_many(self, parts: list[str]) -> list[list[int]]:
        """``merged`` of parts of at most ``LONGEST`` symbols that are all pieces.  Each has its agenda in a row of a table; a
        round takes the best pair of every row."""
        singles, n = self.singles, len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, n)
        width = int(sizes.max())
        symbols = np.full((n, width + 1), -1, np.int64)
        symbols[np.arange(width + 1) < sizes[:, None]] = [singles[c] for c in chain.from_iterable(parts)]
        ranks = np.full((n, width + 1), self.none)
        makes = np.zeros((n, width + 1), np.int64)
        row, at = np.nonzero(symbols[:, 1:] >= 0)
        ranks[row, at], makes[row, at] = self._look(symbols[row, at], symbols[row, at + 1])
        before, after = (np.tile(np.arange(width + 1) + d, (n, 1)) for d in (-1, 1))
        rows = np.arange(n)
        while len(rows):
            at = ranks[rows].argmin(axis=1)
            some = ranks[rows, at] < self.none
            rows, at = rows[some], at[some]
            gone = after[rows, at]
            follows = after[rows, gone]
            symbols[rows, at] = makes[rows, at]
            symbols[rows, gone] = -1
            ranks[rows, gone] = self.none
            after[rows, at] = follows
            before[rows, np.minimum(follows, width)] = at
            # the new symbol with what follows it, and what comes before with the new symbol
            right = np.where(follows <= width, symbols[rows, np.minimum(follows, width)], -1)
            ranks[rows, at], makes[rows, at] = self._look(symbols[rows, at], right)
            has = before[rows, at] >= 0
            r, a, b = rows[has], at[has], before[rows, at][has]
            ranks[r, b], makes[r, b] = self._look(symbols[r, b], symbols[r, a])
        left = symbols >= 0
        flat, ends = symbols[left].tolist(), np.cumsum(left.sum(axis=1)).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def merged(self, part: str) -> list[int]:
        """The ids of a part, by the agenda."""
        ids, scores = self.ids, self.scores
        symbols = list(part)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []

        def wait(left: int, right: int) -> None:
            score = scores.get(symbols[left] + symbols[right])
            if score is not None:
                heapq.heappush(agenda, (-score, left, right, len(symbols[left]), len(symbols[right])))

        for i in range(n - 1):
            wait(i, i + 1)
        while agenda:
            _, left, right, size, other = heapq.heappop(agenda)
            # either symbol may have grown or gone since the pair was put there
            if len(symbols[left]) != size or len(symbols[right]) != other or after[left] != right:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                wait(left, after[left])
            if before[left] >= 0:
                wait(before[left], left)
        out: list[int] = []
        for s in symbols:
            if s:
                known = ids.get(s)
                if known is None:
                    out.extend(self.byte_ids[b] for b in s.encode())
                else:
                    out.append(known)
        return out

    def surface(self, ids: list[int]) -> str:
        """The text of ids, runs of bytes read as UTF-8, space signs as spaces; the prefix is not taken off."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(_read(run))
                run.clear()
            if i in self.unknown:
                out.append(self.unknown_surface)
            elif i not in self.silent:
                out.append(self.shown[i])
        out.append(_read(run))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that the encoder put first."""
        text = self.surface(ids)
        first = next((i for i in ids if i not in self.silent), None)
        starts_blank = first is not None and first not in self.bytes and first not in self.unknown and self.pieces[first].startswith(BLANK)
        return text[1:] if self.prefix and starts_blank else text

    def parts(self, text: str) -> list[str]:
        return self.part.findall(self.prefix + text.replace(" ", BLANK)) if text else []

    def check(self, parts: list[str], ids: list[list[int]]) -> None:
        """Compare with the library; a line feed before each part keeps its first symbol from the library's own prefix."""
        mark, skip = ("\n", len(self.prefix) + 1) if self.markable else ("", 0)
        if not mark and parts:
            raise ValueError("the parts of this vocabulary can't be checked: it has pieces with line feeds")
        for part, own, theirs in zip(parts, ids, self.library.encode([mark + p for p in parts], num_threads=1), strict=True):
            if own != theirs[skip:]:
                raise RuntimeError(f"the library encodes {part!r} as {theirs[skip:]}, not as {own}")

    def learn(self, parts: set[str]) -> None:
        """Encode parts that are not known, check them, and remember them and their texts."""
        # by length, so that the tables of parts merged side by side are full
        plain = sorted((p for p in parts if len(p) <= LONGEST and self.singles.keys() >= set(p)), key=len)
        odd = sorted(parts.difference(plain))
        ids = [x for i in range(0, len(plain), 8192) for x in self.merged_many(plain[i : i + 8192])]
        self.check(plain, ids)
        spelt, shown = self.spelt, self.shown
        coded = ["".join([spelt[i] for i in own]) for own in ids]
        self.known.update(zip(plain, coded, strict=True))
        self.texts.update((c, "".join([shown[i] for i in own])) for c, own in zip(coded, ids, strict=True))
        ids = [self.merged(p) for p in odd]
        self.check(odd, ids)
        for part, own in zip(odd, ids, strict=True):
            self.known[part] = coded = "".join([spelt[i] for i in own])
            self.texts[coded] = self.surface(own)

    def encoded(self, texts: list[str]) -> list[list[str]]:
        """For each text, the ids of each of its parts in order."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.texts.clear()
        get = self.known.get
        dealt = [self.parts(t) for t in texts]
        coded = [list(map(get, parts)) for parts in dealt]
        new = {p for parts, own in zip(dealt, coded, strict=True) if None in own for p, c in zip(parts, own, strict=True) if c is None}
        if new:
            self.learn(new)
            coded = [list(map(get, parts)) if None in own else own for parts, own in zip(dealt, coded, strict=True)]
        return coded


def _read(run: bytearray) -> str:
    """Bytes as UTF-8; each byte that is part of no character gives one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("\ufffd")
                n = 1
            i += n
        return "".join(out)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once by a Python process."""
    return Vocabulary(path)


def _groups(column: pa.Array) -> Iterator[list[str]]:
    for i in range(0, len(column), ROWS):
        yield [t or "" for t in column.slice(i, ROWS).to_pylist()]


def encode_texts(texts: list[str], path: str, end: bool = True) -> list[list[int]]:
    """The ids of each text, with the end id last."""
    v = vocabulary(path)
    return [[int(i) for i in "".join(coded).split()] + ([v.end] if end else []) for coded in v.encoded(texts)]


def decode_ids(ids: list[list[int]], path: str) -> list[str]:
    v = vocabulary(path)
    return [v.decode(i) for i in ids]


def encode(docs: DataFrame, path: str, end: bool = True, text: str = "text") -> DataFrame:
    """A frame of doc_id and ids (array of int) of every row of ``docs``; ``path`` is the model's on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in enumerate(_groups(batch["text"])):
                rows = batch["doc_id"].slice(at * ROWS, ROWS)
                yield pa.RecordBatch.from_arrays([rows, pa.array(encode_texts(texts, path, end), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", text_of(text).alias("text")).mapInArrow(run, _schema(docs, "ids array<int>"))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """A frame of doc_id and text of every row of ``rows`` (doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = decode_ids([x or [] for x in batch["ids"].to_pylist()], path)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, _schema(rows, "text string"))


def _schema(docs: DataFrame, more: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {more}"


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: digests of what ``encode`` and ``decode`` give, which
    are formed part by part so that no list of ids is built."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            sizes, coded, decoded = [], [], []
            for texts in _groups(batch["text"]):
                for parts in v.encoded(texts):
                    ids = f"{''.join(parts)} {v.end}"[1:]
                    back = "".join(map(v.texts.__getitem__, parts))
                    sizes.append(ids.count(" ") + 1)
                    coded.append(hashlib.sha256(ids.encode()).hexdigest())
                    # the first part begins with the prefix, if the text has any
                    decoded.append(hashlib.sha256(back[len(v.prefix) :].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, _schema(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over ``documents``."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
