"""A tokenizer for the C-like languages and what the parsers share: bracket matching, scopes, records."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from dataclasses import dataclass, field

MAX_SOURCE, MAX_VALUE, MAX_ARG = 5000, 200, 100
_OPEN, _CLOSE = "([{", ")]}"


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, template, regex, punct, variable
    text: str
    start: int
    end: int


@dataclass(slots=True)
class Scope:
    """A stretch of tokens that encloses others: a class or a function."""

    kind: str
    name: str
    first: int
    last: int
    line: int


@dataclass
class Stream:
    """Tokens of a file, the partner of each bracket, and the comments."""

    source: str
    tokens: list[Token]
    comments: list[tuple[int, int]]
    partner: dict[int, int] = field(default_factory=dict)
    _lines: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "punct":
                continue
            if t.text in _OPEN:
                stack.append(i)
            elif t.text in _CLOSE:
                want = _OPEN[_CLOSE.index(t.text)]
                while stack and self.tokens[stack[-1]].text != want:  # an unclosed bracket inside
                    self.partner[stack.pop()] = i
                if stack:
                    self.partner[stack[-1]] = i
                    self.partner[i] = stack.pop()
        for i in stack:
            self.partner[i] = len(self.tokens) - 1
        self._lines = [m.start() for m in re.finditer("\n", self.source)]

    def __len__(self) -> int:
        return len(self.tokens)

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def is_punct(self, i: int, *texts: str) -> bool:
        if not 0 <= i < len(self.tokens):
            return False
        t = self.tokens[i]
        return t.kind == "punct" and t.text in texts

    def line(self, i: int) -> int:
        """1-based line of a token's start."""
        return bisect.bisect_left(self._lines, self.tokens[i].start) + 1

    def end_line(self, i: int) -> int:
        return bisect.bisect_left(self._lines, self.tokens[i].end - 1) + 1

    def between(self, i: int, j: int) -> str:
        """Source from token i to token j, both included."""
        return self.source[self.tokens[i].start : self.tokens[j].end] if j >= i else ""

    def close(self, i: int) -> int:
        return self.partner.get(i, len(self.tokens) - 1)

    def docstring(self, i: int) -> str | None:
        """The comment that ends right before token i, if it opens with ``/**``."""
        at = self.tokens[i].start
        k = bisect.bisect_left(self.comments, (at, at)) - 1
        if k < 0:
            return None
        low, high = self.comments[k]
        body = self.source[low:high]
        return body if body.startswith("/**") and not self.source[high:at].strip() else None

    def parts(self, i: int, j: int, angle: bool = False) -> list[tuple[int, int]]:
        """Token ranges (first, last) between commas on the top level of the tokens strictly between i and j."""
        out, first, k = [], i + 1, i + 1
        while k < j:
            if self.is_punct(k, *_OPEN):
                k = self.close(k)
            elif angle and self.is_punct(k, "<"):
                k = self.angle_end(k)
            elif self.is_punct(k, ","):
                out.append((first, k - 1))
                first = k + 1
            k += 1
        out.append((first, j - 1))
        return [(a, b) for a, b in out if b >= a]

    def angle_end(self, i: int) -> int:
        """The ``>`` that closes the type arguments opened at i, or i itself if these are none."""
        depth, k = 0, i
        while k < len(self.tokens) and k < i + 400:
            t = self.tokens[k]
            if t.kind == "punct":
                if t.text == "<":
                    depth += 1
                elif t.text in (">", ">>", ">>>"):
                    depth -= len(t.text)
                    if depth <= 0:
                        return k
                elif t.text in "([{":
                    k = self.close(k)
                elif t.text not in (",", ".", "|", "&", "[", "]", "?", ":", "=>", "="):
                    return i
            elif t.kind not in ("name", "string", "number"):
                return i
            k += 1
        return i


def enclosing(scopes: list[Scope], i: int, kinds: tuple[str, ...]) -> Scope | None:
    """The innermost scope of one of these kinds around token i that does not start at it."""
    best = None
    for s in scopes:
        if s.first > i:
            break
        if s.kind in kinds and s.first < i <= s.last and (best is None or s.first >= best.first):
            best = s
    return best


def file_record(path: str, lang: str) -> dict:
    return {"path": path, "lang": lang, "functions": [], "classes": [], "imports": [], "calls": [], "variables": []}


def function_record(name: str, line: int, end: int, args: list[str], source: str | None, doc: str | None, complexity: int, **more: object) -> dict:
    base = {"context": None, "class_context": None, "decorators": [], "is_async": False, "kind": None}
    return {"name": name, "line_number": line, "end_line": end, "args": args, "source": source, "docstring": doc, "cyclomatic_complexity": complexity} | base | more


def class_record(name: str, line: int, end: int, bases: list[str], implements: list[str], source: str | None, doc: str | None, **more: bool) -> dict:
    base = {"is_abstract": False, "is_interface": False}
    return {"name": name, "line_number": line, "end_line": end, "bases": bases, "implements": implements, "source": source, "docstring": doc} | base | more


def import_record(name: str, source: str, line: int, alias: str | None = None, is_default: bool = False, is_namespace: bool = False) -> dict:
    return {"name": name, "source": source, "alias": alias, "line_number": line, "is_default": is_default, "is_namespace": is_namespace}


def call_record(name: str, line: int, args: list[str], full: str, obj: str | None, caller: Scope | None) -> dict:
    return {
        "name": name, "line_number": line, "args": args, "caller_name": caller.name if caller else None,
        "caller_line_number": caller.line if caller else None, "full_call_name": full, "inferred_obj_type": obj,
    }


def variable_record(name: str, line: int, value: str | None, kind: str | None, context: str | None, class_context: str | None) -> dict:
    return {"name": name, "line_number": line, "value": value[:MAX_VALUE] if value is not None else None, "type": kind, "context": context, "class_context": class_context}


Counter = Callable[[Stream, int], int]


def complexity(stream: Stream, first: int, last: int, weight: Counter) -> int:
    """One plus the branch tokens from first to last."""
    return 1 + sum([weight(stream, i) for i in range(first, last + 1)])
