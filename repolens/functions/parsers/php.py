"""PHP."""

from __future__ import annotations

import re

from repolens.functions.parsers.tokens import (
    MAX_ARG,
    Scope,
    Stream,
    Token,
    call_record,
    class_record,
    complexity,
    enclosing,
    file_record,
    function_record,
    import_record,
    variable_record,
)

_LEX = re.compile(
    r"""(?P<space>\s+)|(?P<close>\?>)|(?P<comment>//[^\n]*?(?=\?>|\n|\Z)|\#(?!\[)[^\n]*?(?=\?>|\n|\Z)|/\*.*?(?:\*/|\Z))
      |(?P<heredoc><<<[ \t]*(?P<quote>["']?)(?P<mark>[A-Za-z_]\w*)(?P=quote)\r?\n.*?^[ \t]*(?P=mark)\b)
      |(?P<variable>\$\$*[A-Za-z_\u0080-￿][\w\u0080-￿]*)
      |(?P<name>\\?[A-Za-z_\u0080-￿][\w\u0080-￿]*(?:\\[A-Za-z_\u0080-￿][\w\u0080-￿]*)*)
      |(?P<number>0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)
      |(?P<string>"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|`[^`]*`?)
      |(?P<punct>\?->|->|=>|::|\.\.\.|\?\?=?|<=>|===?|!==?|&&|\|\||\*\*=?|\+\+|--|<<=?|>>=?|[-+*/.%&|^<>]=|[-+*/.%&|^~!<>=?:;,(){}\[\]@\#$\\])
      |(?P<other>.)""",
    re.X | re.S | re.M,
)
_BRANCH = frozenset(("if", "else", "elseif", "for", "foreach", "while", "do", "case", "catch", "and", "or"))
_LOGIC = frozenset(("&&", "||", "??"))
_INCLUDES = frozenset(("include", "include_once", "require", "require_once"))
_NOT_CALLED = frozenset(
    ("if", "elseif", "for", "foreach", "while", "switch", "catch", "match", "function", "fn", "array", "list", "isset", "unset", "empty", "exit", "die", "echo",
     "print", "return", "declare", "use", "new", "and", "or", "xor", "static", "clone", "throw", "yield", "else", "do", "case", *_INCLUDES)
)
_MODIFIERS = frozenset(("public", "private", "protected", "static", "abstract", "final", "readonly", "var"))
FUNCTIONS = ("function", "method")


def tokenize(source: str) -> Stream:
    tokens: list[Token] = []
    comments: list[tuple[int, int]] = []
    i, n = 0, len(source)
    while i < n:
        opened = re.compile(r"<\?(?:php\b|=)?").search(source, i)
        if not opened:
            break
        i = opened.end()
        while i < n:
            m = _LEX.match(source, i)
            i = m.end()
            kind = m.lastgroup
            if m["heredoc"] is not None:
                tokens.append(Token("string", m["heredoc"], m.start(), m.end()))
            elif kind == "close":
                break
            elif kind == "comment":
                comments.append(m.span())
            elif kind not in ("space", "other"):
                tokens.append(Token(kind, m[0], m.start(), m.end()))
    return Stream(source, tokens, comments)


def _branches(s: Stream, i: int) -> int:
    t = s.tokens[i]
    if t.kind == "punct":
        # a question mark before a type name after a bracket, comma or colon marks a type that may be null
        return int(t.text in _LOGIC or (t.text == "?" and not s.is_punct(i - 1, ":", "(", ",")))
    if t.kind != "name" or t.text.lower() not in _BRANCH or s.is_punct(i - 1, "->", "::", "?->"):
        return 0
    word = t.text.lower()
    if word == "while" and s.is_punct(i - 1, "}") and s.text(s.partner.get(i - 1, -1) - 1).lower() == "do":
        return 0
    return 1


class _File:
    def __init__(self, path: str, source: str, is_dependency: bool) -> None:
        self.s = tokenize(source)
        self.out = file_record(path, "php")
        self.dependency = is_dependency
        self.scopes: list[Scope] = []
        self.headers: set[int] = set()
        self.functions: list[tuple[int, int, dict]] = []
        self.variables: list[tuple[int, dict]] = []

    def kept(self, text: str) -> str | None:
        return None if self.dependency else text

    def word(self, i: int) -> str:
        return self.s.text(i).lower() if self.s.kind(i) == "name" else ""

    def start(self, i: int) -> int:
        """Over the modifiers before a definition."""
        while self.word(i - 1) in _MODIFIERS:
            i -= 1
        return i

    def decorators(self, first: int) -> list[str]:
        """Attributes ``#[...]`` right before token first."""
        s, out = self.s, []
        while s.is_punct(first - 1, "]") and s.is_punct(s.partner.get(first - 1, 0) - 1, "#"):
            open_ = s.partner[first - 1]
            out.insert(0, s.between(open_ - 1, first - 1))
            first = open_ - 1
        return out

    def params(self, p: int) -> list[str]:
        s, names = self.s, []
        for a, b in s.parts(p, s.close(p)):
            for k in range(a, b + 1):
                if s.kind(k) == "variable":
                    names.append(("..." if s.is_punct(k - 1, "...") else "") + s.text(k))
                    break
        return names

    def find_definitions(self) -> None:
        s = self.s
        for i in range(len(s)):
            word = self.word(i)
            if s.is_punct(i - 1, "->", "::", "?->"):
                continue
            if word in ("class", "interface", "trait", "enum") and s.kind(i + 1) == "name" and self.word(i - 1) != "new":
                self.classlike(i, word)
            elif word == "function":
                k = i + 1 + s.is_punct(i + 1, "&")
                if s.kind(k) == "name" and s.is_punct(k + 1, "("):
                    self.function(i, k)
            elif word == "use" and s.kind(i + 1) == "name" and not s.is_punct(i - 1, ")"):
                self.use(i)
            elif word in _INCLUDES:
                k = i + 1 + s.is_punct(i + 1, "(")
                end = k
                while end + 1 < len(s) and not s.is_punct(end + 1, ";", ")"):
                    end += 1
                target = s.between(k, end).replace("'", "").replace('"', "")
                if target:
                    self.out["imports"].append(import_record(target, target, s.line(i)))

    def classlike(self, i: int, word: str) -> None:
        s, k = self.s, i + 2
        lists = {"extends": [], "implements": []}
        into = None
        while k < len(s) and not s.is_punct(k, "{", ";"):
            if self.word(k) in lists:
                into = lists[self.word(k)]
            elif s.kind(k) == "name" and into is not None:
                into.append(s.text(k).lstrip("\\"))
            k += 1
        if not s.is_punct(k, "{"):
            return
        last, first = s.close(k), self.start(i)
        name = s.text(i + 1)
        # members of interfaces, traits and enums have no class around them
        self.scopes.append(Scope("class" if word == "class" else "type", name, first, last, s.line(first)))
        if word == "enum":
            self.members(k, last)
            return
        abstract = any(self.word(j) == "abstract" for j in range(first, i))
        self.out["classes"].append(
            class_record(
                name, s.line(first), s.end_line(last), lists["extends"], lists["implements"], self.kept(s.between(first, last)), s.docstring(first),
                is_abstract=abstract, is_interface=word == "interface",
            )
        )
        self.members(k, last)

    def members(self, body: int, last: int) -> None:
        """Properties and constants of a class body."""
        s, k = self.s, body + 1
        while k < last:
            if s.is_punct(k, "{", "(", "["):
                k = s.close(k)
            elif self.word(k) == "function":
                while k < last and not s.is_punct(k, "{", ";"):
                    k = s.close(k) if s.is_punct(k, "(") else k
                    k += 1
                k = s.close(k) if s.is_punct(k, "{") else k
            elif self.word(k) == "use":
                while k < last and not s.is_punct(k, ";", "{"):
                    self.headers.add(k)
                    k += 1
                k = s.close(k) if s.is_punct(k, "{") else k
            elif s.kind(k) == "variable" or self.word(k) == "const":
                k = self.property(k, last)
            k += 1

    def property(self, k: int, last: int) -> int:
        s = self.s
        constant = self.word(k) == "const"
        at = k
        if constant:
            while at + 1 < last and not s.is_punct(at + 1, "=", ";"):
                at += 1
        end = at
        while end < last and not s.is_punct(end, ";"):
            end = s.close(end) if s.is_punct(end, "(", "[", "{") else end
            end += 1
        value = s.between(at + 2, end - 1) if s.is_punct(at + 1, "=") else None
        if not self.dependency:
            self.variables.append((at, variable_record(s.text(at), s.line(at), value, "const" if constant else None, None, None)))
        return end

    def function(self, i: int, name: int) -> None:
        s, p = self.s, name + 1
        self.headers.add(name)
        k = s.close(p) + 1
        while k < len(s) and not s.is_punct(k, "{", ";"):
            k += 1
        first = self.start(i)
        has_body = s.is_punct(k, "{")
        last = s.close(k) if has_body else min(k, len(s) - 1)
        scopes = sorted(self.scopes, key=lambda x: x.first)
        around = enclosing(scopes, i, ("class",))
        static = any(self.word(j) == "static" for j in range(first, i))
        is_method = enclosing(scopes, i, ("class", "type")) is not None
        kind = ("constructor" if s.text(name) == "__construct" else "static" if static else None) if is_method else None
        self.scopes.append(Scope("method" if is_method else "function", s.text(name), first, last, s.line(first)))
        record = function_record(
            s.text(name), s.line(first), s.end_line(last), self.params(p), self.kept(s.between(first, last)), s.docstring(first),
            complexity(s, k, last, _branches) if has_body else 1, kind=kind, class_context=around.name if around else None,
            decorators=self.decorators(first),
        )
        self.functions.append((1 if is_method else 0, first, record))

    def use(self, i: int) -> None:
        s = self.s
        if enclosing(sorted(self.scopes, key=lambda x: x.first), i, ("class", "type")):
            return  # a trait
        k, end = i + 1, i + 1
        while end < len(s) and not s.is_punct(end, ";"):
            end += 1
        self.headers.update(range(i, end))
        k += self.word(k) in ("function", "const")
        group = ""
        if (brace := next((j for j in range(k, end) if s.is_punct(j, "{")), None)) is not None:
            group = s.between(k, brace - 1).rstrip("\\") + "\\"
            spans = s.parts(brace, s.close(brace))
        else:
            spans = s.parts(k - 1, end)
        for a, b in spans:
            source = group + s.text(a).lstrip("\\")
            short = source.rpartition("\\")[2]
            renamed = self.word(a + 1) == "as" and b >= a + 2
            self.out["imports"].append(import_record(s.text(a + 2) if renamed else short, source, s.line(i), short if renamed else None))

    def find_calls(self) -> None:
        s = self.s
        for i, t in enumerate(s.tokens):
            if i in self.headers or t.kind not in ("name", "variable"):
                continue
            word = self.word(i)
            if word == "new" and s.kind(i + 1) in ("name", "variable") and self.word(i + 1) != "class":
                name = s.text(i + 1).lstrip("\\")
                self.called(name, i, i + 2, f"new {name}", None)
                continue
            if not s.is_punct(i + 1, "("):
                continue
            if s.is_punct(i - 1, "->", "?->", "::"):
                first = self.chain_start(i)
                if self.word(first - 1) == "new":
                    continue
                full = s.between(first, i).split("(")[0]
                self.called(t.text, first, i + 1, full, s.between(first, i - 2))
            elif t.kind == "name" and word not in _NOT_CALLED and self.word(i - 1) not in ("function", "new"):
                name = t.text.lstrip("\\")
                self.called(name, i, i + 1, name, None)

    def chain_start(self, k: int) -> int:
        s = self.s
        while s.is_punct(k - 1, "->", "?->", "::"):
            k -= 2
            while s.is_punct(k, ")", "]", "}") and k in s.partner:
                k = s.partner[k] - 1
        return max(k, 0)

    def called(self, name: str, first: int, p: int, full: str, obj: str | None) -> None:
        s = self.s
        args = [s.between(a, b)[:MAX_ARG] for a, b in s.parts(p, s.close(p))] if s.is_punct(p, "(") else []
        self.out["calls"].append(call_record(name, s.line(first), args, full, obj, enclosing(self.scopes, first, FUNCTIONS)))

    def read(self) -> dict:
        self.find_definitions()
        self.scopes.sort(key=lambda x: x.first)
        for is_method, first, record in sorted(self.functions, key=lambda x: x[:2]):
            outer = None if is_method else enclosing(self.scopes, first, FUNCTIONS)
            record["context"] = outer.name if outer else None
            self.out["functions"].append(record)
        for at, record in self.variables:
            around = enclosing(self.scopes, at, ("class",))
            record["class_context"] = around.name if around else None
            self.out["variables"].append(record)
        self.find_calls()
        return self.out


def parse(path: str, source: str, is_dependency: bool = False) -> dict:
    return _File(path, source, is_dependency).read()
