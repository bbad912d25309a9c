"""JavaScript and TypeScript."""

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
    r"""(?:(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
      |(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*|\#[A-Za-z_$][\w$]*)
      |(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
      |(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)
      |(?P<punct>\?\?=|\?\.(?!\d)|\?\?|=>|\.\.\.|>>>=?|>>=?|<<=?|===?|!==?|&&=?|\|\|=?|\*\*=?|\+\+|--|[-+*/%&|^<>]=|[-+*/%&|^~!<>=?:;,.(){}\[\]@\#\\])
      |(?P<other>.))\s*""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
#: Words after which a slash opens a regular expression and an expression may follow.
_BEFORE_VALUE = frozenset(("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await", "default"))
_NOT_CALLED = frozenset(
    ("if", "for", "while", "switch", "catch", "with", "return", "typeof", "function", "super", "import", "await", "yield", "delete", "void", "in", "of",
     "instanceof", "new", "throw", "case", "else", "do", "async", "constructor", "class", "extends")
)
_MODIFIERS = frozenset(("static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "declare", "accessor"))
_BRANCH = frozenset(("if", "else", "for", "while", "do", "case", "catch"))
_LOGIC = frozenset(("&&", "||", "??"))
FUNCTIONS = ("function", "method", "arrow")


def tokenize(source: str) -> Stream:
    tokens: list[Token] = []
    comments: list[tuple[int, int]] = []
    i, n = 0, len(source)
    while i < n:
        at = i
        for m in _LEX.finditer(source, at):  # up to a template or a regular expression; space goes with what is before it
            kind = m.lastgroup
            i = m.end()
            if kind == "name" or kind == "number" or kind == "string":
                tokens.append(Token(kind, m[kind], m.start(), m.end(kind)))
            elif kind == "punct":
                text, at = m[kind], m.start()
                if text[0] == "/" and _value_expected(tokens):
                    r = _REGEX.match(source, at)
                    if r:
                        i = r.end()
                        tokens.append(Token("regex", r[0], at, i))
                        break
                tokens.append(Token(kind, text, at, at + len(text)))
            elif kind == "comment":
                comments.append(m.span(kind))
            elif kind == "other" and m[kind] == "`":
                at = m.start()
                i = _template_end(source, at)
                tokens.append(Token("template", source[at:i], at, i))
                _inside(source, at, i, tokens)
                break
    return Stream(source, tokens, comments)


def _value_expected(tokens: list[Token]) -> bool:
    if not tokens:
        return True
    t = tokens[-1]
    if t.kind == "punct":
        return t.text not in (")", "]", "}", "++", "--")
    return t.kind == "name" and t.text in _BEFORE_VALUE


def _template_end(source: str, i: int) -> int:
    k, n = i + 1, len(source)
    while k < n:
        if source[k] == "\\":
            k += 2
        elif source[k] == "`":
            return k + 1
        elif source.startswith("${", k):
            depth, k = 1, k + 2
            while k < n and depth:
                if source[k] == "`":
                    k = _template_end(source, k) - 1
                elif source[k] in "{}":
                    depth += 1 if source[k] == "{" else -1
                k += 1
        else:
            k += 1
    return n


def _inside(source: str, start: int, end: int, tokens: list[Token]) -> None:
    """Tokens of the expressions inside a template, so that their calls are seen; each in brackets of its own."""
    k = start + 1
    while k < end:
        if source[k] == "\\":
            k += 2
        elif source.startswith("${", k):
            depth, first, k = 1, k + 2, k + 2
            while k < end and depth:
                if source[k] == "`":
                    k = _template_end(source, k) - 1
                elif source[k] in "{}":
                    depth += 1 if source[k] == "{" else -1
                k += 1
            tokens.append(Token("punct", "{", first - 1, first))
            for t in tokenize(source[first : k - 1]).tokens:
                tokens.append(Token(t.kind, t.text, t.start + first, t.end + first))
            tokens.append(Token("punct", "}", k - 1, k))
        else:
            k += 1
    if tokens[-1].kind != "template":  # what follows comes after the whole template
        tokens.append(Token("template", "", end, end))


def _branches(s: Stream, i: int) -> int:
    t = s.tokens[i]
    if t.kind == "punct":
        if t.text in _LOGIC:
            return 1
        if t.text != "?":
            return 0
        # a lone question mark is a conditional unless it marks something optional
        return int(not s.is_punct(i + 1, ":", ")", ",", "(", ";", "]", "="))
    if t.kind != "name" or t.text not in _BRANCH or s.is_punct(i - 1, ".", "?.") or s.is_punct(i + 1, ":", ","):
        return 0
    if t.text == "while" and s.is_punct(i - 1, "}") and s.text(s.partner.get(i - 1, -1) - 1) == "do":
        return 0  # the end of a do loop
    return 1


class _File:
    def __init__(self, path: str, source: str, lang: str, is_dependency: bool) -> None:
        self.s = tokenize(source)
        self.out = file_record(path, lang)
        self.ts = lang == "typescript"
        self.dependency = is_dependency
        self.scopes: list[Scope] = []
        self.headers: set[int] = set()  # names that are defined, not called
        self.bodies: list[tuple[str, dict, int, int]] = []
        self.values: dict[int, int] = {}  # declarators that hold a function or class

    def kept(self, text: str) -> str | None:
        return None if self.dependency else text

    # -- statements ------------------------------------------------------------------------------

    def statement_start(self, i: int) -> int:
        """Where the statement of a declaration begins: at its export, declare, abstract, async or default."""
        while self.s.kind(i - 1) == "name" and self.s.text(i - 1) in ("export", "default", "declare", "async", "abstract"):
            i -= 1
        return i

    def body_of(self, close: int) -> int | None:
        """The brace that opens the body after a parameter list that ends at ``close``, over a return type."""
        s, k = self.s, close + 1
        if s.is_punct(k, "{"):
            return k
        if not s.is_punct(k, ":"):
            return None
        k += 1
        while k < len(s):
            if s.is_punct(k, "{"):
                after = s.close(k) + 1
                # an object type is followed by more of the type or by the body
                if s.is_punct(k - 1, ":", "|", "&", "=>", "<", ",") and (s.is_punct(after, "{", "|", "&", "[", "=>") or s.is_punct(k - 1, "|", "&", "<", ",")):
                    k = after
                    continue
                return k
            if s.is_punct(k, "(", "["):
                k = s.close(k)
            elif s.is_punct(k, ";", "}", ")", ",", "="):
                return None
            k += 1
        return None

    def arrow_of(self, i: int) -> tuple[int, int, int, int] | None:
        """(parameters' first, last, body's first, last) of an arrow function that starts at i (after async)."""
        s = self.s
        if s.is_punct(i, "<"):
            i = s.angle_end(i) + 1
        if s.is_punct(i, "("):
            close = k = s.close(i)
            if s.is_punct(k + 1, ":"):  # a return type
                k += 1
                while k + 1 < len(s) and not s.is_punct(k + 1, "=>", ";"):
                    k += 1
                    if s.is_punct(k, "(", "[", "{"):
                        k = s.close(k)
        elif s.kind(i) == "name":
            close = k = i
        else:
            return None
        if not s.is_punct(k + 1, "=>"):
            return None
        if s.is_punct(k + 2, "{"):
            return i, close, k + 2, s.close(k + 2)
        return i, close, k + 2, self.expression_end(k + 2)

    def expression_end(self, i: int) -> int:
        """The last token of the expression that starts at i: up to a comma, semicolon or closing bracket, or the end of a
        line after which a new statement begins."""
        s, k = self.s, i
        while k < len(s):
            if s.is_punct(k, "(", "[", "{"):
                k = s.close(k)
            elif s.is_punct(k, ")", "]", "}", ",", ";"):
                return k - 1
            elif k > i and self.new_line(k) and self.ends_value(k - 1) and self.begins_statement(k):
                return k - 1
            k += 1
        return len(s) - 1

    def new_line(self, k: int) -> bool:
        return "\n" in self.s.source[self.s.tokens[k - 1].end : self.s.tokens[k].start]

    def ends_value(self, k: int) -> bool:
        s = self.s
        return s.kind(k) in ("number", "string", "template", "regex") or s.is_punct(k, ")", "]", "}", "++", "--") or (s.kind(k) == "name" and s.text(k) not in _BEFORE_VALUE)

    def begins_statement(self, k: int) -> bool:
        return self.s.kind(k) in ("name", "number", "string") and self.s.text(k) not in ("instanceof", "in", "of", "as", "satisfies") or self.s.is_punct(k, "@", "{")

    # -- parameters ------------------------------------------------------------------------------

    def params(self, first: int, last: int) -> list[str]:
        s = self.s
        if not s.is_punct(first, "("):
            return [s.text(first)]
        names = []
        for a, b in s.parts(first, last, angle=self.ts):
            while s.is_punct(a, "@"):
                a += 2
                a = s.close(a) + 1 if s.is_punct(a, "(") else a
            while self.ts and s.text(a) in ("public", "private", "protected", "readonly", "override") and a < b:
                a += 1
            rest = "..." if s.is_punct(a, "...") else ""
            a += bool(rest)
            end = s.close(a) if s.is_punct(a, "{", "[") else a
            names.append(rest + s.between(a, end))
        return names

    # -- definitions -----------------------------------------------------------------------------

    def find_functions(self) -> None:
        s = self.s
        for i, t in enumerate(s.tokens):
            if t.kind == "name" and t.text == "function" and not s.is_punct(i - 1, "."):
                k = i + 1 + s.is_punct(i + 1, "*")
                if s.kind(k) == "name":
                    self.headers.add(k)
                    if self.is_statement(i):
                        self.declared(i, k)
            elif t.kind == "name" and t.text in ("const", "let", "var") and not s.is_punct(i - 1, ".") and s.kind(i + 1) in ("name", "punct"):
                self.declarators(i)
            elif t.kind == "name" and t.text == "class" and not s.is_punct(i - 1, ".") and not s.is_punct(i + 1, ":", "=", ",", ")"):
                self.found_class(i)
            elif self.ts and t.kind == "name" and t.text == "interface" and s.kind(i + 1) == "name" and self.is_statement(i):
                self.found_interface(i)
            elif self.ts and t.kind == "name" and t.text == "type" and s.kind(i + 1) == "name" and self.is_statement(i):
                self.found_alias(i)

    def is_statement(self, i: int) -> bool:
        i = self.statement_start(i)
        s = self.s
        if i == 0 or s.is_punct(i - 1, ";", "}", "{") or s.text(i - 1) in ("else", "do"):
            return True
        if s.is_punct(i - 1, ")"):
            return s.text(s.partner.get(i - 1, 0) - 1) in ("if", "for", "while") or self.new_line(i)
        return s.is_punct(i - 1, ":") and s.text(i - 3) == "case" or (self.new_line(i) and self.ends_value(i - 1))

    def declared(self, i: int, name: int) -> None:
        s = self.s
        k = name + 1
        k = s.angle_end(k) + 1 if s.is_punct(k, "<") else k
        if not s.is_punct(k, "("):
            return
        body = self.body_of(s.close(k))
        if body is None:
            return  # an overload's signature
        first = i - (s.text(i - 1) == "async")
        last = s.close(body)
        self.scopes.append(Scope("function", s.text(name), first, last, s.line(first)))
        record = function_record(
            s.text(name), s.line(first), s.end_line(last), self.params(k, s.close(k)), self.kept(s.between(first, last)),
            s.docstring(self.statement_start(i)), complexity(s, body, last, _branches), is_async=first != i,
        )
        self.bodies.append(("1", record, first, first))

    def declarators(self, i: int) -> None:
        """const, let or var at i: its declarators up to the end of the statement."""
        s, k, kind = self.s, i + 1, self.s.text(i)
        if s.text(k) == "enum":
            return
        start = self.statement_start(i)
        found, last = [], i
        while k < len(s):
            if s.is_punct(k, "{", "["):
                end = s.close(k)
            elif s.kind(k) == "name":
                end = k
            else:
                break
            name, at = s.between(k, end), k
            k = end + 1
            k += s.is_punct(k, "!")
            if s.is_punct(k, ":"):
                k += 1
                while k < len(s) and not s.is_punct(k, "=", ",", ";", ")", "}") and not (self.new_line(k) and self.ends_value(k - 1) and self.begins_statement(k)):
                    k = s.close(k) + 1 if s.is_punct(k, "(", "[", "{") else s.angle_end(k) + 1 if s.is_punct(k, "<") else k + 1
            value = None
            if s.is_punct(k, "="):
                value = (k + 1, self.expression_end(k + 1))
                k = value[1] + 1
            elif s.text(k) in ("of", "in"):
                return  # the variable of a loop is not declared by a declarator
            found.append((name, at, value))
            last = k - 1
            if not s.is_punct(k, ","):
                break
            k += 1
        stop = last + 1 if s.is_punct(last + 1, ";") else last
        for name, at, value in found:
            self.declarator(name, at, value, kind, start, stop)

    def declarator(self, name: str, at: int, value: tuple[int, int] | None, kind: str, start: int, stop: int) -> None:
        s = self.s
        if value:
            first, last = value
            is_async = s.text(first) == "async" and not s.is_punct(first + 1, ".", "(") or (s.text(first) == "async" and self.arrow_of(first + 1) is not None)
            k = first + is_async
            span = None
            if s.text(k) == "function":
                p = k + 1 + s.is_punct(k + 1, "*")
                p += s.kind(p) == "name"
                p = s.angle_end(p) + 1 if s.is_punct(p, "<") else p
                body = self.body_of(s.close(p)) if s.is_punct(p, "(") else None
                if body is not None and s.close(body) == last:
                    span, shape = (p, s.close(p), body, last), "expression"
            elif (arrow := self.arrow_of(k)) and arrow[3] == last:
                span, shape = arrow, "arrow"
            if span:
                self.scopes.append(Scope(shape, name, at, last, s.line(at)))
                record = function_record(
                    name, s.line(at), s.end_line(last), self.params(span[0], span[1]), self.kept(s.between(start, stop)), s.docstring(start),
                    complexity(s, span[2], span[3], _branches), is_async=is_async,
                )
                self.bodies.append(("2", record, at, at))
                return
            if s.text(first) == "class":
                self.values[first] = at
                return
            if s.text(first) == "require" and s.is_punct(first + 1, "(") and s.kind(first + 2) == "string":
                self.out["imports"].append(import_record(name, s.text(first + 2).strip("\"'"), s.line(at)))
                self.values[first] = at
        if not self.dependency:
            self.bodies.append(("v", variable_record(name, s.line(at), s.between(*value) if value else None, kind, None, None), at, at))

    def found_class(self, i: int) -> None:
        s = self.s
        abstract = s.text(i - 1) == "abstract"
        named = s.kind(i + 1) == "name" and s.text(i + 1) not in ("extends", "implements")
        k = i + 1 + named
        k = s.angle_end(k) + 1 if s.is_punct(k, "<") else k
        bases: list[str] = []
        implements: list[str] = []
        into = None
        while k < len(s) and not (s.is_punct(k, "{") and not (into is not None and s.is_punct(k - 1, "extends"))):
            word = s.text(k)
            if s.kind(k) == "name" and word in ("extends", "implements"):
                into = bases if word == "extends" else implements
            elif s.kind(k) == "name" and into is not None and not s.is_punct(k - 1, ".") and not s.is_punct(k + 1, ".", "("):
                into.append(word)
            elif s.is_punct(k, "<"):
                k = s.angle_end(k)
            elif s.is_punct(k, "("):
                k = s.close(k)
            elif s.is_punct(k, ";", ")"):
                return
            k += 1
        if k >= len(s):
            return
        body, last = k, s.close(k)
        declared = named and self.is_statement(i)
        at = self.values.get(i)
        name = s.text(i + 1) if declared else s.text(at) if at is not None else s.text(i + 1) if named else ""
        first = i - abstract if at is None else at
        self.scopes.append(Scope("class", name or "", first, last, s.line(first)))
        if declared or at is not None:
            start = self.statement_start(i) if at is None else self.statement_start(at - 1)
            self.out["classes"].append(
                class_record(name, s.line(first), s.end_line(last), bases, implements, self.kept(s.between(first, last)), s.docstring(start), is_abstract=abstract)
            )
        self.members(body, last)

    def found_interface(self, i: int) -> None:
        s = self.s
        k, bases = i + 2, []
        while k < len(s) and not s.is_punct(k, "{"):
            if s.is_punct(k, "<"):
                k = s.angle_end(k)
            elif s.kind(k) == "name" and s.text(k) != "extends" and not s.is_punct(k + 1, "."):
                bases.append(s.text(k))
            k += 1
        if k < len(s):
            last = s.close(k)
            self.headers.update(range(k, last))
            record = class_record(s.text(i + 1), s.line(i), s.end_line(last), bases, [], self.kept(s.between(i, last)), s.docstring(self.statement_start(i)), is_interface=True)
            self.out["classes"].append(record)

    def found_alias(self, i: int) -> None:
        s, k = self.s, i + 2
        k = s.angle_end(k) + 1 if s.is_punct(k, "<") else k
        if s.is_punct(k, "="):
            last = self.expression_end(k + 1)
            self.headers.update(range(k, last + 1))
            self.bodies.append(("v", variable_record(s.text(i + 1), s.line(i), s.between(k + 1, last), "type", None, None), i, i))

    def members(self, body: int, last: int) -> None:
        """Methods of a class body."""
        s, k = self.s, body + 1
        while k < last:
            k = self.member(k, last) + 1

    def member(self, k: int, last: int) -> int:
        """Read the class member that starts at k; return its last token."""
        s, first, decorators = self.s, k, []
        while s.is_punct(k, "@"):
            end = k + 1
            while s.is_punct(end + 1, "."):
                end += 2
            end = s.close(end + 1) if s.is_punct(end + 1, "(") else end
            decorators.append(s.between(k, end))
            k = first = end + 1
        words = []
        while s.kind(k) == "name" and s.text(k) in _MODIFIERS and not s.is_punct(k + 1, "(", "=", ";", ":", "}", "?", "!", "<"):
            words.append(s.text(k))
            k += 1
        star = s.is_punct(k, "*")
        k += star
        if s.is_punct(k, "["):
            name_end = s.close(k)
        elif s.kind(k) in ("name", "string", "number"):
            name_end = k
        else:
            return s.close(k) if s.is_punct(k, "{", "(") else k
        p = name_end + 1
        p += s.is_punct(p, "?", "!")
        p = s.angle_end(p) + 1 if s.is_punct(p, "<") else p
        if s.is_punct(p, "("):
            self.headers.add(k)
            body = self.body_of(s.close(p))
            if body is not None and body < last:
                self.method(first, k, name_end, p, body, words, decorators)
                return s.close(body)
            p = s.close(p) + 1
        while p < last and not s.is_punct(p, ";"):  # a field or a signature
            if s.is_punct(p, "(", "[", "{"):
                p = s.close(p)
                if s.is_punct(p, "}") and self.new_line(p + 1) and (s.is_punct(p + 1, "@", "[", "*") or s.kind(p + 1) == "name"):
                    return p
            elif p > name_end + 1 and self.new_line(p) and self.ends_value(p - 1) and (self.begins_statement(p) or s.is_punct(p, "[", "*")):
                return p - 1
            p += 1
        return p

    def method(self, first: int, name: int, name_end: int, p: int, body: int, words: list[str], decorators: list[str]) -> None:
        s, last = self.s, self.s.close(body)
        text = s.between(name, name_end)
        kind = "constructor" if text == "constructor" else "getter" if "get" in words else "setter" if "set" in words else "static" if "static" in words else None
        self.scopes.append(Scope("method", text, first, last, s.line(first)))
        record = function_record(
            text, s.line(first), s.end_line(last), self.params(p, s.close(p)), self.kept(s.between(first, last)), s.docstring(first),
            complexity(s, body, last, _branches), is_async="async" in words, kind=kind, decorators=decorators,
        )
        self.bodies.append(("3", record, first, first))

    def object_methods(self) -> None:
        """Methods written in object literals."""
        s = self.s
        known = {x.first for x in self.scopes}
        for i, t in enumerate(s.tokens):
            if t.kind != "name" or not i or i in self.headers or not s.is_punct(i + 1, "(") or s.text(i) in _NOT_CALLED - {"async", "constructor", "of", "in", "delete"}:
                continue
            k = i
            while s.kind(k - 1) == "name" and s.text(k - 1) in ("async", "get", "set"):
                k -= 1
            body = s.close(i + 1) + 1
            if s.is_punct(k - 1, "{", ",") and s.is_punct(body, "{") and k not in known:
                self.headers.add(i)
                self.method(k, i, i, i + 1, body, [s.text(j) for j in range(k, i)], [])

    # -- imports and calls -----------------------------------------------------------------------

    def find_imports(self) -> None:
        s = self.s
        for i, t in enumerate(s.tokens):
            if t.kind == "name" and t.text == "import" and not s.is_punct(i + 1, "(", ".") and not s.is_punct(i - 1, "."):
                self.imported(i)
            elif t.kind == "name" and t.text == "require" and s.is_punct(i + 1, "(") and s.kind(i + 2) == "string" and i not in self.values and not s.is_punct(i - 1, "."):
                module = s.text(i + 2).strip("\"'")
                self.out["imports"].append(import_record(module, module, s.line(i)))

    def imported(self, i: int) -> None:
        s, k, found = self.s, i + 1, []
        k += s.text(k) == "type" and (s.kind(k + 1) == "name" and s.text(k + 1) != "from" or s.is_punct(k + 1, "{", "*"))
        while k < len(s) and s.text(k) != "from" and s.kind(k) != "string":
            if s.is_punct(k, "{"):
                for a, b in s.parts(k, s.close(k)):
                    a += s.text(a) == "type" and b > a and s.text(a + 1) != "as"
                    found.append((s.text(b), s.text(a) if b > a else None, False, False))
                k = s.close(k)
            elif s.is_punct(k, "*"):
                found.append((s.text(k + 2), None, False, True))
                k += 2
            elif s.kind(k) == "name":
                found.append((s.text(k), None, True, False))
            elif not s.is_punct(k, ","):
                return
            k += 1
        k += s.text(k) == "from"
        if s.kind(k) == "string":
            for name, alias, default, namespace in found:
                self.out["imports"].append(import_record(name, s.text(k).strip("\"'"), s.line(i), alias, default, namespace))

    def chain_start(self, k: int) -> int:
        """First token of the member chain that ends with the name at k."""
        s = self.s
        while s.is_punct(k - 1, ".", "?."):
            k -= 2
            while s.is_punct(k, ")", "]") and k in s.partner:
                k = s.partner[k] - 1
            if s.is_punct(k, ">"):
                return k + 1
        return k

    def find_calls(self) -> None:
        s = self.s
        for i, t in enumerate(s.tokens):
            if t.kind != "name" or i in self.headers or s.text(i - 1) == "function":
                continue
            if t.text == "new" and not s.is_punct(i - 1, ".") and s.kind(i + 1) == "name":
                k = i + 1
                while s.is_punct(k + 1, "."):
                    k += 2
                name = s.between(i + 1, k)
                p = s.angle_end(k + 1) + 1 if s.is_punct(k + 1, "<") else k + 1
                self.called(name, i, p, f"new {name}", None)
                continue
            p = i + 1
            p += s.is_punct(p, "?.") and s.is_punct(p + 1, "(")
            if self.ts and s.is_punct(p, "<"):
                p = s.angle_end(p) + 1 if s.angle_end(p) != p else p
            if not s.is_punct(p, "(") or t.text in ("require",):
                continue
            member = s.is_punct(i - 1, ".", "?.")
            if not member and t.text in _NOT_CALLED:
                continue
            first = self.chain_start(i)
            if s.text(first - 1) == "new":
                continue
            self.called(t.text, first, p, s.between(first, i), s.between(first, i - 2) if member else None)

    def called(self, name: str, first: int, p: int, full: str, obj: str | None) -> None:
        s = self.s
        args = [s.between(a, b)[:MAX_ARG] for a, b in s.parts(p, s.close(p))] if s.is_punct(p, "(") else []
        self.out["calls"].append(call_record(name, s.line(first), args, full, obj, enclosing(self.scopes, first, FUNCTIONS)))

    # ---------------------------------------------------------------------------------------------

    def read(self) -> dict:
        self.find_functions()
        self.object_methods()
        self.scopes.sort(key=lambda x: x.first)
        for order, record, at, _ in sorted(self.bodies, key=lambda x: (x[0], x[2])):
            around = enclosing(self.scopes, at, ("class",))
            record["class_context"] = around.name if around else None
            if order != "3":
                outer = enclosing(self.scopes, at, FUNCTIONS)
                record["context"] = outer.name if outer else None
            self.out["variables" if order == "v" else "functions"].append(record)
        self.find_imports()
        self.find_calls()
        self.out["imports"].sort(key=lambda x: x["line_number"])
        return self.out


def parse(path: str, source: str, lang: str, is_dependency: bool = False) -> dict:
    return _File(path, source, lang, is_dependency).read()
