"""Per-file parsers: source text to symbol records.

``parse(path, source)`` picks the parser by extension and returns a record in the shape of ``schema.PARSED_FILE``, or None
for a file of another kind.  The parsers read a token stream with matched brackets; they build no syntax tree.
"""

from __future__ import annotations

from repolens.functions.parsers import ecma, php

EXTENSIONS = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".php": "php",
}


def language_of(path: str) -> str | None:
    name = path.rpartition("/")[2]
    return EXTENSIONS.get(name[name.rfind(".") :].lower()) if "." in name else None


def parse(path: str, source: str | None, is_dependency: bool = False) -> dict | None:
    lang = language_of(path)
    if lang is None:
        return None
    if lang == "php":
        return php.parse(path, source or "", is_dependency)
    return ecma.parse(path, source or "", lang, is_dependency)
