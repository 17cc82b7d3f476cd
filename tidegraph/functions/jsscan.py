"""A lexical scan of JavaScript and TypeScript for import() and require() calls, over bytes.

Calls are found outside strings, templates and comments. Their first argument is a literal (static), a template with interpolations
(a template call, with the text before the first one), or anything else (opaque). Regular expression literals and JSX text are not told apart from
code, and calls inside an ordinary template's interpolations are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: One token of code at a time: a comment, a string, the start of a template, a word, or any other byte.
TOKEN = re.compile(rb"(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<string>'(?:\\.|[^'\\])*(?:'|\\?\Z)|\"(?:\\.|[^\"\\])*(?:\"|\\?\Z))|(?P<template>`)|(?P<word>[A-Za-z_$\x80-\xff][A-Za-z0-9_$\x80-\xff]*)|(?P<other>.)", re.S)
SPACE = re.compile(rb"[ \t\r\n\f\v]*")
PIECE = re.compile(rb"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)


@dataclass
class Scan:
    opaque: bool = False
    calls: list[tuple[int, int, str]] = field(default_factory=list)  # start and end of the template, static prefix
    literals: list[str] = field(default_factory=list)  # arguments of static calls


def template_end(src: bytes, at: int) -> tuple[int, int | None]:
    """Of the template that opens at ``at``: the place after it, and where its first interpolation starts (None without one)."""
    first, i = None, at + 1
    while True:
        i = PIECE.match(src, i).end()
        if src[i : i + 2] == b"${":
            first = i if first is None else first
            i = interpolation_end(src, i + 2)
        elif i >= len(src) or src[i] == 0x60:
            return min(i + 1, len(src)), first
        else:  # a backslash at the very end
            i += 1


def interpolation_end(src: bytes, at: int) -> int:
    """The place after the brace that closes an interpolation; strings, templates and comments inside are passed over."""
    depth, i = 1, at
    while i < len(src):
        t = TOKEN.match(src, i)
        if t.lastgroup == "template":
            i = template_end(src, i)[0]
            continue
        if t.lastgroup == "other":
            depth += {b"{": 1, b"}": -1}.get(t[0], 0)
            if not depth:
                return t.end()
        i = t.end()
    return len(src)


def closes(src: bytes, at: int) -> bool:
    return src[SPACE.match(src, at).end() :][:1] == b")"


def scan(src: bytes) -> Scan:
    out, i = Scan(), 0
    while i < len(src):
        t = TOKEN.match(src, i)
        if t.lastgroup == "template":
            i = template_end(src, i)[0]
            continue
        i = t.end()
        if t.lastgroup != "word" or t[0] not in (b"import", b"require"):
            continue
        call = SPACE.match(src, i).end()
        if src[call : call + 1] != b"(":
            continue
        i = arg = SPACE.match(src, call + 1).end()
        quote = src[arg : arg + 1]
        if quote in (b"'", b'"'):
            i = TOKEN.match(src, arg).end()
            if closes(src, i):
                out.literals.append(src[arg + 1 : i - 1].decode(errors="replace"))
            else:
                out.opaque = True
        elif quote == b"`":
            i, first = template_end(src, arg)
            if not closes(src, i):
                out.opaque = True
            elif first is not None:
                out.calls.append((arg, i, src[arg + 1 : first].decode(errors="replace")))
            else:
                out.literals.append(src[arg + 1 : i - 1].decode(errors="replace"))
        else:
            out.opaque = True
    return out


#: Static imports and re-exports. Those of types only are left out, as they vanish when compiled.
QUOTED_IMPORT = re.compile(rb"(?:^|[;\s{}])(?:import|export)(?!\s*type\s*(?!from\b)[\w{*])\s*(?:[\w$\s{},*]*?from)?\s*(['\"])([^'\"\n]+)\1")


def code_only(src: bytes) -> bytes:
    """The source with comments and templates blanked out; strings stay, as they hold the specifiers."""
    out, i = bytearray(src), 0
    while i < len(src):
        t = TOKEN.match(src, i)
        end = template_end(src, i)[0] if t.lastgroup == "template" else t.end()
        if t.lastgroup in ("line", "block", "template"):
            out[i:end] = b" " * (end - i)
        i = end
    return bytes(out)


def static_imports(src: bytes) -> list[str]:
    """The specifiers of static imports and re-exports, in order."""
    return [m[2].decode(errors="replace") for m in QUOTED_IMPORT.finditer(code_only(src))]
