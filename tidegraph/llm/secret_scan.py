"""Secret scans with one deterministic automaton.

The rules' regexes are compiled together: Thompson's construction over bytes, subset construction, minimisation by refinement,
and then a transition array a state. One pass over a text's bytes steps through all rules at once; where a rule
accepts, the reversed rule finds the leftmost start and the rule alone the longest end, and the scan goes on.
The patterns are of a small language: literals, classes, groups, ``|``, ``? * + {m} {m,} {m,n}``.

Spans are leftmost, longest and without overlap within a kind; kinds may overlap one another. A rule's ``check`` drops a match after it was
found (and the text it covered stays used up). Offsets are code points, the end exclusive.

Defined results: null and empty texts have no spans; texts of any length are scanned whole in one pass; repeated rows give repeated results;
only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

LETTERS = frozenset(range(65, 91)) | frozenset(range(97, 123))
DIGITS = frozenset(range(48, 58))
#: The automaton is sent to every task: at most this many states of 256 two-byte entries.
MAX_STATES = 30_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # letters that the part after ``after`` has at least; a match of fewer is dropped
    after: str = ""  # the part begins after the first of these characters, spaces and a quote; "" means the whole match


#: Kinds in the order in which spans of one start are listed. The first three are fixed by contract; the rest are public formats of keys.
RULES = (
    Rule("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]+", 8, ":="),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{32,}"),
    Rule("ghtoken", "gh[pousr]_[A-Za-z0-9]+", 24),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+", 24),
)
BASE = ("assign", "access", "hex")


# -- regexes to automata


class Nfa:
    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.on: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.on.append(None)
        return len(self.eps) - 1


def parse(pattern: str):
    """The pattern as a tree: ("set", bytes), ("cat", [..]), ("alt", [..]), ("rep", tree, least, most or None)."""
    at = 0

    def peek() -> str:
        return pattern[at] if at < len(pattern) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return pattern[at - 1]

    def alt():
        options = [cat()]
        while peek() == "|":
            take()
            options.append(cat())
        return options[0] if len(options) == 1 else ("alt", options)

    def cat():
        items = []
        while peek() and peek() not in "|)":
            items.append(repeat())
        return ("cat", items)

    def repeat():
        item = atom()
        while peek() and peek() in "?*+{":
            c = take()
            if c == "{":
                text = ""
                while peek() != "}":
                    text += take()
                take()
                lo, comma, hi = text.partition(",")
                least, most = int(lo), int(hi) if hi else None if comma else int(lo)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            item = ("rep", item, least, most)
        return item

    def atom():
        c = take()
        if c == "(":
            tree = alt()
            take()
            return tree
        if c == "[":
            return ("set", klass())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        if c == "\\":
            return ("set", escaped(take()))
        return ("cat", [("set", frozenset([b])) for b in c.encode()])

    def escaped(c: str) -> frozenset[int]:
        return {"d": DIGITS, "w": LETTERS | DIGITS | {95}, "s": frozenset(b" \t\n\r\f\v")}.get(c, frozenset(c.encode()))

    def klass() -> frozenset[int]:
        negated, found, first = False, set(), True
        if peek() == "^":
            take()
            negated = True
        while first or peek() != "]":
            first = False
            c = take()
            if c == "\\":
                found |= escaped(take())
            elif peek() == "-" and at + 1 < len(pattern) and pattern[at + 1] != "]":
                take()
                found |= set(range(ord(c), ord(take()) + 1))
            else:
                found.add(ord(c))
        take()
        return frozenset(range(256)) - found if negated else frozenset(found)

    tree = alt()
    if at != len(pattern):
        raise ValueError(f"unbalanced pattern {pattern!r}")
    return tree


def reverse(tree):
    if tree[0] == "cat":
        return ("cat", [reverse(t) for t in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [reverse(t) for t in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


def thompson(nfa: Nfa, tree, start: int) -> int:
    """Add ``tree`` after ``start``; the state at its end."""
    kind = tree[0]
    if kind == "set":
        a, b = nfa.state(), nfa.state()
        nfa.eps[start].append(a)
        nfa.on[a] = (tree[1], b)
        return b
    if kind == "cat":
        for t in tree[1]:
            start = thompson(nfa, t, start)
        return start
    if kind == "alt":
        end = nfa.state()
        for t in tree[1]:
            s = nfa.state()
            nfa.eps[start].append(s)
            nfa.eps[thompson(nfa, t, s)].append(end)
        return end
    _, inner, least, most = tree
    for _ in range(least):
        start = thompson(nfa, inner, start)
    if most is None:
        loop, end = nfa.state(), nfa.state()
        nfa.eps[start] += [loop]
        nfa.eps[thompson(nfa, inner, loop)].append(loop)
        nfa.eps[loop].append(end)
        return end
    end = nfa.state()
    nfa.eps[start].append(end)
    for _ in range(most - least):
        start = thompson(nfa, inner, start)
        nfa.eps[start].append(end)
    return end


def classes_of(nfa: Nfa) -> np.ndarray:
    """Bytes that no transition tells apart share a class."""
    marks = [tuple(b in on[0] for on in nfa.on if on) for b in range(256)]
    ids: dict[tuple, int] = {}
    return np.array([ids.setdefault(m, len(ids)) for m in marks])


def compile_dfa(trees: list, anywhere: bool) -> tuple[np.ndarray, list[int]]:
    """Subset construction of all trees, then minimisation: ``next[state, byte]`` and the rules (bits) that each state accepts. State 0 begins.

    ``anywhere`` lets a match begin at every byte. The last state of the array is dead where there is one.
    """
    nfa = Nfa()
    root = nfa.state()
    ends = {}
    for i, tree in enumerate(trees):
        s = nfa.state()
        nfa.eps[root].append(s)
        ends[thompson(nfa, tree, s)] = 1 << i
    classes = classes_of(nfa)
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(classes.max() + 1)]

    def closure(states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.on[s] or s in ends or s == root)

    begin = closure(frozenset([root]))
    ids, order, table = {begin: 0}, [begin], []
    for states in order:
        row = []
        for b in sample:
            to = frozenset(nfa.on[s][1] for s in states if nfa.on[s] and b in nfa.on[s][0])
            to = closure(to | {root}) if anywhere else closure(to)
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
                if len(order) > MAX_STATES:
                    raise ValueError(f"the rules need more than {MAX_STATES} states")
            row.append(ids[to])
        table.append(row)
    nxt = np.array(table)
    accepts = np.array([sum({ends[s] for s in states if s in ends}) for states in order])
    block = np.unique(accepts, return_inverse=True)[1]
    while True:  # states of one block go on together until no byte parts them
        split = np.unique(np.column_stack([block, block[nxt]]), axis=0, return_inverse=True)[1].ravel()
        if split.max() == block.max():
            break
        block = split
    first = {int(b): i for i, b in reversed(list(enumerate(split)))}
    names = {b: i for i, b in enumerate(sorted(first, key=first.get))}
    small = np.array([[names[int(split[t])] for t in nxt[first[b]]] for b in names])
    return small[:, classes], [int(accepts[first[b]]) for b in names]


class Scanner:
    """Rules compiled; ``Scanner.spans(bytes)`` gives sorted (start, kind number, end) in bytes."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        trees = [parse(r.pattern) for r in rules]
        self.table, self.accepts = compile_dfa(trees, True)
        self.alone = [compile_dfa([t], False) for t in trees]
        self.back = [compile_dfa([reverse(t)], False) for t in trees]
        self.rows: list[list] | None = None

    def linked(self) -> list:
        """Rows that hold the next rows themselves, and at 256 the rules that accept: one look-up a byte."""
        if self.rows is None:
            self.rows = [[None] * 257 for _ in self.accepts]
            for row, to, acc in zip(self.rows, self.table.tolist(), self.accepts, strict=True):
                row[:256] = [self.rows[t] for t in to]
                row[256] = acc
            self.alone_lists = [(t.tolist(), a) for t, a in self.alone]
            self.back_lists = [(t.tolist(), a) for t, a in self.back]
        return self.rows

    def start(self, k: int, data: bytes, end: int, floor: int) -> int:
        """The leftmost start from ``floor`` of a match of rule ``k`` that ends at ``end``, or -1."""
        table, acc = self.back_lists[k]
        s, found, i = 0, -1, end
        while i > floor:
            i -= 1
            s = table[s][data[i]]
            if acc[s]:
                found = i
            elif s == self.dead(table, s):
                break
        return found

    def end(self, k: int, data: bytes, start: int) -> int:
        table, acc = self.alone_lists[k]
        s, found = 0, start
        for i in range(start, len(data)):
            s = table[s][data[i]]
            if acc[s]:
                found = i + 1
            elif s == self.dead(table, s):
                break
        return found

    @staticmethod
    def dead(table: list[list[int]], s: int) -> int:
        """``s`` itself if no byte leaves it, else -1."""
        return s if table[s][0] == s and all(t == s for t in table[s]) else -1

    def keeps(self, k: int, match: bytes) -> bool:
        r = self.rules[k]
        if not r.least:
            return True
        if not r.after:
            return len(match) >= r.least
        at = min(i for i in (match.find(c) for c in r.after.encode()) if i >= 0)
        value = match[at + 1 :].lstrip(b" ")
        return len(value) - (value[:1] in (b'"', b"'")) >= r.least

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        rows = self.linked()
        row, free = rows[0], [0] * len(self.rules)
        found = []
        for i, b in enumerate(data):
            row = row[b]
            if row[256]:
                hits, k = row[256], 0
                while hits:
                    if hits & 1 and i >= free[k]:
                        s = self.start(k, data, i + 1, free[k])
                        if s >= 0:
                            free[k] = e = self.end(k, data, s)
                            if self.keeps(k, data[s:e]):
                                found.append((s, k, e))
                    hits >>= 1
                    k += 1
        return sorted(found)

    def named(self, text: str) -> list[tuple[str, int, int]]:
        """Spans in code points."""
        data = text.encode()
        spans = self.spans(data)
        if len(data) == len(text):
            return [(self.rules[k].kind, s, e) for s, k, e in spans]
        out, at, chars = {}, 0, 0
        for x in sorted({x for s, _, e in spans for x in (s, e)}):
            chars += len(data[at:x].decode(errors="ignore")) if x > at else 0
            at = x
            out[x] = chars
        return [(self.rules[k].kind, out[s], out[e]) for s, k, e in spans]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, digest: Callable | None = None, schema: str = "doc_id long, spans array<struct<kind:string,start:long,end:long>>") -> DataFrame:
    """``(doc_id, spans)`` for every row of ``docs(doc_id, text)``; ``digest(spans)`` gives the columns after doc_id instead."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))  # at most MAX_STATES states

    def make():
        scanner = shared.value

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            spans = [scanner.named(t) for t in common.texts(b.column(1))]
            if digest:
                return pa.RecordBatch.from_arrays([b.column(0), *digest(spans)], names=[c.split()[0] for c in schema.split(", ")])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], kind)], names=["doc_id", "spans"])

        return f

    return common.map_rows(docs.selectExpr("cast(doc_id AS long) doc_id", "text"), make, schema)


def contract_columns(spans: list[list[tuple[str, int, int]]]) -> list[pa.Array]:
    n = [pa.array([sum(s[0] == k for s in x) for x in spans], pa.int64()) for k in BASE]
    base = [hashlib.sha256(joined([s for s in x if s[0] in BASE]).encode()).hexdigest() for x in spans]
    return [*n, pa.array(base, pa.string()), pa.array([joined(x) for x in spans], pa.string())]


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.read(spark, sf_dir, "documents"), digest=contract_columns, schema="doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return common.stored(found, "secrets")


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The contract's rows in DuckDB: matches are put between two private characters, and their places counted from the pieces between these."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"({k}, {quoted(r.kind)}, {quoted(r.pattern)}, {r.least}, {str(bool(r.after)).lower()})" for k, r in enumerate(rules))
    base = ", ".join(map(quoted, BASE))
    return rf"""
WITH r(k, kind, pattern, least, assigned) AS (VALUES {table}),
m AS (
  SELECT doc_id, k, kind, least, assigned, string_split(regexp_replace(coalesce(text, ''), pattern, chr(57344) || '\0' || chr(57345), 'g'), chr(57344)) AS parts FROM documents, r
),
p AS (SELECT doc_id, k, kind, least, assigned, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM m WHERE len(parts) > 1),
s AS (
  SELECT doc_id, k, kind, least, assigned, i, split_part(part, chr(57345), 1) AS hit,
    sum(length(replace(part, chr(57345), ''))) OVER (PARTITION BY doc_id, k ORDER BY i) - length(replace(part, chr(57345), '')) AS start
  FROM p
),
f AS (
  SELECT doc_id, k, kind, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(hit) AS BIGINT) AS span FROM s
  WHERE i > 1 AND length(CASE WHEN assigned THEN regexp_extract(hit, '^[^:=]*[:=] *["'']?(.*)$', 1) ELSE hit END) >= least
)
SELECT d.doc_id, count(span) FILTER (WHERE kind = 'assign') AS n_assign, count(span) FILTER (WHERE kind = 'access') AS n_access, count(span) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (WHERE kind IN ({base})), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, k), '') AS spans
FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""
