"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

``counts[i]`` is the number of tokens of the text's first ``i`` code points as the tokenizer gives them for that prefix alone, so
truncation ("how much fits in 2,048 tokens?") and budget questions are look-ups. Of byte-pair merges, the encoding of a prefix ends in
the one vocabulary entry that is a suffix of it and stands beside the last token of the shorter prefix unmerged. So a prefix needs its
suffixes' look-ups only, and words that begin alike share their prefixes.

All texts go the same way: special strings part them; what is between is brought to the normal form letter by letter, parted into words
by the classes of its letters (both tables are asked of the library, a letter at a time) and each word's steps come from the programme. Where letters
compose (marks, Hangul) or one becomes several in lower case, the programme takes a letter with its marks at once; a prefix that ends between
them is counted by going on from the state before the letter, which is then taken up again. The work is linear in the text, but for one letter with very many marks:
each mark there counts the letter anew.

The stored form is one signed byte a code point (the step of the count), or four bytes in the rare text with a larger step. The query
writes this table and reads its totals back from it.

Defined results: null and empty texts have zero tokens; special strings in a text count as the library's default has it; texts of any
length are read whole, in time linear in it; repeated rows give a row each; an empty table gives no rows; nothing else than ``doc_id`` and ``text`` is read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Of these characters, texts are their own NFC form and get their lower case letter by letter; white space is space, tab and line ends. (For the encoders.)
PLAIN = re.compile("[\t\n\r -~¡-¬®-įı-ňŊ-ž]*\\Z")
#: The library's white space, to stand in a class of characters.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
HIGH = re.compile("[\u0300-\U0010ffff]")
#: Words of more letters are not kept.
LONG = 400
#: Words and prefixes that a task keeps in each of two generations: a full one becomes the old one, from which those that recur come back.
KEPT = 300_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def plain_pieces(pattern: str, spaces: bool = True) -> re.Pattern:
    """The word pattern for plain texts, with its letter and number classes written out so that ``re`` can run it; with the white space before each word."""
    chars = [chr(c) for c in range(0x180) if PLAIN.match(chr(c))]
    out, inside = "", False
    for part in re.findall(r"\\p\{.\}|\\.|.", pattern):
        if part.startswith(r"\p"):
            letters = "".join(re.escape(c) for c in chars if regex.match(part, c))
            part = letters if inside else f"[{letters}]"
        inside = part == "[" or inside and part != "]"
        out += part
    pattern = out
    return re.compile(rf"[ \t\n\r]*(?:{pattern})|[ \t\n\r]+" if spaces else pattern)


@cache
def clusters() -> tuple[re.Pattern, re.Pattern]:
    """Patterns of a character that may join what stands before it under NFC (a mark, the second of a canonical pair, a Hangul vowel or final), and of a character with all such after it."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in map(chr, range(0x110000)):
        parts = unicodedata.decomposition(c)
        if unicodedata.combining(c):
            found.add(c)
        elif parts and parts[0] != "<":
            if " " in parts:
                found.add(chr(int(parts.split()[1], 16)))
            if unicodedata.combining(unicodedata.normalize("NFD", c)[0]):
                found.add(c)
    marks = "".join(sorted(found))  # marks are no syntax in a class of characters
    return re.compile(f"[{marks}]"), re.compile(f"[^{marks}][{marks}]*|[{marks}]+")


def composes(text: str) -> bool:
    """Whether some character may join what stands before it; none below U+0300 does."""
    return not text.isascii() and HIGH.search(text) is not None and clusters()[0].search(text) is not None


class Lower(dict):
    """The normal form of single characters, for ``str.translate``."""

    def __init__(self, normalize) -> None:
        self.normalize = normalize

    def __missing__(self, code: int) -> str:
        x = self[code] = self.normalize(chr(code))
        return x


class Kinds(dict):
    """A letter, digit, mark or space in place of a character, by what the library makes of it; ASCII stands for itself."""

    def __init__(self, split) -> None:
        self.split = split

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if code < 128:
            kind = c
        elif c.isspace() and not self.split(c):
            kind = " "
        elif len(self.split("a" + c)) == 1:
            kind = "a"
        else:
            kind = "0" if len(self.split(c + c)) == 2 else "."
        self[code] = kind
        return kind


class Run:
    """The programme's states along one word: after each letter, the last token and the count inside the word."""

    def __init__(self, counter: PrefixCounter) -> None:
        self.counter, self.letters, self.last, self.count = counter, [], [""], [0]

    def tokens(self, final: bool) -> Iterator[tuple[int, str]]:
        """Tokens that end here, with where they begin."""
        n, longest = len(self.letters), self.counter.longest
        window = "".join(self.letters[-longest:])
        vocab = self.counter.final if final else self.counter.inner
        for k in range(len(window)):
            if window[k:] in vocab:
                yield n - len(window) + k, window[k:]

    def end(self, final: bool) -> tuple[str, int]:
        for at, token in self.tokens(final):
            if not at or self.counter.unmerged(self.last[at], token, final):
                return token, self.count[at] + 1
        raise ValueError(f"no token ends {''.join(self.letters[-50:])!r}")

    def put(self, letters: str) -> None:
        for c in letters:
            self.letters.append(c)
            token, n = self.end(False)
            self.last.append(token)
            self.count.append(n)

    def cut(self, n: int) -> None:
        del self.letters[n:], self.last[n + 1 :], self.count[n + 1 :]

    def whole(self) -> int:
        return self.end(True)[1] if self.letters else 0


class PrefixCounter:
    """Counts for one word-end BPE file of the tokenizers library. ``path`` is the file's place."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.normalize = lru_cache(100_000)(self.lib.normalizer.normalize_str)
        self.lower, self.kind = Lower(self.lib.normalizer.normalize_str), Kinds(self.lib.pre_tokenizer.pre_tokenize_str)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.short = {p for p in pattern.split("|") if re.fullmatch("'[a-z]+", p)}  # words that are not a run of one kind
        self.pieces = re.compile(f" *(?:{'|'.join(sorted(self.short))}|[a-z]+|[0-9]|[^ a-z0-9]+)| +")
        self.specials = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.ranks = {(a, b): i for i, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])}
        vocab = spec["model"]["vocab"]
        self.inner = {v for v in vocab if not v.endswith(self.end)}
        self.final = {v[: -len(self.end)] for v in vocab if v.endswith(self.end)}
        self.kinds = {v: (v in self.inner) + 2 * (v in self.final) for v in self.inner | self.final}
        self.longest = max(map(len, self.kinds))
        self.ending: dict[str, int] = {}  # the longest entry that ends in three letters, or is shorter
        for v in self.kinds:
            self.ending[v[-3:]] = max(self.ending.get(v[-3:], 0), len(v))
        self.letters = byte_letters()
        self.state: dict[str, tuple[str, int, int]] = {"": ("", 0, 0)}
        self.beside: dict[tuple[str, str, bool], bool] = {}
        self.words: dict[str, bytes] = {}
        self.old_state: dict[str, tuple[str, int, int]] = {}
        self.old_words: dict[str, bytes] = {}

    # -- the dynamic programme, over words in byte letters

    def unmerged(self, left: str, right: str, final: bool) -> bool:
        """Whether the tokens ``left`` and ``right`` stay apart when their letters are encoded together."""
        key = (left, right, final)
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) > 2 * KEPT:
                self.beside.clear()
            known = self.beside[key] = self.merged(left + right, final) == [left, right + self.end * final]
        return known

    def merged(self, word: str, final: bool) -> list[str]:
        """The word's tokens by merges in rank order."""
        parts = list(word)
        if final:
            parts[-1] += self.end
        ranks, none = self.ranks, len(self.ranks)
        while len(parts) > 1:
            best, at = none, -1
            for i in range(len(parts) - 1):
                r = ranks.get((parts[i], parts[i + 1]), none)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def reach(self, prefix: str) -> tuple[str, int, int]:
        """Of ``prefix``, whose shorter prefixes are in ``state``: the last token and the count inside a word, the count as a whole word."""
        kinds, state, beside = self.kinds, self.state, self.beside
        n, last, count, whole = len(prefix), "", 0, 0
        longest = self.ending.get(prefix[-3:], 2)
        for at in range(n - longest if n > longest else 0, n):
            token = prefix[at:]
            kind = kinds.get(token)
            if kind is None:
                continue
            before, c, _ = state[prefix[:at]]
            if not count and kind & 1 and (not at or (beside[x] if (x := (before, token, False)) in beside else self.unmerged(*x))):
                last, count = token, c + 1
                if whole:
                    break
            if not whole and kind & 2 and (not at or (beside[x] if (x := (before, token, True)) in beside else self.unmerged(*x))):
                whole = c + 1
                if count:
                    break
        else:
            raise ValueError(f"no token ends {prefix!r}")
        return last, count, whole

    def word_steps(self, letters: str, ends: list[int]) -> list[int]:
        """The counts of the prefixes of ``letters`` that end at ``ends``, each encoded as a whole word."""
        state = self.state
        if len(letters) > LONG:  # states by position instead of by text: linear memory
            run, out, at = Run(self), [], 0
            for e in ends:
                run.put(letters[at:e])
                at = e
                out.append(run.whole())
            return out
        if len(state) > KEPT:
            self.old_state, self.state = state, {"": ("", 0, 0)}
            state = self.state
        old = self.old_state
        out, i = [], 1
        for e in ends:
            while i <= e:
                p = letters[:i]
                s = state.get(p)
                if s is None:
                    s = state[p] = old.get(p) or self.reach(p)
                i += 1
            out.append(s[2])
        return out

    # -- texts

    def spelt(self, text: str) -> str:
        return "".join([self.letters[b] for b in text.encode()])

    def counts_of(self, word: str) -> list[int]:
        """The counts of the prefixes of one word in normal form."""
        if word in self.short:  # 're is a word, but not the prefix 'r
            return list(self.going(list(word)))
        if word.isascii():
            return self.word_steps(self.spelt(word), range(1, len(word) + 1))
        per = [self.spelt(c) for c in word]
        return self.word_steps("".join(per), list(accumulate(map(len, per))))

    def going(self, letters: list[str]) -> Iterator[int]:
        """The counts of the prefixes of a text, each of whose ``letters`` is a character with what may compose with it, by going on from the state before."""
        done, run, n, kind, short, before = 0, None, 0, "", "", 0

        def feed(state: tuple, text: str) -> tuple:
            done, run, n, kind, short, before = state
            for c in text:
                k = self.kind[ord(c)]
                k = k if k == " " else "a" if k.isalpha() else "0" if k.isdigit() else "."
                if run is not None:
                    run.cut(n)
                if short:  # what stands since a word that begins with an apostrophe
                    short += c
                    if short in self.short:
                        done, run, n, kind, short = before + self.word_steps(self.spelt(short), [len(short)])[-1], None, 0, "", ""
                        continue
                    if not any(x.startswith(short) for x in self.short):
                        short = ""
                if k == " " or k == "0" or k != kind:
                    done, run, kind = done + (run.whole() if run is not None else 0), None, k
                    if k == " ":
                        n = 0
                        continue
                    run = Run(self)
                    if c == "'":
                        short, before = c, done
                run.put(self.spelt(c))
                n = len(run.letters)
            return done, run, n, kind, short, before

        def total(state: tuple) -> int:
            done, run, n, *_ = state
            if run is None:
                return done
            run.cut(n)
            return done + run.whole()

        state = done, run, n, kind, short, before
        for letter in letters:
            for i in range(1, len(letter)):
                yield total(feed(state, self.normalize(letter[:i])))
            state = feed(state, self.normalize(letter))
            yield total(state)

    @staticmethod
    def packed(counts: list[int]) -> bytes | np.ndarray:
        """The steps of ``counts``, as bytes if each fits in one."""
        steps = [b - a for a, b in zip([0, *counts], counts, strict=False)]
        if not steps or -128 <= min(steps) and max(steps) < 128:
            return bytes([x & 255 for x in steps])
        return np.array(steps, "<i4")

    def kept(self, key: str, counts) -> bytes | np.ndarray:
        """The steps of a word, from those kept in two generations; ``counts(key)`` gives those of a new one."""
        s = self.words.get(key)
        if s is None:
            s = self.old_words.get(key)
            if s is None:
                s = self.packed(counts(key))
                if len(key) > LONG:
                    return s
            self.words[key] = s
        return s

    def parts(self, text: str) -> list[bytes | np.ndarray]:
        """The steps of a text without special strings, in parts."""
        norm = text.translate(self.lower)
        if len(norm) == len(text) and not composes(text):
            kinds = norm if norm.isascii() else norm.translate(self.kind)
            ws = self.pieces.findall(kinds)
            if kinds is not norm:
                ends = list(accumulate(map(len, ws)))
                ws = [norm[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            words = self.words
            long = {w: s for w in set(ws).difference(words) if (s := self.kept(w, self.spaced_counts)) is not None and len(w) > LONG}
            return [long[w] if w in long else words[w] for w in ws] if long else [words[w] for w in ws]
        out = []
        for chunk in re.findall(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+", text):  # nothing composes across white space, and no word crosses it
            norm = chunk.translate(self.lower)
            if len(norm) == len(chunk) and not composes(chunk):
                out += self.parts(chunk)
            else:
                out.append(self.kept("\0" + chunk, lambda x: list(self.going(clusters()[1].findall(x[1:])))))
        return out

    def spaced_counts(self, word: str) -> list[int]:
        bare = word.lstrip(" ")
        return [0] * (len(word) - len(bare)) + (self.counts_of(bare) if bare else [])

    def steps(self, text: str) -> np.ndarray:
        """The step of the count at every code point; its running sum is the count of every prefix."""
        if len(self.words) > KEPT:
            self.old_words, self.words = self.words, {}
        parts, at = [], 0
        for special in self.specials.finditer(text):  # until it is complete, its characters are text like any other
            a, b = special.span()
            open_ = joined(self.parts(text[at : b - 1]))
            parts += [open_, np.array([1 - int(open_[a - at :].sum(dtype=np.int64))], "<i4")]
            at = b
        return joined(parts + self.parts(text[at:]))


def joined(parts: list[bytes | np.ndarray]) -> np.ndarray:
    """One array of steps, of one byte each if that holds all of them."""
    if set(map(type, parts)) <= {bytes}:
        return np.frombuffer(b"".join(parts), np.int8)
    whole = np.concatenate([np.frombuffer(p, np.int8).astype("<i4") if isinstance(p, bytes) else p.astype("<i4") for p in parts])
    return whole.astype(np.int8) if not len(whole) or abs(whole).max() < 128 else whole


@cache
def kept_counter(path: str) -> PrefixCounter:
    """One counter a worker process: its words and prefixes serve the tasks that follow."""
    return PrefixCounter(path)


def counts(steps: np.ndarray) -> np.ndarray:
    """The counts of the prefixes of 0, 1, ... code points."""
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def fits(steps: np.ndarray, budget: int) -> int:
    """The length of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts(steps) <= budget)[-1])


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_bytes, step_bytes, steps)`` for every row of ``docs(doc_id, text)``: the table of its text's prefixes."""

    def make():
        counter = kept_counter(path)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            ts = common.texts(b.column(1))
            steps = [counter.steps(t) for t in ts]
            cols = [b.column(0), pa.array([len(t.encode()) for t in ts], pa.int64()), pa.array([s.itemsize for s in steps], pa.int32()), pa.array([s.tobytes() for s in steps], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "step_bytes", "steps"])

        return f

    return common.map_rows(docs.selectExpr("cast(doc_id AS long) doc_id", "text"), make, "doc_id long, n_bytes long, step_bytes int, steps binary", rows=500)


def totals(table: DataFrame, limit: int = 2048) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of a ``prefix_table``: the count of the longest prefix is the text's."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            kinds = b.column(2).to_pylist()
            n = [int(np.frombuffer(s.as_buffer(), np.int8 if k == 1 else "<i4").sum(dtype=np.int64)) for k, s in zip(kinds, b.column(3), strict=True)]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return f

    return common.map_rows(table.select("doc_id", "n_bytes", "step_bytes", "steps"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    table = common.stored(prefix_table(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "prefix-counts")
    return common.stored(totals(table), "token-counts")
