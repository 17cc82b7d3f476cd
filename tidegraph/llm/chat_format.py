"""Chat formatting with schema fingerprints.

A record (any nested JSON value) is described by the set of its field paths with their kinds; a hash of them, the fingerprint, selects
a declarative mapping to canonical turns ``(role, text)``. A fingerprint met for the first time is resolved against the mappings' own paths once and kept, so
records of one layout cost a look-up each. Turns are rendered in a template whose marks are escaped inside texts, reversibly, with a loss
mask over the assistants' texts; the rendering can be parsed back.

    ### Role:
    text, with a backslash before each backslash, ### and </turn> in it
    </turn>

A conversation is a stream of records in order. It is rendered in pieces of whole turns of at most about ``piece`` characters, so that one
of any length never is in memory whole; one piece is the rule.

Defined results: null texts are empty, null roles the empty role; rows are ordered by ``turn`` (null first), then role, then text, repeated rows stay; a null conv_id
is a conversation; records of an unknown layout give no turn and are counted in ``unmapped``; a conversation without
turns is one empty piece; an empty table gives no rows; only conv_id, turn and the record are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# -- fingerprints


def paths(value, at: str = "") -> set[str]:
    """The field paths of a nested value with their kinds. Elements of a list share a path; null says nothing of its kind."""
    if isinstance(value, dict):
        return {f"{at}:object"}.union(*(paths(v, f"{at}.{k}") for k, v in value.items()))
    if isinstance(value, list):
        return {f"{at}:list"}.union(*(paths(v, f"{at}[]") for v in value))
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
    return {f"{at}:{kind}"}


def fingerprint(value) -> str:
    return hashlib.sha1("\n".join(sorted(paths(value))).encode()).hexdigest()


# -- mappings

ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns.

    ``items`` is the path of a list of turns, whose role and text are at ``role`` and ``text``; ``lead`` are (role, path) of optional
    fields beside the list, whose texts come before its turns. Without ``items``, ``fields`` are (role, path) in order; several paths joined by ``+`` make one turn, with a blank line between those that are not empty.
    """

    name: str
    items: str | None = None
    role: str = "role"
    text: str = "content"
    lead: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, str], ...] = ()
    optional: frozenset[str] = field(default_factory=frozenset)

    def needs(self) -> set[str]:
        if self.items is not None:
            return {f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"}
        return {f".{p}" for _, ps in self.fields for p in ps.split("+")} - {f".{o}" for o in self.optional}

    def turns(self, record) -> list[tuple[str, str]]:
        if self.items is not None:
            items = reach(record, self.items)
            lead = [(role, text_of(v)) for role, p in self.lead if (v := reach(record, f".{p}")) is not None]
            return lead + [(role_name(reach(x, "." + self.role)), text_of(reach(x, "." + self.text))) for x in items or []]
        out = []
        for role, ps in self.fields:
            values = [reach(record, f".{p}") for p in ps.split("+")]
            if all(v is None for v in values) and set(ps.split("+")) <= self.optional:
                continue
            texts = [text_of(v) for v in values]
            name = role_name(reach(record, role[1:])) if role.startswith("@") else role
            out.append((name, texts[0] if len(texts) == 1 else "\n\n".join(t for t in texts if t)))
        return out


def reach(record, path: str):
    for key in [k for k in path.split(".") if k]:
        record = record.get(key) if isinstance(record, dict) else None
    return record


def role_name(role) -> str:
    return "" if role is None else ROLES.get(str(role), str(role))


def text_of(value) -> str:
    """A text, or the texts of a list of parts."""
    if isinstance(value, list):
        return "".join(x if isinstance(x, str) else text_of(x.get("text")) if isinstance(x, dict) else "" for x in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


SYSTEM = (("system", "system"),)
#: In order of preference: of several mappings whose paths a record has, the first with the most paths.
MAPPINGS = (
    Mapping("messages", items=".messages", lead=SYSTEM),
    Mapping("conversation list", items=".conversation", lead=SYSTEM),
    Mapping("from/value", items=".conversations", role="from", text="value", lead=SYSTEM),
    Mapping("bare list", items=""),
    Mapping("one turn", fields=(("@.role", "text"),)),
    Mapping("one message", fields=(("@.role", "content"),)),
    Mapping("instruction", fields=(("system", "system"), ("user", "instruction+input"), ("assistant", "output")), optional=frozenset({"system", "input"})),
    Mapping("instruction/response", fields=(("system", "system"), ("user", "instruction+context"), ("assistant", "response")), optional=frozenset({"system", "context"})),
    Mapping("prompt/completion", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=frozenset({"system"})),
    Mapping("prompt/response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=frozenset({"system"})),
    Mapping("question/answer", fields=(("system", "system"), ("user", "context+question"), ("assistant", "answer")), optional=frozenset({"system", "context"})),
)


class Selector:
    """Fingerprint to mapping, resolved once for each fingerprint."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS) -> None:
        self.mappings = mappings
        self.known: dict[str, Mapping | None] = {}

    def mapping(self, record) -> Mapping | None:
        have = paths(record)
        key = hashlib.sha1("\n".join(sorted(have)).encode()).hexdigest()
        if key not in self.known:
            if len(self.known) > 10_000:  # records with keys of their own
                self.known.clear()
            bare = {p.rpartition(":")[0] for p in have}
            fit = [m for m in self.mappings if m.needs() <= bare]
            self.known[key] = max(fit, key=lambda m: len(m.needs()), default=None)
        return self.known[key]

    def turns(self, record) -> list[tuple[str, str]] | None:
        m = self.mapping(record)
        return None if m is None else m.turns(record)


# -- the template

CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>)")
TURN = re.compile(r"### ([^\n]*):\n(.*?)\n</turn>\n", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|n)", lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the loss mask in its code points."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape_role(role)}:\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "\n</turn>\n"]
        at += len(head) + len(body) + 9
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


# -- DataFrames

PIECES = "conv_id long, piece int, last boolean, formatted string, mask array<struct<start:long,end:long>>, n_turns long, unmapped long"
PIECE_TYPES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("last", pa.bool_()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_turns", pa.int64()), ("unmapped", pa.int64())])


def format_records(records: DataFrame, piece: int = 1 << 18) -> DataFrame:
    """Pieces (``PIECES``) from ``records(conv_id, ord, record)``: JSON records of any layout, rendered in the order of ``ord``, then of the record's text."""
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = records.selectExpr("cast(conv_id AS long) conv_id", "cast(ord AS long) ord", "record").repartition(n, "conv_id").sortWithinPartitions("conv_id", "ord", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        select = Selector()
        conv, number, started = None, 0, False
        turns: list[tuple[str, str]] = []
        size = unmapped = 0
        rows: list[dict] = []

        def emit(last: bool) -> None:
            nonlocal turns, size, unmapped, number
            formatted, mask = render(turns)
            rows.append({"conv_id": conv, "piece": number, "last": last, "formatted": formatted, "mask": [{"start": a, "end": b} for a, b in mask], "n_turns": len(turns), "unmapped": unmapped})
            turns, size, unmapped, number = [], 0, 0, number + 1

        for b in batches:
            for own, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if started and own != conv:
                    emit(True)
                    number = 0
                elif started and size > piece:
                    emit(False)
                conv, started = own, True
                try:
                    found = select.turns(json.loads(record)) if record is not None else None
                except ValueError:
                    found = None
                if found is None:
                    unmapped += 1
                else:
                    turns += found
                    size += sum(len(t) for _, t in found)
            if len(rows) >= 500:
                yield pa.RecordBatch.from_pylist(rows, schema=PIECE_TYPES)
                rows.clear()
        if started:
            emit(True)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=PIECE_TYPES)

    return r.select("conv_id", "record").mapInArrow(run, PIECES)


def turn_records(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as records: a JSON object for each row."""
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    return conversations.select("conv_id", F.col("turn").alias("ord"), record.alias("record"))


class Digest:
    """Columns of a conversation from its pieces, read one after another."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, mask: list[dict]) -> None:
        for role, text in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in mask:
            text = unescape(formatted[span["start"] : span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self, conv) -> dict:
        return {"conv_id": conv, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST_TYPES = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(pieces: DataFrame) -> DataFrame:
    """A row a conversation, parsed back from ``pieces``. Those of one piece are digested where they are read, longer ones in order of their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, d = None, None
        for b in batches:
            rows = []
            for conv, number, formatted, mask in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if number == 0:
                    if d:
                        rows.append(d.row(now))
                    now, d = conv, Digest()
                d.add(formatted, mask)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=DIGEST_TYPES)
        if d:
            yield pa.RecordBatch.from_pylist([d.row(now)], schema=DIGEST_TYPES)

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = pieces.select("conv_id", "piece", "formatted", "mask", "last")
    single = p.where("piece = 0 AND last").drop("last").mapInArrow(run, DIGESTS)
    longer = p.where("piece > 0 OR NOT last").drop("last").repartition(n, "conv_id").sortWithinPartitions("conv_id", "piece")
    return single.unionByName(longer.mapInArrow(run, DIGESTS))


def write_formatted(records: DataFrame, path: str, piece: int = 1 << 18) -> DataFrame:
    """Render ``records`` into a Parquet table at ``path`` and return it as read back."""
    with common.batch_rows(records.sparkSession, common.BATCH):
        format_records(records, piece).write.mode("errorifexists").parquet(path)
    return records.sparkSession.read.schema(PIECES).parquet(path)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return digests(write_formatted(turn_records(rows.unionByName(more)), common.work_path(spark, "chats")))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '###', ''))) // 3 + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS escaped FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(role) + escaped) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
