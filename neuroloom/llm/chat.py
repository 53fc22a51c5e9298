"""Chat formatting by schema fingerprints.

A record's nested field paths, sorted and hashed, are its fingerprint.  The fingerprint selects a
declarative mapping, which turns the layout into canonical turns (conversation, order, role,
text).  Turns are then written by a template that escapes its own control strings.

Template of a turn:  ``### <role>: <text></turn>\\n``.  In a text, ``\\`` becomes ``\\\\``, and a
backslash is put before ``###`` and ``</turn>``; in a role also before ``:``.  Removing the
backslash of each escaped pair restores the text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, read, staged

OPEN, SEP, CLOSE = "### ", ": ", "</turn>"

#: Layouts: required field paths -> how turns are read.  A turn list names its array and the paths of
#: role and text in it; a field list names each turn's role and the fields its text is joined from.
LAYOUTS = {
    "rows": {"paths": ("conv_id", "turn", "role", "text"), "rows": ("conv_id", "turn", "role", "text")},
    "messages": {"paths": ("messages[].role", "messages[].content"), "list": ("messages", "role", "content")},
    "from_value": {"paths": ("conversations[].from", "conversations[].value"), "list": ("conversations", "from", "value")},
    "instruction": {"paths": ("instruction", "input", "output"), "fields": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    "instruction_short": {"paths": ("instruction", "output"), "fields": (("user", ("instruction",)), ("assistant", ("output",)))},
    "prompt": {"paths": ("prompt", "completion"), "fields": (("user", ("prompt",)), ("assistant", ("completion",)))},
    "prompt_response": {"paths": ("prompt", "response"), "fields": (("user", ("prompt",)), ("assistant", ("response",)))},
    "system_prompt": {"paths": ("system", "prompt", "response"), "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "prompter": "user"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


BY_PRINT = {fingerprint(m["paths"]): m for m in LAYOUTS.values()}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return [at]


def value_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, at + "[]")} or {at + "[]"}
    return {at}


def mapping_for(paths) -> dict | None:
    """The mapping of this fingerprint; with further fields present, the fingerprint of the largest known subset."""
    paths = set(paths)
    exact = BY_PRINT.get(fingerprint(paths))
    return exact or max((m for m in LAYOUTS.values() if paths >= set(m["paths"])), key=lambda m: len(m["paths"]), default=None)


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table whose schema's fingerprint has a mapping; ValueError if none has."""
    paths = schema_paths(df.schema)
    m = mapping_for(paths) or mapping_for(p for p in paths if p != id_col)
    if m is None:
        raise ValueError(f"no layout for fields {paths}")
    if "rows" in m:
        conv, turn, role, text = m["rows"]
        out = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    elif "list" in m:
        name, role, text = m["list"]
        out = df.select(F.col(id_col).alias("conv_id"), F.posexplode(name).alias("turn", "m")).select("conv_id", "turn", F.col(f"m.{role}").alias("role"), F.col(f"m.{text}").alias("text"))
    else:
        each = [F.struct(F.lit(i).alias("turn"), F.lit(role).alias("role"), F.concat_ws("\n", *[F.when(F.col(f) != "", F.col(f)) for f in fields]).alias("text")) for i, (role, fields) in enumerate(m["fields"])]
        out = df.select(F.col(id_col).alias("conv_id"), F.explode(F.array(*each)).alias("m")).select("conv_id", "m.turn", "m.role", "m.text")
    role = F.coalesce("role", F.lit(""))
    for a, b in () if "rows" in m else ROLES.items():
        role = F.when(F.col("role") == a, b).otherwise(role)
    return out.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def record_turns(record: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """(fingerprint, turns) of one JSON record; no mapping or broken JSON: no turns, broken JSON: no fingerprint."""
    try:
        value = json.loads(record or "")
    except ValueError:
        return None, []
    paths = value_paths(value)
    m = mapping_for(paths)
    if m is None or "rows" in m:
        return fingerprint(paths), []
    if "list" in m:
        name, role, text = m["list"]
        return fingerprint(paths), [(ROLES.get(str(t.get(role) or ""), str(t.get(role) or "")), str(t.get(text) or "")) for t in value[name]]
    return fingerprint(paths), [(role, "\n".join(str(value[f]) for f in fields if value.get(f))) for role, fields in m["fields"]]


def canonical_records(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, turn, role, text, fingerprint) of JSON records, each mapped by its own fingerprint; turn is null for unmapped ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c, r in zip(b.column("c").to_pylist(), b.column("r").to_pylist()):
                mark, turns = record_turns(r)
                rows += [(c, i, role, text, mark) for i, (role, text) in enumerate(turns)] or [(c, None, None, None, mark)]
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["conv_id", "turn", "role", "text", "fingerprint"])

    return df.select(F.col(id_col).cast("long").alias("c"), F.col(json_col).alias("r")).mapInArrow(run, "conv_id long, turn long, role string, text string, fingerprint string")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace(CLOSE, "\\" + CLOSE)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends in it."""
    head = OPEN + escape(role).replace(":", "\\:") + SEP
    body = escape(text)
    return head + body + CLOSE + "\n", len(head), len(head) + len(body)


HEAD = re.compile(r"### ((?:\\.|[^\\:])*): ", re.S)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs a formatted conversation was written from."""
    out, at = [], 0
    while at < len(formatted):
        m = HEAD.match(formatted, at)
        end = formatted.find(CLOSE, m.end())
        while (end - len(formatted[m.end() : end].rstrip("\\")) - m.end()) % 2:
            end = formatted.find(CLOSE, end + 1)
        out.append((unescape(m[1]), unescape(formatted[m.end() : end])))
        at = end + len(CLOSE) + 1
    return out


def _by_conversation(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition(parts(df), "conv_id").sortWithinPartitions("conv_id", *order)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, formatted, place, loss_start, loss_end), a row a turn; a conversation is its rows by seq laid end to end.

    ``place``: characters before the turn; the loss mask covers [loss_start, loss_end) of the
    conversation, assistant texts only (null for other turns).  Turns are ordered by turn (nulls
    first), then role and text; repeated rows are repeated turns.  Null role and text are empty;
    rows with null conv_id form one conversation.  Turns are streamed, never gathered, so a
    conversation may be of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, place = object(), 0, 0
        for b in batches:
            rows = []
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if conv != now:
                    now, seq, place = conv, 0, 0
                out, a, z = write_turn(role, text)
                loss = role == "assistant"
                rows.append((conv, seq, out, place, place + a if loss else None, place + z if loss else None))
                seq, place = seq + 1, place + len(out)
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["conv_id", "seq", "formatted", "place", "loss_start", "loss_end"])

    laid = _by_conversation(turns.select("conv_id", "turn", "role", "text"), "turn", "role", "text")
    return laid.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, seq long, formatted string, place long, loss_start long, loss_end long")


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and loss mask alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, state = None, None
        for b in batches:
            done = []
            for conv, text, place, a, z in zip(*(b.column(k).to_pylist() for k in ("conv_id", "formatted", "place", "loss_start", "loss_end"))):
                if state is None or conv != now:
                    if state:
                        done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                if a is not None:
                    loss = unescape(text[a - place : z - place])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(text)
            cols = list(zip(*done)) if done else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]), kinds)], names)

    rows = _by_conversation(formatted, "seq")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the query adds: control strings inside texts.
ADDED = r"\### Assistant: </turn> ok"


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", ADDED), (-7, 1, "assistant", ADDED)], "conv_id long, turn long, role string, text string")
    return digest(staged(format_chats(canonical_turns(table.unionByName(more))), "chats"))


_TEXT = r"""length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'))"""
OP8_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + {_TEXT} + 8) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
