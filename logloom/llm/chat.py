"""Chat formatting: schema fingerprints choose how a layout becomes canonical turns.

``field_paths`` lists the nested field paths of a record, ``schema_paths`` those of a table's schema; the ones that some layout knows are hashed;
``LAYOUTS`` maps the fingerprint to a declarative mapping.  Fields that no layout knows do not change it.  Where the fingerprint
is not known as fields of several layouts stand side by side, the largest layout that the fields hold is taken (of equal ones the
first), and the others are left out.  A table without a layout is an error that names the paths; a record without one, or one that
cannot be read, has no turns, a null layout and the reason in ``error``.

The template writes ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Inside texts and roles each
``<\\..\\|`` gets one more backslash, so that no control string stands there, and reading takes it off again;
in roles, backslashes and newlines are escaped as well.  The loss mask covers the texts of assistant turns.

Null roles and texts count as empty; rows of one conversation are ordered by turn (nulls first), then role,
then text, repeated rows stay.  An empty table gives no rows.  Formatting streams over sorted rows: a conversation of any size is never held
whole, one turn is.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"


class Layout(NamedTuple):
    """``fields``: (role, path) in order; a path may be several joined by ``+``, whose non-empty texts are joined by a blank
    line.  ``turns``: path of a list behind them; role and text are fields of its items."""

    paths: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()


_KNOWN = (
    Layout(("conv_id", "role", "text", "turn"), turns="", role="role", text="text"),
    Layout(("messages[].content", "messages[].role"), turns="messages"),
    Layout(("conversation[].content", "conversation[].role"), turns="conversation"),
    Layout(("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    *(Layout((*paths, "system"), name, *names, (("system", "system"),)) for paths, name, names in (
        (("messages[].content", "messages[].role"), "messages", ("role", "content")),
        (("conversation[].content", "conversation[].role"), "conversation", ("role", "content")),
        (("conversations[].from", "conversations[].value"), "conversations", ("from", "value")),
    )),
    Layout(("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout(("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout(("prompt", "response", "system"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout(("answer", "question"), fields=(("user", "question"), ("assistant", "answer"))),
    Layout(("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout(("input", "instruction", "output"), fields=(("user", "instruction+input"), ("assistant", "output"))),
    Layout(("input", "instruction", "output", "system"), fields=(("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
)
_PATHS = frozenset(p for layout in _KNOWN for p in layout.paths)
#: Names that other layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value: Any, at: str = "") -> set[str]:
    if at in _PATHS:  # a text, or blocks of it
        return {at}
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths) & _PATHS)).encode()).hexdigest()


LAYOUTS = {fingerprint(layout.paths): layout for layout in _KNOWN}


def layout_of(paths) -> Layout:
    found = LAYOUTS.get(fingerprint(paths)) or max((x for x in _KNOWN if set(x.paths) <= set(paths)), key=lambda x: len(x.paths), default=None)
    if found is None:
        raise ValueError(f"no layout has the paths {sorted(paths)}")
    return found


def _text(value: Any) -> str:
    """A text, or blocks with one each."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list):
        return "\n".join(t for b in value if (t := _text(b.get("text") if isinstance(b, dict) else b)))
    raise ValueError(f"no text: {type(value).__name__}")


def canonical(record: dict) -> list[tuple[str, str]]:
    """(role, text) of each turn of one record of any known layout."""
    if not isinstance(record, dict):
        raise ValueError(f"no object: {type(record).__name__}")
    if any(record.get(k) == [] for k in ("messages", "conversations", "conversation")):
        return []
    layout = layout_of(field_paths(record))
    out = []
    for role, path in layout.fields:
        text = "\n\n".join(t for p in path.split("+") if (t := _text(record.get(p))))
        if text or role != "system":
            out.append((role, text))
    if layout.turns is not None:
        for item in record[layout.turns] if layout.turns else [record]:
            if not isinstance(item, dict):
                raise ValueError(f"a turn is no object: {type(item).__name__}")
            role = _text(item.get(layout.role))
            out.append((ROLES.get(role, role), _text(item.get(layout.text))))
    return out


def _escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def _unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role_in(role: str) -> str:
    return _escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_out(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], _unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its loss mask begins and ends (code points; equal: nothing masked in)."""
    head, body = f"{START}{_role_in(role)}\n", _escape(text)
    return head + body + END, len(head), len(head) + (len(body) if role == "assistant" else 0)


def format_chat(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    parts, spans, at = [], [], 0
    for role, text in turns:
        part, begin, end = format_turn(role, text)
        parts.append(part)
        if role == "assistant":
            spans.append((at + begin, at + end))
        at += len(part)
    return "".join(parts), spans


def read_chat(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, found by their marks: no other ``<|`` stands in it."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.find("\n", at)
        stop = formatted.find("<|", line + 1)
        if line < 0 or not formatted.startswith(START, at) or stop < 0 or not formatted.startswith(END, stop):
            raise ValueError(f"no turn at {at}")
        out.append((_role_out(formatted[at + len(START) : line]), _unescape(formatted[line + 1 : stop])))
        at = stop + len(END)
    return out


def masked(formatted: str, spans: list[tuple[int, int]]) -> str:
    """The text under the loss mask, unescaped."""
    return "".join(_unescape(formatted[a:b]) for a, b in spans)


def format_records(records: DataFrame, ident: str = "id", column: str = "record") -> DataFrame:
    """JSON records of mixed layouts: id, layout (fingerprint), formatted, loss spans, error; a null record has none of them."""

    def row(raw: str | None):
        if not raw:
            return None, "", [], None
        try:
            record = json.loads(raw)
            text, spans = format_chat(canonical(record))
            paths = layout_of(field_paths(record)).paths if text else field_paths(record)  # an empty list has no layout
        except (ValueError, RecursionError) as e:  # one odd record leaves the others
            return None, "", [], f"{type(e).__name__}: {e}"[:500]
        return fingerprint(paths), text, [list(x) for x in spans], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.string())
        for batch in batches:
            out = [row(raw) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=["id", "layout", "formatted", "loss", "error"])

    rows = records.select(F.col(ident).cast("string").alias("id"), F.col(column).alias("record"))
    return rows.mapInArrow(run, "id string, layout string, formatted string, loss array<array<long>>, error string")


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The nested field paths of a table's schema, as ``field_paths`` has them of a record."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields)) if kind.fields else {at}
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else {at}


def turns_of(rows: DataFrame, ident: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text of a table in any layout that its schema's fingerprint selects."""
    paths, conv = schema_paths(rows.schema), F.col(ident).cast("long").alias("conv_id")
    layout = layout_of(paths)
    blank = lambda c: F.coalesce(c, F.lit(""))
    if layout.turns == "":
        return rows.select(conv, F.col("turn").cast("long").alias("turn"), blank(F.col(layout.role)).alias("role"), blank(F.col(layout.text)).alias("text"))
    parts = []
    for role, path in layout.fields:
        texts = F.filter(F.array(*[blank(F.col(p)) for p in path.split("+")]), lambda x: x != "")
        parts.append(F.struct(F.lit(role).alias("role"), F.array_join(texts, "\n\n").alias("text")))
    kept = F.filter(F.array(*parts), lambda x: (x["role"] != "system") | (x["text"] != "")) if parts else None
    if layout.turns:

        def one(item):
            role = blank(item.getField(layout.role))
            for theirs, ours in ROLES.items():
                role = F.when(item.getField(layout.role) == theirs, ours).otherwise(role)
            return F.struct(role.alias("role"), blank(item.getField(layout.text)).alias("text"))

        turns = F.transform(layout.turns, one)
        kept = turns if kept is None else F.concat(kept, turns)
    return rows.select(conv, F.posexplode(kept).alias("turn", "__t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "__t.role", "__t.text")


def format_turns(rows: DataFrame, ident: str = "conv_id") -> DataFrame:
    """One formatted piece for each turn of a table of any known layout, in order within partitions that hold whole
    conversations: conv_id, part, formatted, loss_begin, loss_end (within the piece; null: no loss)."""
    turns = turns_of(rows, ident)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part = object(), 0
        for batch in batches:
            out = []
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                conv, part = (c, 0) if c != conv else (conv, part + 1)
                piece, begin, end = format_turn(role, text)
                out.append((part, piece, begin if role == "assistant" else None, end if role == "assistant" else None))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64())))], names=["conv_id", "part", "formatted", "loss_begin", "loss_end"])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, part long, formatted string, loss_begin long, loss_end long")


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of what reading ``format_turns``' output gives, one row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return [conv], [n], [turns.hexdigest()], [chars], [loss.hexdigest()], [total]

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        begun, out = False, []
        conv = n = chars = total = turns = loss = None
        for batch in batches:
            for c, piece, a, b in zip(batch.column(0).to_pylist(), *(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if not begun or c != conv:
                    if begun:
                        out.append(row())
                    begun, conv, n, chars, total, turns, loss = True, c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in read_chat(piece):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    text = masked(piece, [(a, b)])
                    chars += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
                total += len(piece)
            if len(out) >= 1000:
                yield from emit(out, names)
                out = []
        if begun:
            out.append(row())
        yield from emit(out, names)

    def emit(out, names):
        if out:
            cols = [[x[i][0] for x in out] for i in range(6)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
