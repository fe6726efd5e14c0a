"""Chat formatting (operator 4): prefix-target expansion.

Every assistant turn becomes an example of its own: the text of all turns before
it as context and the reply itself, the only part under the loss mask.  Turns
after the last reply (or a conversation without any) end in an example that has
no loss, so no turn is lost.

Template: a turn is ``[NAME] text [/NAME]``, NAME being SYS, INST, ASST or, for
other roles, TURN and the role in hexadecimal; a reply is followed by ``</s>``
and a conversation begins with ``<s>``.  Control strings inside texts are escaped
by one backslash after their bracket (one more where there are some), so that
reading back is exact.

Rows are dealt by conversation and sorted by turn (null first; ties by role and
text; repeated rows are turns of their own).  A conversation's examples are
written one at a time while its rows stream by.  Null texts and roles are empty;
null conversation ids are one conversation.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = {"system": "SYS", "user": "INST", "assistant": "ASST"}
_ROLES = {v: k for k, v in NAMES.items()}
_BODY = r"/?(?:SYS|INST|ASST|TURN(?: [0-9a-f]*)?)\]|/?s>"
_ESCAPE = re.compile(rf"([\[<])(\\*)(?={_BODY})")
_UNESCAPE = re.compile(rf"([\[<])\\(\\*)(?={_BODY})")
_TURN = re.compile(r"\[(SYS|INST|ASST|TURN [0-9a-f]*)\] (.*?) \[/(?:SYS|INST|ASST|TURN)\]", re.DOTALL)
#: Characters of examples that are held before a batch is passed on.
FLUSH = 4_000_000
SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())
])


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and where its escaped text begins and ends in that."""
    name, body = NAMES.get(role), escape(text)
    opening = f"[{name}] " if name else f"[TURN {role.encode().hex()}] "
    end = f" [/{name or 'TURN'}]" + ("</s>" if role == "assistant" else "")
    return opening + body + end, len(opening), len(opening) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted example."""
    return [
        (_ROLES.get(name) or bytes.fromhex(name[5:]).decode(), unescape(body)) for name, body in _TURN.findall(formatted)
    ]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _flush(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    now, parts, size, number, pending = object(), [], 0, 0, False

    def rest():  # turns that no reply follows
        return (now, number, "".join(parts), size, size)

    for conv, role, text in _rows(batches):
        if conv != now:
            if pending:
                out.append(rest())
                held += size
            now, parts, size, number = conv, ["<s>"], 3, 0
        written, a, b = render(role, text)
        parts.append(written)
        pending = role != "assistant"
        if not pending:
            parts = ["".join(parts)]
            out.append((conv, number, parts[0], size + a, size + b))
            held += len(parts[0])
            number += 1
        size += len(written)
        if held >= FLUSH:
            yield _flush(out, SCHEMA)
            out, held = [], 0
    if pending:
        out.append(rest())
    if out:
        yield _flush(out, SCHEMA)


def examples(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end), in order inside a partition
    that holds whole conversations; the loss span is empty where nothing is trained."""
    rows = conversations.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_expand, "conv_id long, example long, text string, loss_start long, loss_end long")


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64()),
])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out = object(), []
    last, loss, loss_chars, chars, trained = "", hashlib.sha256(), 0, 0, 0

    def close():
        turns = parse(last)
        whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
        return (now, len(turns), whole.hexdigest(), loss_chars, loss.hexdigest(), chars, trained)

    begun = False
    for conv, _, text, a, b in _rows(batches):
        if not begun or conv != now:
            if begun:
                out.append(close())
            now, begun, loss, loss_chars, chars, trained = conv, True, hashlib.sha256(), 0, 0, 0
        reply = unescape(text[a:b])
        loss.update(reply.encode())
        loss_chars += len(reply)
        chars += len(text)
        trained += a < len(text)
        last = text
        if len(out) >= 10_000:
            yield _flush(out, _DIGEST)
            out = []
    if begun:
        yield _flush([*out, close()], _DIGEST)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples as examples() leaves them."""
    return formatted.mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
    )
