"""Chat formatting with a grammar round trip.

The template is ``<|im_start|>ROLE\nTEXT<|im_end|>\n`` for every turn. A strict,
deterministic parser reads rendered text back. A turn is first rendered as it is;
when the parser does not return exactly that turn, its text (and then its role) is
escaped and it is rendered and parsed again, until both are identical:

* text: every ``<``, backslashes, ``|`` gains one backslash; reading takes one away
  from every ``<``, one or more backslashes, ``|``;
* role: backslash and line feed become two-character sequences.

Defined results: null text and null role are empty; rows of one conversation are
ordered by turn (null first), then role, then text; repeated rows stay; a null
conversation id is a conversation of its own; an empty table gives no rows; further
columns are ignored.

Rows are shuffled by conversation and sorted; a task streams over them, holding one
turn and running digests, so a conversation of any length needs bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from survlake.llm.tables import ship

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n((?:(?!<\|im_(?:start|end)\|>).)*)<\|im_end\|>\n", re.S)
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE = {"\\\\": "\\", "\\n": "\n"}


def escape(text: str) -> str:
    return _MARK.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\[\\n]", lambda m: _ROLE[m[0]], role)


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """Turns of rendered text: role, text, and the span of the (escaped) text. Raises where the grammar breaks."""
    at = 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        yield unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


def _reads_as(rendered: str, role: str, text: str) -> bool:
    try:
        return [t[:2] for t in parse(rendered)] == [(role, text)]
    except ValueError:
        return False


def render_turn(role: str, text: str) -> str:
    """The turn in the template, escaped only as far as the round trip asks for."""
    for r, t in ((role, text), (role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))):
        rendered = f"{START}{r}\n{t}{END}\n"
        if _reads_as(rendered, role, text):
            return rendered
    raise AssertionError("escaped turn does not read back")


def _turns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, str, str]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())


def _format(batches: Iterable[pa.RecordBatch], loss_roles: frozenset[str]) -> Iterator[tuple]:
    """Per turn: conversation, number of the turn, rendered segment, its start, loss span within the conversation."""
    conv, n, at = object(), 0, 0
    for cid, role, text in _turns(batches):
        if cid != conv:
            conv, n, at = cid, 0, 0
        role, text = role or "", text or ""
        seg = render_turn(role, text)
        lo = at + len(seg) - len(END) - 1
        span = (lo, lo)
        if role in loss_roles:
            ((_, _, a, b),) = parse(seg)
            span = (at + a, at + b)
        yield cid, n, seg, at, span
        n, at = n + 1, at + len(seg)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _ordered(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    ship(rows.sparkSession)
    cols = rows.select("conv_id", role.alias("role"), text.alias("text"), "turn")
    return cols.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")


def format_conversations(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: its rendered segment, where it starts in the conversation, and the loss span.

    The segments of a conversation in order of ``turn_no`` are its formatted text; the
    loss span covers the escaped text of turns whose role is in ``loss_roles`` (empty
    otherwise). Offsets are code points.
    """
    roles = frozenset(loss_roles)
    cid = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {cid}, turn_no long, segment string, seg_start long, loss_start long, loss_end long"

    def run(batches):
        return _batches(((c, n, seg, at, *span) for c, n, seg, at, span in _format(batches, roles)), arrow)

    arrow = _arrow(schema)
    return _ordered(rows).mapInArrow(run, schema)


def conversation_digests(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formats, then reads every segment back with the parser and digests what was read, per conversation."""
    roles = frozenset(loss_roles)
    cid = rows.schema["conv_id"].dataType.simpleString()
    schema = ("conv_id " + cid + ", n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")

    def conversations(batches):
        state = None
        for conv, no, seg, start, (lo, hi) in _format(batches, roles):
            if no == 0:
                if state:
                    yield state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(seg):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            masked = unescape(seg[lo - start:hi - start])
            state[3] += len(masked)
            state[4].update(masked.encode("utf-8", "surrogatepass"))
            state[5] += len(seg)
        if state:
            yield state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

    def run(batches):
        return _batches(conversations(batches), arrow)

    arrow = _arrow(schema)
    return _ordered(rows).mapInArrow(run, schema)
