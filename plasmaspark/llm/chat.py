"""Chat formatting with a grammar round trip.

Grammar: a conversation is a sequence of turns, each
``<|im_start|>`` role newline text ``<|im_end|>`` newline. A turn is rendered
as it stands and reparsed; where role or text don't come back identical its
content is escaped and the round trip repeated until they do. Turns are
rendered row by row, since a rendered turn holds no control string but its
own marks and so parses alike alone and in its conversation. Conversations are then put together in
order, in parts of bounded size, so that one of any length streams through.

Escapes: in texts, ``<``, any backslashes and ``|`` get one more backslash; in
roles, ``%``, ``<`` and line ends are percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Code points of a part; a turn is never cut.
PART = 1 << 20

_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return re.sub("[%<\r\n]", lambda m: f"%{ord(m.group()):02X}", role)


def _unescape_role(role: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m.group(1), 16)), role)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end are where the text stands. Fails on what the grammar doesn't cover."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        turns.append((_unescape_role(m.group(1)), unescape(m.group(2)), m.start(2), m.end(2)))
        at = m.end()
    return turns


def render(role: str, text: str) -> tuple[str, int]:
    """The turn as formatted text, and how often it had to be escaped (0 or 1)."""
    forms = ((role, text), (_escape_role(role), escape(text)))
    for times, (r, t) in enumerate(forms):
        out = f"{START}{r}\n{t}{END}\n"
        try:
            back = parse(out)
        except ValueError:
            continue
        if [b[:2] for b in back] == [(role, text)] and not any(mark in t for mark in (START, END)):
            return out, times
    raise ValueError("the escaped turn doesn't come back")


FORMATTED = "conv_id long, part int, formatted string, loss array<struct<start:int,end:int>>, escaped int"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _parts(trained: tuple[str, ...], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["conv_id", "part", "formatted", "loss", "escaped"], [pa.int64(), pa.int32(), pa.string(), _LOSS, pa.int32()]
        ready: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        rows = ((c, r or "", t or "") for b in batches for c, r, t in zip(*(b.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True))
        for conv, turns in groupby(rows, key=lambda r: r[0]):
            part, texts, loss, size, escaped = 0, [], [], 0, 0
            for _, role, text in turns:
                out, times = render(role, text)
                if texts and size + len(out) > limit:
                    ready.append((conv, part, "".join(texts), loss, escaped))
                    part, texts, loss, size, escaped = part + 1, [], [], 0, 0
                    yield batch_of(ready)
                    ready = []
                if role in trained:
                    start, end = parse(out)[0][2:]
                    loss.append({"start": size + start, "end": size + end})
                texts.append(out)
                size += len(out)
                escaped += times
            ready.append((conv, part, "".join(texts), loss, escaped))
            if sum(len(r[2]) for r in ready) > limit:
                yield batch_of(ready)
                ready = []
        if ready:
            yield batch_of(ready)

    return run


def format_conversations(conversations: DataFrame, trained: tuple[str, ...] = ("assistant",), limit: int = PART) -> DataFrame:
    """(conv_id, part, formatted, loss, escaped): conversations in parts of at most limit code points (or one turn).

    Turns go by turn, then role and text; null turns come first. Null roles and
    texts count as empty; rows without a conversation id form one of their
    own. loss has where trained roles' texts stand in formatted. Rows come out
    in order within a task: parts of a conversation follow each other.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_parts(trained, limit), FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader of format_conversations' output finds, one row per conversation; parts are parsed one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = zip(*(x.split() for x in DIGEST.split(", ")), strict=True)
        arrow = [{"long": pa.int64(), "string": pa.string()}[t] for t in types]
        found: list[tuple] = []
        rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("conv_id", "formatted", "loss")), strict=True))
        for conv, parts in groupby(rows, key=lambda r: r[0]):
            turns, under, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, formatted, loss in parts:
                for role, text, _, _ in parse(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for span in loss:
                    text = unescape(formatted[span["start"] : span["end"]])
                    under.update(text.encode())
                    loss_chars += len(text)
                chars += len(formatted)
            found.append((conv, n, turns.hexdigest(), loss_chars, under.hexdigest(), chars))
            if len(found) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), arrow, strict=True)], list(names))
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), arrow, strict=True)], list(names))

    return formatted.mapInArrow(run, DIGEST)
