"""Chat formatting: conversations rendered by a compiled template, with the spans to learn from.

Turns are brought together and ordered by one shuffle and a sort on (conv_id, turn); then
each partition streams through the renderer. A conversation of any length is held only as
the turns between two pieces of output, so the memory of a task does not grow with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .template import BEGIN, END, compile_template, unescape_control

CHATML = (
    "{% for message in messages %}{{ '<|im_start|>' ~ (message.role | escape_control) ~ '\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape_control }}{% endgeneration %}"
    "{% else %}{{ message.text | escape_control }}{% endif %}{{ '<|im_end|>\n' }}{% endfor %}"
)
START, STOP = "<|im_start|>", "<|im_end|>\n"
PART_CHARS = 4_000_000


def _turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)


def _conversations(batches) -> Iterator[tuple[int | None, Iterator[dict[str, str]]]]:
    for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
        yield conv, ({"role": role, "text": text} for _, role, text in rows)


def format_conversations(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """conv_id, part, formatted, loss_spans (code points in ``formatted``, end exclusive).

    One row for each conversation; one longer than ``PART_CHARS`` comes in several, numbered
    by ``part``, to be joined in order. Rows are ordered by turn, null turns first, equal
    turns by role and text, repeated rows stay; null roles and texts are empty; rows
    without conv_id are one conversation. Other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        render = compile_template(template)
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        out, size = [], 0
        for conv, messages in _conversations(batches):
            part, pieces, at, spans, begun = 0, [], 0, [], None

            def row():
                text = "".join(pieces)
                return {"conv_id": conv, "part": part, "formatted": text, "loss_spans": spans + ([{"start": begun, "end": at}] if begun is not None else [])}

            for piece in render(messages):
                if piece is BEGIN:
                    begun = at
                elif piece is END:
                    spans.append({"start": begun, "end": at})
                    begun = None
                else:
                    if at and at + len(piece) > PART_CHARS:
                        yield pa.RecordBatch.from_pylist([*out, row()], schema)
                        out, size, part, pieces, at, spans, begun = [], 0, part + 1, [], 0, [], 0 if begun is not None else None
                    pieces.append(piece)
                    at += len(piece)
            out.append(row())
            size += at
            if size > PART_CHARS:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return _turns(conversations).mapInArrow(run, "conv_id long, part int, formatted string, loss_spans array<struct<start:int,end:int>>")


class ReadBack:
    """Reads turns and learnt text from formatted output as it comes; holds one turn at most."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.tail: list[str] = []
        self.masked: list[str] | None = None

    def feed(self, piece) -> None:
        if piece is BEGIN:
            self.masked = []
        elif piece is END:
            text = unescape_control("".join(self.masked))
            self.loss.update(text.encode())
            self.loss_chars += len(text)
            self.masked = None
        else:
            self.chars += len(piece)
            self.tail.append(piece)
            if self.masked is not None:
                self.masked.append(piece)
            if STOP[-1] in piece and STOP in (text := "".join(self.tail)):
                *whole, rest = text.split(STOP)
                for turn in whole:
                    if not turn.startswith(START):
                        raise ValueError(f"no turn starts at {turn[:40]!r}")
                    role, _, body = turn[len(START) :].partition("\n")
                    self.turns.update(f"{unescape_control(role)}\n{unescape_control(body)}\n".encode())
                    self.n_turns += 1
                self.tail = [rest]

    def row(self, conv) -> tuple:
        if any(self.tail):
            raise ValueError("a turn isn't closed")
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def chat_digest(conversations: DataFrame) -> DataFrame:
    """The digest result: one row for each conversation, read back from its formatted output."""

    def run(batches):
        import pyarrow as pa

        render = compile_template(CHATML)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        rows: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for conv, messages in _conversations(batches):
            back = ReadBack()
            for piece in render(messages):
                back.feed(piece)
            rows.append(back.row(conv))
            if len(rows) == 10_000:
                yield batch()
                rows = []
        if rows:
            yield batch()

    return _turns(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
