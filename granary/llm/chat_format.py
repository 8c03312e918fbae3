"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn. The template marks each turn so that a deterministic parser
can read the rendered text back; a turn's text that would be read back otherwise (because it holds
control strings or escapes) is escaped, step by step, until the parser returns it unchanged. A rendered
turn is parsed to its end by itself, so a conversation parses to its turns in order, and long
conversations are checked as a stream.

Template (fixed values of this format)::

    system      <<SYS>>text<</SYS>>
    user        [INST] text [/INST]
    assistant   <s>text</s>
    other       [ROLE role]text[/ROLE]

Escapes: a backslash before ``\\``, ``<``, ``[`` or ``]``. The loss mask covers the text between
``<s>`` and ``</s>``.

Work: rendering is done row by row where the rows lie; rows are then dealt by conversation and sorted
by turn, and each task reads its rows as a stream, holding one turn and running digests, so a
conversation of any length needs no more memory. (A digest over a whole conversation must read its
turns in order: a conversation is one stream.)

Defined cases: a null text or role is empty; rows without a conversation (null conv_id) form one; turns
sort by turn (null first), then role and text, so ties and repeated rows have a fixed place and are all
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Opening and closing marks of the known roles.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}

_ESCAPED = re.compile(r"\\([\\<\[\]])")
_CONTROL = re.compile(r"</?s>|<</?SYS>>|\[/?INST\]|\[/?ROLE|\\(?=[\\<\[\]])")
_OPEN = re.compile(r"<<SYS>>|\[INST\] |<s>|\[ROLE ((?:[^\\\]]|\\.)*)\]", re.S)
#: A turn ends at its first closing mark that is not part of an escape.
_CLOSE = {end: re.compile(r"\\[\\<\[\]]|" + re.escape(end)) for end in [*(end for _, end in MARKS.values()), "[/ROLE]"]}


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _escape(text: str, level: int) -> str:
    if level == 0:
        return text
    if level == 1:  # only what the parser would take for a mark or an escape
        return _CONTROL.sub(lambda m: "\\" + m[0], text)
    return re.sub(r"([\\<\[\]])", r"\\\1", text)


def parse_turn(rendered: str, at: int = 0) -> tuple[str, str, int, int, int] | None:
    """Role, text, the raw text's start and end, and the turn's end, of the turn that starts at ``at``; None if none does."""
    opened = _OPEN.match(rendered, at)
    if not opened:
        return None
    mark = opened[0]
    role = unescape(opened[1]) if opened[1] is not None else next(r for r, (o, _) in MARKS.items() if o == mark)
    end = "[/ROLE]" if opened[1] is not None else MARKS[role][1]
    for found in _CLOSE[end].finditer(rendered, opened.end()):
        if found[0] == end:
            return role, unescape(rendered[opened.end() : found.start()]), opened.end(), found.start(), found.end()
    return None


def parse_conversation(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation; ValueError if it is not one."""
    turns, at = [], 0
    while at < len(rendered):
        turn = parse_turn(rendered, at)
        if turn is None:
            raise ValueError(f"no turn starts at {at}")
        turns.append(turn[:2])
        at = turn[4]
    return turns


def render_turn(role: str, text: str) -> str:
    """A turn that parses back to just this role and text."""
    for level in range(1 if _CONTROL.search(text) else 0, 3):
        body = _escape(text, level)
        opened, closed = MARKS.get(role) or ("[ROLE " + _escape(role, 2) + "]", "[/ROLE]")
        rendered = opened + body + closed
        back = parse_turn(rendered)
        if back is not None and back[:2] == (role, text) and back[4] == len(rendered):
            return rendered
    raise ValueError("a turn could not be escaped")


def render_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls empty) and rendered: row by row, without a shuffle."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [render_turn(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], ["conv_id", "turn", "role", "text", "rendered"])

    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, rendered string")


class _Reader:
    """Reads a rendered conversation piece by piece and keeps digests of what it reads."""

    def __init__(self) -> None:
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, rendered: str) -> None:
        for role, text in parse_conversation(rendered):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode())
        self.formatted_chars += len(rendered)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def _ordered(rendered: DataFrame) -> DataFrame:
    return rendered.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its rendered text."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, current, done = None, None, []
        for b in batches:
            for conv_id, rendered in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if reader is None or conv_id != current:
                    if reader is not None:
                        done.append(reader.row(current))
                    reader, current = _Reader(), conv_id
                reader.read(rendered)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], _arrow)
                done = []
        if reader is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, reader.row(current)))], _arrow)

    _arrow = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
    return _ordered(render_turns(conversations)).select("conv_id", "rendered").mapInArrow(run, schema)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted (the rendered text) and loss_spans (start and end of each masked stretch, in code points of formatted).

    The text of one conversation is one value here, so it must fit a row.
    """
    ordered = render_turns(conversations).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = []
            for text in b.column(1).to_pylist():
                at, own = 0, []
                while at < len(text):
                    role, _, start, end, at = parse_turn(text, at)
                    if role == "assistant":
                        own.append({"start": start, "end": end})
                spans.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, kind)], ["conv_id", "formatted", "loss_spans"])

    joined = ordered.select("conv_id", F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("formatted"))
    return joined.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>")
