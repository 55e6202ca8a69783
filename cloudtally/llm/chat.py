"""Conversations as training text: a compiled template marks turns and what the model is to learn.

Rows are gathered by conversation and ordered by turn (of equal turns by role, then text; null turns
first). A conversation is one row of output and must fit into a task's memory; nothing else is gathered.
The template's control strings are escaped inside roles and texts, so that texts cannot
forge a turn, and ``parse`` gives back exactly what was put in. Null roles and texts count as empty, a null
conv_id is a conversation of its own, and repeated rows are repeated turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudtally.llm import template

CONTROL = ("###", "</turn>")
END = "</turn>\n"
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | escape_line }}:\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
_HEAD = re.compile(r"### ([^\n]*):\n")
_BACK = re.compile(r"\\(\\|###|</turn>)")


def escape(text: object) -> str:
    """A backslash before every control string, and before every backslash."""
    out = template.show(text)
    if "\\" in out:
        out = out.replace("\\", "\\\\")
    for c in CONTROL:
        if c in out:
            out = out.replace(c, "\\" + c)
    return out


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text) if "\\" in text else text


def escape_line(text: object) -> str:
    """Also without line ends, for a header: a percent sign marks what it replaces."""
    return escape(template.show(text).replace("%", "%25").replace("\n", "%0A"))


def unescape_line(text: str) -> str:
    return unescape(text).replace("%0A", "\n").replace("%25", "%")


FILTERS = {"escape": escape, "escape_line": escape_line}


def _end(text: str, at: int) -> int:
    """Where the turn that is open at ``at`` ends: the next end mark without a backslash of its own."""
    while True:
        found = text.find(END, at)
        if found < 0:
            raise ValueError("a turn has no end")
        back = found
        while back > 0 and text[back - 1] == "\\":
            back -= 1
        if (found - back) % 2 == 0:
            return found
        at = found + 1


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        if not head:
            raise ValueError("a turn has no head")
        stop = _end(text, head.end())
        turns.append((unescape_line(head[1]), unescape(text[head.end() : stop])))
        at = stop + len(END)
    return turns


def formatted(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """conv_id, text and loss (the spans to learn, as start and end) of every conversation."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = conversations.select("conv_id", turn.alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = template.compiled(source, FILTERS)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [render({"messages": m}) for m in part.column("messages").to_pylist()]
                spans = [[{"start": a, "end": b} for a, b in spans] for _, spans in made]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array([t for t, _ in made], pa.string()), pa.array(spans, kind)], ["conv_id", "text", "loss"]
                )

    cut = gathered.select(F.col("conv_id").cast("long").alias("conv_id"), "messages")
    return cut.mapInArrow(run, "conv_id long, text string, loss array<struct<start:long,end:long>>")


def parsed(texts: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), learned (the unescaped text under the loss mask) and n_chars, read from the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = part.column("text").to_pylist()
                turns = [[{"role": r, "text": t} for r, t in parse(x)] for x in text]
                learned = ["".join(unescape(x[s["start"] : s["end"]]) for s in spans) for x, spans in zip(text, part.column("loss").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array(turns, kind), pa.array(learned, pa.string()), pa.array(map(len, text), pa.int64())],
                    ["conv_id", "turns", "learned", "n_chars"],
                )

    return texts.mapInArrow(run, "conv_id long, turns array<struct<role:string,text:string>>, learned string, n_chars long")
