"""Conversations rendered by a compiled template, with the spans that a model is to learn, and read back.

Texts are rendered turn by turn, so a task holds one turn at a time however long a conversation is.  Inside texts and
roles the template's control strings are escaped, so reading the output back gives the very same turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.templates import compile_template

CHUNKS = "conv_id long, chunk long, text string, loss array<struct<start:int,end:int>>"
_HIDE = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t", ":": "\\c", "\n": "\\n"}
_SHOW = {v[1]: k for k, v in _HIDE.items()}


def escape(text: str | None) -> str:
    return re.sub(r"\\|###|</turn>", lambda m: _HIDE[m[0]], text or "")


def escape_role(role: str | None) -> str:
    return re.sub(r"\\|###|</turn>|:|\n", lambda m: _HIDE[m[0]], role or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _SHOW[m[1]], text, flags=re.S)


TEMPLATE = """{% for m in messages -%}
### {{ m.role | escape_role }}: {% if m.role == 'assistant' -%}
{% generation %}{{ m.text | escape }}{% endgeneration %}
{%- else %}{{ m.text | escape }}{% endif %}</turn>
{% endfor %}"""
TURN_END = "</turn>\n"


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, end: str = TURN_END) -> DataFrame:
    """conv_id, chunk (from 0), text and loss of each conversation's output, in chunks that end where a turn ends.

    conversations: conv_id, turn, role, text; other columns are not looked at.  Rows of a conversation are taken by turn,
    then role and text; repeated rows are all rendered.  Null texts and roles count as empty, a null conv_id is a
    conversation of its own.  loss: spans of code points within the chunk that stand in generation blocks.  An empty
    table gives no chunks.  The chunks of a conversation lie in one partition, in order.
    """

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_template(template, {"escape": escape, "escape_role": escape_role})
        rows: list[tuple] = []
        weight = 0

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "chunk", "text", "loss"])

        for conv_id, group in groupby(turns(batches), key=lambda r: r[0]):
            messages = ({"role": role or "", "text": text or ""} for _, role, text in group)
            chunk, parts, size, loss = 0, [], 0, []
            for text, generated in compiled({"messages": messages}):
                if generated and text:
                    if loss and loss[-1]["end"] == size:
                        loss[-1]["end"] = size + len(text)
                    else:
                        loss.append({"start": size, "end": size + len(text)})
                parts.append(text)
                size += len(text)
                if not generated and text.endswith(end):
                    rows.append((conv_id, chunk, "".join(parts), loss))
                    weight += size
                    chunk, parts, size, loss = chunk + 1, [], 0, []
                    if weight > 4_000_000 or len(rows) >= 5000:
                        yield made()
                        rows.clear()
                        weight = 0
            if size:
                rows.append((conv_id, chunk, "".join(parts), loss))
                weight += size
        if rows:
            yield made()

    picked = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(render, CHUNKS)


_READ = re.compile(r"### (.*?): (.*?)</turn>\n", re.S)


def read_back(chunks: DataFrame) -> DataFrame:
    """Per conversation, from the chunks alone: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, group in groupby(rows(batches), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = learned = size = 0
            for _, text, spans in group:
                at = 0
                for m in _READ.finditer(text):
                    if m.start() != at:
                        raise ValueError(f"text between turns of conversation {conv_id}")
                    at = m.end()
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                if at != len(text):
                    raise ValueError(f"an open turn in conversation {conv_id}")
                for span in spans:
                    part = unescape(text[span["start"] : span["end"]])
                    learned += len(part)
                    loss.update(part.encode("utf-8", "surrogatepass"))
                size += len(text)
            out.append((conv_id, n, turns.hexdigest(), learned, loss.hexdigest(), size))
            if len(out) >= 5000:
                yield made(out)
                out = []
        if out:
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        fields = [x.split() for x in schema.split(", ")]
        columns = [pa.array(c, pa.int64() if f[1] == "long" else pa.string()) for c, f in zip(zip(*out, strict=True), fields, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [f[0] for f in fields])

    return chunks.mapInArrow(read, schema)
