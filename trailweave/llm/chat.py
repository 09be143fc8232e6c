"""Conversations as training text: rendered by a compiled template, and read back.

Every turn is ``### Role:``, a line break, the text and ``</turn>`` with a line break. Inside texts a
backslash goes before each backslash and ``#`` and between ``<`` and ``/``, so neither marker can occur in
one, and dropping the backslashes restores the text. Only assistants' texts are under the loss mask.

Rows go to their conversation's task by a shuffle and are sorted by turn there (ties by role and
text), and stream through the closures: a task holds one turn at a time, however long a conversation
is. The rows of one conversation must pass through one task, since its digest is sequential.

Defined cases: null texts and roles are empty; null turns come first; a null conversation id is a
conversation of its own, and ids may be numbers or texts; repeated rows are turns of their own; unknown roles are kept and not under
the mask; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trailweave.llm.chat_template import Segment, Template

TURN_END = "</turn>\n"
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
_NAMES = {v: k for k, v in ROLES.items()}

TEMPLATE = """\
{%- for message in messages -%}
{{ '### ' ~ message.role | role_name ~ ':\\n' }}
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif -%}
{{ '</turn>' ~ '\\n' }}
{%- endfor -%}
"""


def escape(text: str | None) -> str:
    """A text in which no marker can occur."""
    return (text or "").replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def unescape(text: str) -> str:
    """The text of an escaped one."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def role_name(role: str | None) -> str:
    """How a role is written in a turn's marker: known ones by name, others escaped behind ``=``."""
    return ROLES.get(role or "") or "=" + escape(role).replace(":", "\\:")


def compiled(source: str = TEMPLATE) -> Template:
    """A template with this module's filters."""
    return Template(source, {"escape": escape, "role_name": role_name})


def read_turns(segments: Iterator[Segment]) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, text under the mask, length as formatted) of each turn, read from the formatted output."""
    held, marked = "", ""
    header = re.compile(r"### ((?:[^\\:]|\\.)*):\n", re.DOTALL)
    for text, mask in segments:
        held += text
        marked += text if mask else ""
        if not held.endswith(TURN_END):
            continue
        m = header.match(held)
        if not m:
            raise ValueError("the output has a turn without a marker")
        body = held[m.end() : -len(TURN_END)]
        role = _NAMES[m[1]] if m[1] in _NAMES else unescape(m[1][1:])
        yield role, unescape(body), unescape(marked), len(held)
        held, marked = "", ""
    if held:
        raise ValueError("the output ends inside a turn")


_KEYS = ("conv_id", "turn", "role", "text")


def _turn_rows(df: DataFrame) -> DataFrame:
    """Each conversation in one partition, in order."""
    return df.select(*_KEYS).repartition("conv_id").sortWithinPartitions(*_KEYS)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conv_id, its turns), read from sorted batches as they are asked for."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for key, own in groupby(rows, key=lambda r: r[0]):
        yield key, ({"role": role or "", "text": text or ""} for _, _, role, text in own)


#: Rows of a result batch, and characters after which one is sent.
BATCH = 4096
BATCH_CHARS = 1 << 22


def _sent(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded number of rows and, but for one row, of characters."""
    out: list[tuple] = []
    held = 0
    for row in rows:
        out.append(row)
        held += size(row)
        if len(out) == BATCH or held >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def format_conversations(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans): the text of every conversation and the spans the loss counts.

    A row holds the whole text of its conversation, so that is what bounds a task's memory here.
    """
    kind = df.schema["conv_id"].dataType
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", spans_type)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        made = compiled(template)
        for conv_id, turns in _conversations(batches):
            n = 0

            def counted() -> Iterator[dict]:
                nonlocal n
                for n, turn in enumerate(turns, 1):  # noqa: B007, B023
                    yield turn

            text, spans = made.render(messages=counted())
            yield conv_id, n, text, [{"start": a, "end": b} for a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(rows(batches), schema, lambda row: len(row[2]))

    return _turn_rows(df).mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>")


def round_trip_digest(df: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Per conversation, digests of what is read back from the formatted output."""
    kind = df.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        made = compiled(template)
        for conv_id, turns in _conversations(batches):
            all_turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text, masked, length in read_turns(made.segments(messages=turns)):
                all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss.update(masked.encode("utf-8", "surrogatepass"))
                n, loss_chars, chars = n + 1, loss_chars + len(masked), chars + length
            yield conv_id, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(rows(batches), schema, lambda _: 1)

    return _turn_rows(df).mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(df: DataFrame, conv_id: int = -7, text: str = r"\### Assistant: </turn> ok") -> DataFrame:
    """The conversations and one more, whose user and assistant both say ``text``."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = df.sparkSession.range(0, 2, 1, 1).select(F.lit(conv_id).cast(df.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(df.schema["turn"].dataType).alias("turn"), role.alias("role"), F.lit(text).alias("text"))
    return df.select(*_KEYS).unionByName(probe)
