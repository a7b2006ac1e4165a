"""Format conversations by a template, with the spans a model is to learn.

Turns of a conversation are gathered before the shuffle and after it, ordered, and rendered
where they stand. A conversation is one text in the end, so its turns must fit a task; apart
from that no group exists. Inside texts and roles the escape character precedes every character
that control strings begin or end with, so a text that holds a control string cannot end its
turn, and reading back gives exactly what was formatted.

Defined cases: a null text or role is empty; turns with equal numbers are ordered by role and
text, a null number first; equal rows are as many turns; a null conversation is one conversation.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldmart.llm.template import compile_template, shown

TEMPLATE = (
    "{% for m in messages %}<turn {{ m.role|escape }}>\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}"
    "{% else %}{{ m.text|escape }}{% endif %}</turn>\n{% endfor %}"
)
_MARKED = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_INSIDE = r"((?:[^\\<>]|\\.)*)"
_TURN = re.compile(f"<turn {_INSIDE}>\n{_INSIDE}</turn>\n", re.S)


def escape(text) -> str:
    return _MARKED.sub(r"\\\g<0>", shown(text))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS = {
    "escape": escape,
    "trim": lambda v: shown(v).strip(),
    "lower": lambda v: shown(v).lower(),
    "upper": lambda v: shown(v).upper(),
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple)) else 0,
}


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of what ``TEMPLATE`` made."""
    turns, at = [], 0
    while at < len(formatted):
        met = _TURN.match(formatted, at)
        if not met:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(met[1]), unescape(met[2])))
        at = met.end()
    return turns


def format_conversations(
    rows: DataFrame,
    template: str = TEMPLATE,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``id, formatted, spans``: the text of each conversation and where generation stands in it."""
    compile_template(template, FILTERS)  # a template that cannot be read fails here
    gathered = (
        rows.select(
            F.col(conversation).alias("id"),
            F.struct(
                F.col(turn).alias("turn"),
                F.coalesce(F.col(role), F.lit("")).alias("role"),
                F.coalesce(F.col(text), F.lit("")).alias("text"),
            ).alias("said"),
        )
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("said")).alias("said"))
        .select("id", F.transform("said", lambda s: F.struct(s["role"], s["text"])).alias("said"))
    )

    def render(batches):
        formatter = compile_template(template, FILTERS)
        for batch in batches:
            texts, spans = [], []
            for said in batch.column(1).to_pylist():
                messages = [dict(zip(("role", "text"), s.values())) for s in said]
                formatted, generated = formatter({"messages": messages})
                texts.append(formatted)
                spans.append([{"start": a, "end": b} for a, b in generated])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)],
                ["id", "formatted", "spans"],
            )

    kind = rows.select(F.col(conversation)).schema[0].dataType.simpleString()
    return gathered.mapInArrow(
        render, f"id {kind}, formatted string, spans array<struct<start: bigint, end: bigint>>"
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What ``TEMPLATE`` made, read back: turns, what is learned, and lengths, of each conversation."""

    def digest(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(*(batch.column(c).to_pylist() for c in ("formatted", "spans"))):
                turns = read_back(text)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{role}\n{content}\n" for role, content in turns)
                rows.append((len(turns), _sha256(said), len(learned), _sha256(learned), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", *_DIGESTS])

    kind = formatted.schema["id"].dataType.simpleString()
    return formatted.mapInArrow(
        digest,
        f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
        " formatted_chars bigint",
    )


_DIGESTS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
