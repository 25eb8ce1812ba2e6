"""Prefix-target expansion of conversations into chat training examples.

A conversation is formatted once; every assistant turn is then one example: the formatted text up to the end of that
turn is its context and target, and only the reply's characters are trainable. Examples are stored as offsets into
the shared text, so a conversation of n turns takes space in proportion to n and not to its square;
:func:`materialise` writes them out in full, one at a time, and :func:`explode` as rows.

Template: each turn is ``<s>role``, a line break, the text, ``</s>``. Control strings inside roles and texts, and line
breaks inside roles, are escaped with a backslash and a letter, so no control string occurs in an escaped text and
:func:`unescape` gives back the original.

Defined cases: rows are ordered by turn, then role, then text, nulls first; a null text is empty, a null role is the
role ``unknown``; rows that repeat are turns of their own; a null conv_id is a conversation; a very long text is a turn like
others; columns other than conv_id, turn, role and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
# Strings with a meaning for chat models.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_TO_ESCAPE = re.compile(r"\\|<(?=/?s>|</?SYS>>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)")
_BACK = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}

SCHEMA = "conv_id long, formatted string, examples array<struct<turn: int, end: long, target_start: long, target_end: long>>"


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: _ESCAPES[m[0]], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def format_conversation(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The formatted text and, for each assistant turn: its number, where it ends, and its reply's span."""
    parts, examples, at = [], [], 0
    for number, (role, text) in enumerate(turns):
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        start = at + len(head)
        at = start + len(body) + len(CLOSE)
        parts += [head, body, CLOSE]
        if role == "assistant":
            examples.append((number, at, start, start + len(body)))
    return "".join(parts), examples


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text."""
    turns = []
    for piece in formatted.split(OPEN)[1:]:
        role, _, body = piece.removesuffix(CLOSE).partition("\n")
        turns.append((unescape(role), unescape(body)))
    return turns


def materialise(formatted: str, examples: list[tuple[int, int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Each example in full: its text, and the span of it that is trainable."""
    for _, end, start, stop in examples:
        yield formatted[:end], start, stop


def expand(conversations: DataFrame) -> DataFrame:
    """One row per conversation: formatted text and its examples.

    Conversations are dealt by id and sorted inside partitions, so a task holds one conversation at a time.
    """
    ordered = (
        conversations.select(
            F.col("conv_id").cast("long"), F.col("turn").cast("long"),
            F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True))
        kind = pa.list_(pa.struct([("turn", pa.int32()), ("end", pa.int64()), ("target_start", pa.int64()), ("target_end", pa.int64())]))
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], kind)],
                ["conv_id", "formatted", "examples"],
            )

        for conv_id, group in groupby(rows, key=lambda r: r[0]):
            text, found = format_conversation([(r[1], r[2]) for r in group])
            names = ("turn", "end", "target_start", "target_end")
            out.append((conv_id, text, [dict(zip(names, e, strict=True)) for e in found]))
            size += len(text)
            if size > 4 << 20:
                yield batch()
                out, size = [], 0
        yield batch()

    return ordered.mapInArrow(run, SCHEMA)


EXAMPLES = "conv_id long, turn int, context string, target string, n_trained long"


def explode(expanded: DataFrame) -> DataFrame:
    """One row per assistant turn of what :func:`expand` gives: all that precedes the reply, the reply with its end
    mark, and how many characters of it are trainable; those of the context are not. Rows are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64())
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in EXAMPLES.split(", ")])

        for b in batches:
            for conv_id, text, examples in zip(*(b.column(n).to_pylist() for n in ("conv_id", "formatted", "examples")), strict=True):
                spans = [(e["turn"], e["end"], e["target_start"], e["target_end"]) for e in examples]
                for (turn, *_), (whole, start, stop) in zip(spans, materialise(text, spans), strict=True):
                    out.append((conv_id, turn, whole[:start], whole[start:], stop - start))
                    size += len(whole)
                    if size > 4 << 20:
                        yield batch()
                        out, size = [], 0
        yield batch()

    return expanded.mapInArrow(run, EXAMPLES)
