"""Chat formatting by incremental black-box rendering.

A template is any object that turns a list of ``(role, text)`` into one string.  It is only ever called: successive
prefixes of a conversation are rendered, what a further turn adds to the previous output is
that turn's span, and a template whose output does not start with the previous one has
rewritten history.  Where a turn's text lies in its span is found by rendering the turn once more with a
probe in place of the text.

Conversations of more than ``window`` turns are rendered in blocks of so many, each after the
last ``overlap`` turns of the block before: memory and work per turn stay bounded, and no block
waits for another.  ``InstructTemplate`` renders a turn alike after any context, so its blocks join to
what one rendering of the whole gives.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.llm.common import Scratch
from sessionscope.llm.turns import NOTHING, fold_conversations, place_turns

Turn = tuple[str, str]
PROBE = "probe"


class Template(Protocol):
    def render(self, turns: list[Turn]) -> str: ...


class InstructTemplate:
    """``[INST] user [/INST] assistant</s>``; other roles are named in a mark of their own.

    Control strings inside roles and texts get one more backslash after their first sign, so
    that no text can hold one, and reading takes one away again.
    """

    CONTROL = r"(/?(?:s>|(?:INST|ROLE)\]))"
    RAISE = re.compile(r"([<\[])(\\*)" + CONTROL)
    LOWER = re.compile(r"([<\[])\\(\\*)" + CONTROL)

    def escape(self, text: str) -> str:
        return self.RAISE.sub(r"\1\\\2\3", text)

    def unescape(self, text: str) -> str:
        return self.LOWER.sub(r"\1\2\3", text)

    def render(self, turns: list[Turn]) -> str:
        return "<s>" + "".join(self._turn(role, self.escape(text)) for role, text in turns)

    def _turn(self, role: str, text: str) -> str:
        if role == "user":
            return f"[INST] {text} [/INST]"
        if role == "assistant":
            return f" {text}</s>"
        return f"[ROLE] {self.escape(role)}[/ROLE] {text}</s>"

    def read(self, formatted: str) -> list[Turn]:
        """The turns of a formatted conversation or of a run of whole turns from it."""
        turns, at = [], 3 if formatted.startswith("<s>") else 0
        while at < len(formatted):
            role, end = None, "</s>"
            if formatted.startswith("[INST] ", at):
                role, at, end = "user", at + 7, " [/INST]"
            elif formatted.startswith("[ROLE] ", at):
                stop = formatted.index("[/ROLE] ", at)
                role, at = self.unescape(formatted[at + 7 : stop]), stop + 8
            elif formatted.startswith(" ", at):
                role, at = "assistant", at + 1
            else:
                raise ValueError(f"No turn starts at character {at}")
            stop = formatted.index(end, at)
            turns.append((role, self.unescape(formatted[at:stop])))
            at = stop + len(end)
        return turns


def locate(template: Template, context: list[Turn], before: str, turn: Turn, probed: bool) -> tuple[str, str, tuple[int, int] | None, int]:
    """Renders one more turn: the output, the turn's span, its text in the span, and characters of history rewritten.

    The text's place is null if it is not asked for, or if the template does not show it once and in one piece.
    """
    after = template.render(context + [turn])
    kept = len(before) if after.startswith(before) else len(os.path.commonprefix([before, after]))
    span, rewritten = after[kept:], len(before) - kept
    if not probed or rewritten:
        return after, span, None, rewritten
    shown = template.render(context + [(turn[0], PROBE)])[kept:]
    head, found, tail = shown.partition(PROBE)
    fits = found and PROBE not in tail and span.startswith(head) and span.endswith(tail) and len(head) + len(tail) <= len(span)
    return after, span, (len(head), len(span) - len(head) - len(tail)) if fits else None, 0


FORMATTED = "position long, formatted string, loss_start int, loss_length int, rewritten long"


class _Render:
    """Reads a partition in the order of conversations, blocks and positions."""

    def __init__(self, template: Template, loss_roles: tuple[str, ...], window: int):
        self.template, self.loss_roles, self.window = template, loss_roles, window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, context, before = NOTHING, [], ""
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, out = [], []
                for i, row in enumerate(part.to_pylist()):
                    if (row["conv_id"], row["block"]) != key:
                        key, context, before = (row["conv_id"], row["block"]), [], ""
                    turn = row["role"], row["text"]
                    if row["position"] // self.window == row["block"]:
                        before, span, place, rewritten = locate(self.template, context, before, turn, turn[0] in self.loss_roles)
                        ids.append(i)
                        out.append((row["position"], span, *(place or (None, None)), rewritten))
                        context.append(turn)
                    else:
                        context.append(turn)
                        before = self.template.render(context)
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
                columns = [pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)]
                conv = part.column("conv_id").take(pa.array(ids, pa.int64()))
                names = ["conv_id", "position", "formatted", "loss_start", "loss_length", "rewritten"]
                yield pa.RecordBatch.from_arrays([conv, *columns], names=names)


def format_conversations(
    conversations: DataFrame,
    template: Template,
    loss_roles: tuple[str, ...] = ("assistant",),
    window: int = 64,
    overlap: int = 8,
) -> DataFrame:
    """One row per turn: ``conv_id, position, formatted, loss_start, loss_length, rewritten``.

    The ``formatted`` pieces of a conversation, joined in the order of ``position``, are its formatted
    text; the loss mask covers ``loss_length`` characters from ``loss_start`` of a piece, whole texts of the
    named roles.  ``rewritten`` counts characters of earlier output that the turn changed; such
    a turn has no loss, since its conversation's pieces do not join.

    Turns are ordered by ``turn``, null first, ties by role and digest of the text.  Null roles and texts are empty,
    rows without ``conv_id`` are one conversation, repeated rows are turns like any other.  An empty
    table gives no rows; further columns are ignored.
    """
    placed = place_turns(conversations, Scratch(conversations.sparkSession, "chat"))
    block = F.floor(F.col("position") / window)
    # The last turns of a block are the context of the next one too.
    leads = F.col("position") % window >= window - overlap
    blocks = F.explode(F.when(leads, F.array(block, block + 1)).otherwise(F.array(block)))
    dealt = placed.select("conv_id", "role", "text", "position", blocks.alias("block")).repartition("conv_id", "block")
    rows = dealt.sortWithinPartitions("conv_id", "block", "position")
    schema = f"conv_id {dict(placed.dtypes)['conv_id']}, {FORMATTED}"
    return rows.mapInArrow(_Render(template, loss_roles, window), schema)


def write_formatted(formatted: DataFrame, path: str) -> None:
    """Stores pieces and masks as Parquet."""
    formatted.write.parquet(path)


class _ReadBack:
    """Turns and masked texts from the formatted pieces alone."""

    def __init__(self, template: InstructTemplate):
        self.template = template

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"n_turns": [], "turns": [], "loss": [], "formatted_chars": []}
            columns = (batch.column(c).to_pylist() for c in ("formatted", "loss_start", "loss_length"))
            for piece, start, length in zip(*columns):
                turns = self.template.read(piece)
                out["n_turns"].append(len(turns))
                out["turns"].append("".join(f"{role}\n{text}\n" for role, text in turns))
                out["loss"].append("" if start is None else self.template.unescape(piece[start : start + length]))
                out["formatted_chars"].append(len(piece))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
            arrays = [pa.array(values, kind) for values, kind in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("position"), *arrays], names=["conv_id", "position", *out])


def read_formatted(spark: SparkSession, path: str, template: InstructTemplate) -> DataFrame:
    """What the stored pieces say: ``n_turns``, the ``turns`` (role, line end, text, line end), the unescaped text under the
    mask and the length of each piece."""
    stored = spark.read.parquet(path)
    schema = f"conv_id {dict(stored.dtypes)['conv_id']}, position long, n_turns long, turns string, loss string, formatted_chars long"
    return stored.select("conv_id", "position", "formatted", "loss_start", "loss_length").mapInArrow(_ReadBack(template), schema)


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(conversation, rows: Iterator[dict]) -> Iterator[dict]:
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n_turns = loss_chars = formatted_chars = 0
    for row in rows:
        turns.update(row["turns"].encode())
        loss.update(row["loss"].encode())
        n_turns += row["n_turns"]
        loss_chars += len(row["loss"])
        formatted_chars += row["formatted_chars"]
    yield {
        "conv_id": conversation,
        "n_turns": n_turns,
        "turns_sha256": turns.hexdigest(),
        "loss_chars": loss_chars,
        "loss_sha256": loss.hexdigest(),
        "formatted_chars": formatted_chars,
    }


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation with digests of all turns and of the masked text.

    A checksum of a whole conversation has to see it in order, so a conversation passes through one task, as a stream.
    """
    return fold_conversations(read, ["position"], _digest, f"conv_id {dict(read.dtypes)['conv_id']}, {DIGEST}")


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
escaped AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|(?:INST|ROLE)\]))', '\1\\\2\3', 'g')) AS n,
         length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|(?:INST|ROLE)\]))', '\1\\\2\3', 'g')) AS n_role
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, md5(text))) AS loss_sha256,
       CAST(3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 19 + n_role END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
