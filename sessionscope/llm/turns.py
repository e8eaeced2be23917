"""Conversation turns in order: places within conversations of any length, and folds along them.

A conversation may hold a large share of all rows.  Rows are dealt by ranges of the whole
order, so a long conversation spreads over many tasks; each task numbers its own rows, and
what earlier tasks hold of its first conversation is added afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionscope.llm.common import Scratch

NOTHING = object()


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task, the number of the conversation in it, and the row's number in that."""
    task, piece, at, last = TaskContext.get().partitionId(), -1, 0, NOTHING
    for batch in batches:
        pieces, places = [], []
        for conversation in batch.column("conv_id").to_pylist():
            if piece < 0 or conversation != last:
                piece, at, last = piece + 1, 0, conversation
            pieces.append(piece)
            places.append(at)
            at += 1
        added = [pa.array([task] * len(pieces), pa.int64()), pa.array(pieces, pa.int64()), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays(batch.columns + added, names=batch.schema.names + ["task", "piece", "at"])


def place_turns(frame: DataFrame, scratch: Scratch, blank: str = "") -> DataFrame:
    """``conv_id, turn, role, text, position``, written; positions count from 0 in each conversation.

    Rows follow each other by turn (null first), then role, then digest of the text; null roles and
    texts are ``blank``.  Rows without ``conv_id`` are one conversation.  Repeated rows all stay.
    """
    filled = [F.coalesce(F.col(name).cast("string"), F.lit(blank)).alias(name) for name in ("role", "text")]
    rows = frame.select("conv_id", F.col("turn").cast("long").alias("turn"), *filled)
    # The last key parts equal rows, so that no value fills a range by itself.
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.md5("text"), F.monotonically_increasing_id()]
    keyed = rows.select("*", *[key.alias(f"key{i}") for i, key in enumerate(order[3:])])
    keys = ["conv_id", "turn", "role", "key0", "key1"]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("key0", "key1")
    schema = StructType(list(dealt.schema.fields)).add("task", "long").add("piece", "long").add("at", "long")
    numbered = scratch.write(dealt.mapInArrow(_number, schema), "numbered")

    # One row a task: how long its first and its last conversation are.
    place = F.struct("piece", "at")
    ends = numbered.groupBy("task").agg(
        F.max("piece").alias("last"),
        F.min_by("conv_id", place).alias("head"),
        F.max_by("conv_id", place).alias("tail"),
        (F.max_by("at", place) + 1).alias("n"),
    )
    before, open_conversation, n_open = [], NOTHING, 0
    for row in ends.orderBy("task").collect():
        continued = n_open if row["head"] == open_conversation else 0
        before.append((row["task"], continued))
        n_open = row["n"] + (continued if row["last"] == 0 else 0)
        open_conversation = row["tail"]
    offsets = frame.sparkSession.createDataFrame(before, "task long, before long")
    head = F.when(F.col("piece") == 0, F.col("before")).otherwise(0)
    return numbered.join(F.broadcast(offsets), "task").select("conv_id", "turn", "role", "text", (F.col("at") + head).alias("position"))


def fold_conversations(
    frame: DataFrame, order: list[str], step: Callable, schema: StructType | str, by: tuple[str, ...] = ("conv_id",)
) -> DataFrame:
    """Runs ``step(conversation id, rows)`` along every conversation, rows in the given order.

    ``rows`` is an iterator of dictionaries: a conversation is streamed through, never held.
    ``step`` yields result dictionaries.  With further columns in ``by`` a conversation is dealt
    to several tasks, and a step sees those of its rows that share a task.
    """
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    dealt = frame.repartition(*by).sortWithinPartitions("conv_id", *order)
    return dealt.mapInArrow(_Fold(step, target), target)


class _Fold:
    def __init__(self, step: Callable, schema: StructType):
        self.step, self.schema = step, schema

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        found: list[dict] = []
        for row in self._results(row for batch in batches for part in _parts(batch) for row in part.to_pylist()):
            found.append(row)
            if len(found) == 1024:
                yield pa.RecordBatch.from_pylist(found, schema)
                found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, schema)

    def _results(self, rows: Iterator[dict]) -> Iterator[dict]:
        following = next(rows, None)
        while following is not None:
            current, pending = following["conv_id"], [following]

            def one_conversation():
                nonlocal following
                row = pending.pop()
                while row is not None and row["conv_id"] == current:
                    yield row
                    row = next(rows, None)
                following = row

            conversation = one_conversation()
            yield from self.step(current, conversation)
            for _ in conversation:  # whatever the step left over
                pass


def _parts(batch: pa.RecordBatch, n: int = 512) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, n):
        yield batch.slice(start, n)
