"""Hard negatives by Kronecker-packed products.

The inner products of integer vectors are taken several candidates at a time: the
components of ``f`` candidates, made non-negative by a bias, lie in separated fields of one
wide integer, so that one multiplication for each component of an anchor serves all of them
and the fields of the sum are their products, read off and unbiased without any loss.
While the fields fit below 2^53 the wide integers are held in doubles, where every product and sum
is an exact integer and matrix multiplication does the work; longer ones are Python integers.

Rows take part if id, label and vector are there and every component is finite.  Vectors are
compared with vectors of their own length only.  Rows that repeat a ``vec_id`` are rows of
their own: an anchor leaves out only its own row.  Scores beyond 64 bits are compared exactly
and returned as null.  Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.llm.common import Scratch

DOUBLE_BITS = 53
LONG_FIELDS = 16  # candidates in one Python integer


@dataclass(frozen=True)
class Mining:
    """``low`` and ``high``: hundredths of the positive's score that a negative may have."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256
    block: int = 8192


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers, or Python integers where they are longer."""
    values = vectors.astype(np.float64)
    if values.size == 0 or np.abs(values).max() * scale < 2.0**62:
        return np.floor(values * scale).astype(np.int64)
    # Doubles from 2^53 on are whole numbers themselves.
    exact = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


class Packed:
    """Candidates side by side in the fields of wide integers, for anchors of components below ``reach``."""

    def __init__(self, rows: np.ndarray, reach: int):
        self.n, self.size = rows.shape
        self.reach = reach
        self.low, high = (int(rows.min()), int(rows.max())) if rows.size else (0, 0)
        largest = max(high - self.low, abs(self.low), abs(high))
        self.width = max((self.size * largest * 2 * reach).bit_length(), 1)
        self.kind = np.float64 if self.width <= DOUBLE_BITS else object
        self.fields = DOUBLE_BITS // self.width if self.kind is np.float64 else LONG_FIELDS
        words = -(-self.n // self.fields)
        biased = (rows if self.kind is np.float64 else rows.astype(object)) - self.low
        filled = np.zeros((words * self.fields, self.size), dtype=self.kind)
        filled[: self.n] = biased
        places = np.array([1 << (self.width * j) for j in range(self.fields)], dtype=self.kind)
        self.words = (filled.reshape(words, self.fields, self.size) * places[None, :, None]).sum(axis=1).T
        self.sums = biased.sum(axis=1)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products, one row for each anchor."""
        if self.size == 0:
            return np.zeros((len(anchors), self.n), dtype=np.int64)
        shifted = (anchors if self.kind is np.float64 else anchors.astype(object)) + self.reach
        total = shifted.astype(self.kind) @ self.words
        if self.kind is np.float64:
            total = total.astype(np.int64)  # whole numbers below 2^53, unchanged
        mask = (1 << self.width) - 1
        fields = np.stack([(total >> (self.width * j)) & mask for j in range(self.fields)], axis=2)
        product = fields.reshape(len(anchors), -1)[:, : self.n]
        bias = self.low * shifted.sum(axis=1)[:, None] - self.reach * self.sums[None, :]
        return product + bias - self.size * self.low * self.reach


def _first(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k best of ``rows`` (in id order), best first, ties to the smaller id."""
    chosen = scores[rows]
    if len(rows) > k and chosen.dtype != object:
        least = np.partition(chosen, len(rows) - k)[len(rows) - k]
        rows = rows[chosen >= least]
        chosen = scores[rows]
    return rows[np.argsort(-chosen, kind="stable")[:k]]


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), values.size // max(len(column), 1))


class _Blocks:
    """Reads a partition in block order, the candidates of a block before its anchors."""

    def __init__(self, mining: Mining, same_label: bool):
        self.mining, self.same_label = mining, same_label

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, ready = None, [], None
        for batch in batches:
            keys = batch.column("block").to_pylist()
            kinds = batch.column("is_anchor").to_pylist()
            start = 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and (keys[end], kinds[end]) == (keys[start], kinds[start]):
                    continue
                piece = batch.slice(start, end - start)
                if keys[start] != block:
                    block, parts, ready = keys[start], [], None
                if not kinds[start]:
                    parts.append(piece)
                elif parts:
                    ready = ready or self._candidates(parts)
                    # Few anchors at a time: their scores against the block stay small.
                    for at in range(0, piece.num_rows, 128):
                        yield self._mined(ready, piece.slice(at, 128))
                start = end

    def _candidates(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks().sort_by([("vec_id", "ascending"), ("row", "ascending")])
        whole_rows = whole(_matrix(table.column("vector").combine_chunks()), self.mining.scale)
        ids, row, label = (table.column(name).to_numpy() for name in ("vec_id", "row", "label"))
        return whole_rows, ids, row, label, {}

    def _mined(self, ready, piece: pa.RecordBatch) -> pa.RecordBatch:
        rows, ids, row, label, packed = ready
        anchors = whole(_matrix(piece.column("vector")), self.mining.scale)
        # Reach is rounded up to a power of two, so that one packing serves nearly all anchors.
        reach = max(int(abs(anchors.min())), int(abs(anchors.max())), 1) if anchors.size else 1
        reach = 1 << reach.bit_length()
        if reach not in packed:
            packed[reach] = Packed(rows, reach)
        scores = packed[reach].scores(anchors)
        out = {name: [] for name in ("anchor_row", "positive_row", "vec_id", "row", "score")}
        own, own_label = piece.column("row").to_pylist(), piece.column("label").to_pylist()
        wanted = piece.column("positives").to_pylist()
        for i in range(len(own)):
            found = self._positives(scores[i], row, own[i]) if self.same_label else self._negatives(scores[i], label, own_label[i], wanted[i])
            for positive, at in found:
                out["anchor_row"].append(own[i])
                out["positive_row"].append(positive)
                out["vec_id"].append(int(ids[at]))
                out["row"].append(int(row[at]))
                out["score"].append(str(int(scores[i][at])))
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([(n, pa.string() if n == "score" else pa.int64()) for n in out]))

    def _positives(self, scores, row, own):
        for at in _first(scores, np.flatnonzero(row != own), self.mining.positives):
            yield None, at

    def _negatives(self, scores, label, own_label, positives):
        low, high = self.mining.low, self.mining.high
        limits = [(int(p["score"]), p["row"]) for p in positives]
        inside = (scores * 100 >= min(low * s for s, _ in limits)) & (scores * 100 <= max(high * s for s, _ in limits))
        rows = np.flatnonzero(inside.astype(bool) & (label != own_label))
        for score, positive in limits:
            hundredfold = scores[rows] * 100
            fits = rows[((hundredfold >= low * score) & (hundredfold <= high * score)).astype(bool)]
            for at in _first(scores, fits, self.mining.negatives):
                yield positive, at


def _exact(score: Column) -> tuple[Column, Column, Column]:
    """Sort keys of a whole number written out, largest first: sign, length, digits."""
    digits = F.regexp_replace(score, "^-", "")
    sign = F.when(score.startswith("-"), -1).otherwise(1)
    padded = F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)
    return sign.desc(), F.when(sign > 0, padded).desc(), F.when(sign < 0, padded).asc()


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(*_exact(F.col("score")), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


FOUND = "anchor_row long, positive_row long, vec_id long, row long, score string"


def _blocked(candidates: DataFrame, anchors: DataFrame, mining: Mining, same_label: bool) -> DataFrame:
    """Every anchor against the blocks it was copied to; only one block is in memory at a time."""
    columns = ["block", "is_anchor", "row", "vec_id", "label", "vector", "positives"]
    no_positives = F.lit(None).cast("array<struct<row:bigint,score:string>>")
    rows = candidates.select(*[F.lit(False).alias(c) if c == "is_anchor" else no_positives.alias(c) if c == "positives" else c for c in columns])
    asked = anchors.select(*[F.lit(True).alias(c) if c == "is_anchor" else F.col(c) for c in columns])
    together = rows.unionByName(asked).repartition("block").sortWithinPartitions("block", "is_anchor")
    return together.mapInArrow(_Blocks(mining, same_label), FOUND)


def _block(parts: Column, *keys: Column) -> Column:
    """A block's name: its keys and one of ``parts`` numbers, drawn by the row."""
    return F.concat_ws(":", *[k.cast("string") for k in keys], F.pmod(F.xxhash64("row"), parts).cast("string"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, mining: Mining = Mining()) -> DataFrame:
    """Negatives that score nearly as high as a positive of the same anchor.

    ``is_anchor`` is over ``vec_id``.  For each anchor row the positives are the first other rows of its label; for
    each positive the negatives are the first rows of other labels whose score lies between
    ``low`` and ``high`` hundredths of the positive's.  First: higher score, then smaller ``vec_id``.
    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hardneg")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    chosen = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("vector"), is_anchor.alias("is_anchor")
    )
    chosen = chosen.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    # Row numbers are fixed by writing them.
    rows = scratch.write(chosen.select("*", F.size("vector").alias("size"), F.monotonically_increasing_id().alias("row")), "rows")
    anchors = rows.where("is_anchor")

    # Positives: only blocks of the anchor's own label and length.
    size = F.lit(mining.block)
    labels = rows.groupBy("label", "size").agg(F.ceil(F.count("*") / size).alias("parts"))
    same = rows.join(labels, ["label", "size"]).withColumn("block", _block(F.col("parts"), F.col("size"), F.col("label")))
    asked = anchors.join(labels, ["label", "size"]).select(
        "row", "vec_id", "label", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "size"
    )
    asked = asked.select(
        "row", "vec_id", "label", "vector", F.concat_ws(":", "size", "label", "part").alias("block"), F.lit(None).cast("array<struct<row:bigint,score:string>>").alias("positives")
    )
    positives = scratch.write(_best(_blocked(same, asked, mining, True), ["anchor_row"], mining.positives), "positives")

    # Negatives: every block of the anchor's length, between the limits its positives set.
    sizes = rows.groupBy("size").agg(F.ceil(F.count("*") / size).alias("parts"))
    limits = positives.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list(F.struct("row", "score")).alias("positives"))
    every = rows.join(F.broadcast(sizes), "size").withColumn("block", _block(F.col("parts"), F.col("size")))
    asked = anchors.join(limits, "row").join(F.broadcast(sizes), "size").select(
        "row", "vec_id", "label", "vector", "positives", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    )
    asked = asked.withColumn("block", F.concat_ws(":", "size", "part"))
    negatives = _best(_blocked(every, asked, mining, False), ["anchor_row", "positive_row"], mining.negatives)

    named = positives.select("anchor_row", F.col("row").alias("positive_row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return (
        negatives.join(named, ["anchor_row", "positive_row"])
        .join(ids, "anchor_row")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("vec_id").alias("negative_id"),
            F.expr("try_cast(positive_score AS bigint)").alias("positive_score"),
            F.expr("try_cast(score AS bigint)").alias("negative_score"),
        )
    )


SQL = """
WITH raw AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM raw a JOIN raw b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id, other) <= 5
),
negatives AS (
  SELECT p.anchor, p.anchor_id, p.other AS positive, p.other_id AS positive_id, p.score AS positive_score,
         n.other_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other_id, n.other) AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
  WHERE 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
"""
