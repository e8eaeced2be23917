"""Sequence packing along a space-filling curve.

Each document becomes token ids and a point: its tokens are hashed to a vector, the
vector is projected to ``DIMS`` axes, and the axes are standardised over all documents.
Documents are range-sorted by their Hilbert key, so neighbours on the curve share words,
and the sorted token stream is cut every ``length`` tokens.  What is left at the very
end is cut into powers of two, so no sequence needs padding.

Null texts are empty; an empty text still has its end id.  Equal points are ordered by
doc_id (null last), then by text hash; rows that repeat are packed as often as they
occur.  An empty table gives no pieces.  Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.llm.common import Scratch, doc_order, text_of
from sessionscope.llm.hilbert import hilbert_keys
from sessionscope.llm.tokens import ID_TYPE, WordEncoder

DIMS, BITS = 4, 15
HASHED, SEED = 512, 7
REACH = 4.0  # standard deviations from the mean to the cube's border
STORED = {True: "<u2", False: "<u4"}  # smallest type that holds the ids
ENCODED = "row long, doc_id long, text_hash long, ids binary, n_tokens long, point array<double>"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids array<long>"
)


def projection(vocabulary: int) -> np.ndarray:
    """One row per id: the id's hashed signed unit vector, projected."""
    ids = np.arange(vocabulary, dtype=np.uint64)
    mixed = (ids + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    sign = np.where((mixed >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    axes = np.random.default_rng(SEED).standard_normal((HASHED, DIMS)) / np.sqrt(HASHED)
    return sign[:, None] * axes[(mixed % np.uint64(HASHED)).astype(np.int64)]


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Compressed ids and points; ``row`` is unique, so write the table before reading it twice."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.shared(tokenizer)
        vocabulary = max(len(encoder.n_bytes), end_id + 1)
        table, kind = projection(vocabulary), STORED[vocabulary <= 1 << 16]
        compress = zstandard.ZstdCompressor(level=1).compress
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            stored, counts, points = [], [], []
            for data in encoder.stream(text.as_py() for text in batch.column("text")):
                ids = np.append(np.frombuffer(data, dtype=ID_TYPE), np.uint32(end_id))
                seen, times = np.unique(ids, return_counts=True)
                point = times @ table[seen]
                points.append(point / np.sqrt((times.astype(float) ** 2).sum()))
                stored.append(compress(ids.astype(kind).tobytes()))
                counts.append(len(ids))
            n = batch.num_rows
            rows = pa.array(range(row, row + n), pa.int64())
            row += n
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column("doc_id"), batch.column("text_hash"), pa.array(stored, pa.binary()),
                 pa.array(counts, pa.int64()), pa.array(points, pa.list_(pa.float64()))],
                ["row", "doc_id", "text_hash", "ids", "n_tokens", "point"],
            )

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return chosen.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(encoded, ENCODED)


def curve_keys(encoded: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, n_tokens and the Hilbert key of every document."""
    axis = [F.col("point")[i] for i in range(DIMS)]
    row = encoded.agg(
        F.array(*[F.avg(a) for a in axis]).alias("mean"), F.array(*[F.stddev_pop(a) for a in axis]).alias("spread")
    ).first()
    mean = np.array([v or 0.0 for v in row["mean"]])
    spread = np.array([v or 1.0 for v in row["spread"]])

    @F.pandas_udf("long")
    def key(points: pd.Series) -> pd.Series:
        if not len(points):
            return pd.Series([], dtype="int64")
        scaled = (np.stack(points.to_numpy()) - mean) / spread
        unit = np.clip((scaled + REACH) / (2 * REACH), 0.0, 1.0)
        cells = np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        return pd.Series(hilbert_keys(cells, BITS))

    return encoded.select("row", "doc_id", "text_hash", "n_tokens", key("point").alias("curve"))


def stream_starts(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """row and ``at``: the tokens before the document in the sorted stream.

    Totals are taken inside sorted range partitions; across them the running sum goes
    over one row per partition.
    """
    order = ["curve", *doc_order(F.col("doc_id")), "text_hash", "row"]

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = total + batch["n_tokens"].cumsum()
            yield pd.DataFrame(
                {"part": part, "row": batch["row"], "n_tokens": batch["n_tokens"], "before": ends - batch["n_tokens"]}
            )
            total = int(ends.iloc[-1]) if len(ends) else total

    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    local = scratch.write(ordered.mapInPandas(running, "part int, row long, n_tokens long, before long"), "local")
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        local.groupBy("part")
        .agg(F.sum("n_tokens").alias("tokens"))
        .select("part", F.coalesce(F.sum("tokens").over(past), F.lit(0)).alias("base"))
    )
    return local.join(F.broadcast(bases), "part").select("row", (F.col("base") + F.col("before")).alias("at"))


def tail_lengths(rest: int) -> list[int]:
    """Powers of two, largest first, that add up to ``rest``."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Cutter:
    """Where the sequences of a stream of ``total`` tokens begin."""

    def __init__(self, total: int, length: int):
        self.length, self.full = length, total // length
        self.tail = self.full * length + np.cumsum([0, *tail_lengths(total % length)])

    def pieces(self, at: int, size: int) -> list[tuple[int, int, int, int]]:
        """start in the document, length, sequence, offset there; of a document at ``at``."""
        found, position, end = [], at, at + size
        while position < end:
            if position < self.full * self.length:
                sequence = position // self.length
                first, stop = sequence * self.length, (sequence + 1) * self.length
            else:
                i = int(np.searchsorted(self.tail, position, side="right")) - 1
                sequence, first, stop = self.full + i, int(self.tail[i]), int(self.tail[i + 1])
            cut = min(end, stop)
            found.append((position - at, cut - position, sequence, position - first))
            position = cut
        return found


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, ids: bool = True) -> DataFrame:
    """One row per piece, see ``PIECES``; without ``ids`` only their checksum."""
    scratch = Scratch(docs.sparkSession, "packing")
    encoded = scratch.write(encode(docs, tokenizer, end_id), "encoded")
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    starts = stream_starts(curve_keys(encoded), scratch)
    cutter = Cutter(total, length)
    vocabulary = max(len(WordEncoder(tokenizer).n_bytes), end_id + 1)
    kind = STORED[vocabulary <= 1 << 16]
    names = [field.split()[0] for field in PIECES.split(", ")][: 8 if ids else 7]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for doc_id, data, at in zip(batch["doc_id"].array, batch["ids"], batch["at"]):
                tokens = np.frombuffer(decompress(data), dtype=kind).astype(ID_TYPE)
                for start, size, sequence, offset in cutter.pieces(int(at), len(tokens)):
                    piece = tokens[start : start + size]
                    row = (doc_id, start, size, zlib.crc32(piece.tobytes()), len(tokens), sequence, offset)
                    rows.append((*row, piece.astype(np.int64)) if ids else row)
            yield pd.DataFrame(rows, columns=names)

    joined = encoded.select("row", "doc_id", "ids").join(starts, "row").select("doc_id", "ids", "at")
    fields = ", ".join(PIECES.split(", ")[: len(names)])
    return joined.mapInPandas(cut, fields)
