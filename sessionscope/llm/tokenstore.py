"""Token files: one zstandard frame per document under a shared trained dictionary.

A store is a folder with

* ``data/part-*.tok``: the 4 bytes ``TOK1``, the dictionary's SHA-256, then one frame per
  document, each holding the document's ids as little-endian unsigned 32-bit integers;
* ``dictionary.zdict``: the dictionary, trained on serialised id arrays of a sample of at
  most ``SAMPLE_DOCS`` documents and ``SAMPLE_CHARS`` characters of each;
* ``index``: a Parquet table with one row per document: file, place and length of its
  frame, its tokens, the tokens before it in the file, and the dictionary's hash.

Documents lie in ascending order of doc_id (null last; ties by text hash) over the files
in order of ``part``.  One document can be read with one ranged read.  Null texts are
empty, and an empty text still has its end id.  Rows that repeat are stored as often as
they occur.  An empty table makes a store without documents.  Only doc_id and text are
read.  A failed or speculative task leaves a file that no index row names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionscope.llm.common import doc_order, text_of
from sessionscope.llm.files import located, open_input, open_output
from sessionscope.llm.tokens import ID_BYTES, ID_TYPE, WordEncoder

MAGIC = b"TOK1"
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 2048, 64 * 1024
LEVEL = 3
INDEX = (
    "part int, file string, doc_id long, frame_at long, frame_bytes long, "
    "n_tokens long, tokens_before long, dictionary string"
)


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """Raw bytes of the shared dictionary.

    The sample is drawn by text hash, in each of so many slots the smallest: tasks send hashes only, and
    the driver gets one text per slot, however many tasks there are.
    """
    texts = docs.select(F.substring(text_of(docs), 1, SAMPLE_CHARS).alias("text")).where(F.length("text") > 0)
    drawn = texts.withColumn("draw", F.xxhash64("text"))
    slots = drawn.groupBy(F.pmod("draw", F.lit(SAMPLE_DOCS)).alias("slot")).agg(F.min("draw").alias("draw"))
    least = [row.draw for row in slots.collect()]
    sample = drawn.where(F.col("draw").isin(least)).groupBy("draw").agg(F.min("text").alias("text")).orderBy("draw")
    arrays = WordEncoder(tokenizer).encode([row.text for row in sample.collect()])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short samples to train on
        return b"".join(arrays)[:DICTIONARY_BYTES]


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> None:
    """Encodes all of ``docs`` into a new store at ``folder``."""
    folder = located(docs.sparkSession, folder)
    dictionary = train_dictionary(docs, tokenizer)
    with open_output(f"{folder}/dictionary.zdict") as out:
        out.write(dictionary)
    digest = hashlib.sha256(dictionary).digest()
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)
    end = np.array([end_id], dtype=ID_TYPE).tobytes()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.shared(tokenizer)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_prepared(shared.value))
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        out, at, tokens = None, 0, 0
        for batch in batches:
            if out is None:
                out = open_output(f"{folder}/data/{name}")
                out.write(MAGIC + digest)
                at = len(MAGIC) + len(digest)
            rows = {"frame_at": [], "frame_bytes": [], "n_tokens": [], "tokens_before": []}
            for ids in encoder.stream(text.as_py() for text in batch.column("text")):
                frame = compressor.compress(ids + end)
                out.write(frame)
                count = len(ids) // ID_BYTES + 1
                for column, value in zip(rows, (at, len(frame), count, tokens)):
                    rows[column].append(value)
                at += len(frame)
                tokens += count
            n = batch.num_rows
            arrays = [pa.array([part] * n, pa.int32()), pa.array([name] * n), batch.column("doc_id")]
            arrays += [pa.array(values, pa.int64()) for values in rows.values()]
            arrays.append(pa.array([digest.hex()] * n))
            yield pa.RecordBatch.from_arrays(arrays, ["part", "file", "doc_id", *rows, "dictionary"])
        if out is not None:
            out.close()

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    keys = [*doc_order(F.col("doc_id")), F.xxhash64("text")]
    ordered = chosen.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.mapInArrow(store, INDEX).write.parquet(f"{folder}/index")


def _prepared(dictionary: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(dictionary)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with ``start``: all tokens before the document, over all files.

    The running total goes over one row per file.
    """
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = (
        index.groupBy("part")
        .agg(F.sum("n_tokens").alias("tokens"))
        .select("part", F.coalesce(before, F.lit(0)).alias("base"))
    )
    return index.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("tokens_before"))


def read_documents(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """Every document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked, its ids."""
    folder = located(spark, folder)
    with open_input(f"{folder}/dictionary.zdict") as source:
        dictionary = source.read()
    shared, digest = spark.sparkContext.broadcast(dictionary), hashlib.sha256(dictionary).digest()
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decompressor = zstandard.ZstdDecompressor(dict_data=_prepared(shared.value))
        for batch in batches:
            found = np.empty(len(batch), dtype=object)
            for name, rows in batch.reset_index(drop=True).groupby("file"):
                with open_input(f"{folder}/data/{name}") as source:
                    if source.read(len(MAGIC) + len(digest)) != MAGIC + digest:
                        raise ValueError(f"{name} was written with another dictionary")
                    for i, at, size in zip(rows.index, rows["frame_at"], rows["frame_bytes"]):
                        source.seek(int(at))
                        found[i] = decompressor.decompress(source.read(int(size)))
            result = pd.DataFrame({"doc_id": batch["doc_id"].array, "start": batch["start"].array})
            result["n_tokens"] = [len(data) // ID_BYTES for data in found]
            result["ids_crc32"] = [zlib.crc32(data) for data in found]
            if ids:
                result["ids"] = [np.frombuffer(data, dtype=ID_TYPE).astype(np.int64) for data in found]
            yield result

    index = read_index(spark, folder).select(
        "file", "frame_at", "frame_bytes", "start", F.col("doc_id")
    )
    return index.mapInPandas(load, fields)
