"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.llm import decontam, langid, linededup, neardup, packing
from sessionscope.llm.common import Scratch
from sessionscope.llm.queries import TOKENIZER


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; texts without letters and ties go."""
    model = langid.fit(docs.select("text", "lang"))
    column = langid.result_column(docs)
    return langid.predict(docs, model).where(F.col(column)["accepted"]).drop(column)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs of 50 words; what is a copy throughout goes."""
    found = linededup.dedup_lines(docs, min_words=50)
    empty = (F.col("n_removed") > 0) & (F.btrim("text", F.lit(linededup.BLANKS)) == "")
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    columns = [
        F.when(F.col("n_removed") > 0, changed[c]).otherwise(F.col("doc")[c]).alias(c) if c in changed else F.col("doc")[c].alias(c)
        for c in docs.columns
    ]
    return found.where(~empty).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group; rows equal in doc_id and text are one document."""
    found = neardup.near_duplicates(docs)
    gone = Scratch(spark, "neardup-gone").write(found.where(~F.col("kept")).select("doc_id", "text_hash"), "gone")
    same = docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["text_hash"]
    )
    return docs.join(gone, same, "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows equal in doc_id and text are one document."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.passages(docs, benchmark).select("doc_id", "h").distinct()
    gone = Scratch(spark, "decontam-gone").write(found, "gone")
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["h"])
    return docs.join(gone, same, "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, in the order of the curve."""
    return packing.pack(docs, TOKENIZER, end_id=0, length=1024)


STAGES = [
    ("language", language),
    ("line_runs", line_runs),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

# Compression, hashing and tokenizers have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage reads what the one before has written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
