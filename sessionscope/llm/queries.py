"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.llm import chat, decontam, hardneg, langid, licenses, linededup, neardup, packing, permindex, repair, tokenstore, toxicity, warc
from sessionscope.llm.common import Scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, parts: int):
    """Remainder of the id's checksum; a null id has the checksum of an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = held_out(docs["doc_id"], 3)
    model = langid.fit(docs.where(fold != 1).select("text", "lang"))
    chosen = docs.select("doc_id", "text", (fold == 1).alias("held_out"))
    return langid.predict(chosen, model).select("doc_id", "held_out", "langid.*")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "archive").path
    warc.archive_pages(_table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return warc.read_records(spark, folder).drop("url")


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(_table(spark, sf_dir, "documents"), min_words=50)
    return found.select("doc.doc_id", "n_lines", "n_removed", "text")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Scratch(spark, "tokenstore").path
    tokenstore.write_store(_table(spark, sf_dir, "documents"), store, TOKENIZER, end_id=2)
    return tokenstore.read_documents(spark, store, ids=False)


def op7_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER, end_id=0, length=1024, ids=False)


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return permindex.nearest_neighbours(vectors, vectors["vec_id"] % 20 == 0, k=20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    learned = labels.where(held_out(labels["doc_id"], 5) != 0).select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text").join(learned, "doc_id"))
    out = held_out(docs["doc_id"], 5) == 0
    scored = model.score(docs.select("doc_id", "text", out.alias("held_out")))
    return scored.select(
        "doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"), neardup.Limits(words=2, percent=80))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_digests(conversations, repair.repair_conversations(repair.damaged(conversations)))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(conversations.dtypes)
    said = "</s>[INST] ok [/INST]"
    two = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id int, turn int, role string, text string")
    both = conversations.unionByName(two.select(*[F.col(name).cast(kind) for name, kind in kinds.items()]))
    template, folder = chat.InstructTemplate(), f"{Scratch(spark, 'formatted').path}/pieces"
    chat.write_formatted(chat.format_conversations(both, template), folder)
    return chat.digests(chat.read_formatted(spark, folder, template))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(vectors["vec_id"] % 7 == 0, (vectors["label"] + 1) % 10).otherwise(vectors["label"])
    return hardneg.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def build_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


SQL: dict[str, str] = {
    "op3_decontamination": decontam.SQL,
    "op5_line_runs": linededup.SQL,
    "op11_conversation_repair": repair.SQL,
    "op12_chat_format": chat.SQL,
    "op13_hard_negatives": hardneg.SQL,
}
