"""Language ID by compression: the dictionary that shortens a text most names its language.

Each language's dictionary is a raw-content zstandard dictionary: excerpts of its
labelled texts, strung together.  A text is lower-cased, everything but letters becomes
one space, and it is compressed in blocks, since a long text compressed in one go
becomes its own dictionary and the languages draw level.

Null and letterless texts are ``und`` with score 0.  Equal sizes go to the first
language by name.  Repeated rows get equal results.  With no labelled row every text is
``und``.  The prediction reads the text only; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "lang_pred string, score double, margin double, accepted boolean"


@dataclass(frozen=True)
class Settings:
    """``slots`` excerpts of at most ``excerpt`` letters bound the sample of a language."""

    slots: int = 160
    excerpt: int = 1000
    dictionary_bytes: int = 128 * 1024
    block_bytes: int = 1024
    level: int = 6
    spread: float = 0.05  # relative size difference that divides the odds by e
    min_margin: float = 0.001  # of the runner-up's size; below it a text is rejected


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def fit(labelled: DataFrame, settings: Settings = Settings()) -> dict[str, bytes]:
    """Dictionary bytes per language, from ``text`` and ``lang`` of labelled rows.

    Rows are drawn by hash: per language and slot the row with the smallest one, so the
    sample's size depends on ``settings`` and the number of languages only.
    """
    rows = labelled.where(F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"),
        F.xxhash64(F.col("text")).alias("draw"),
        F.substring(letters_only(F.col("text")), 1, settings.excerpt).alias("excerpt"),
    )
    slot = F.pmod(F.col("draw"), F.lit(settings.slots)).alias("slot")
    picked = (
        rows.where(F.length(F.trim("excerpt")) > 0)
        .groupBy("lang", slot)
        .agg(F.min(F.struct("draw", "excerpt")).alias("pick"))
        .select("lang", "slot", "pick.excerpt")
    )
    parts: dict[str, list] = {}
    for lang, slot_number, excerpt in picked.collect():
        parts.setdefault(lang, []).append((slot_number, excerpt))
    return {
        lang: " ".join(text for _, text in sorted(found)).encode()[: settings.dictionary_bytes]
        for lang, found in sorted(parts.items())
    }


class _Sizes:
    """Compressed sizes of one text under every dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], settings: Settings):
        self.block = settings.block_bytes
        self.compressors = []
        for content in dictionaries.values():
            prepared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            prepared.precompute_compress(level=settings.level)
            self.compressors.append(
                zstandard.ZstdCompressor(
                    level=settings.level, dict_data=prepared, write_content_size=False, write_dict_id=False
                )
            )

    def __call__(self, data: bytes) -> list[int]:
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]


def decide(sizes: list[int], langs: list[str], settings: Settings) -> tuple[str, float, float, bool]:
    order = np.argsort(sizes, kind="stable")
    best = sizes[order[0]]
    others = np.array([sizes[i] for i in order[1:]], dtype=float)
    margin = float((others[0] - best) / others[0]) if len(others) else 1.0
    score = 1.0 / (1.0 + float(np.exp(-(others - best) / (best * settings.spread)).sum()))
    return langs[order[0]], score, margin, margin >= settings.min_margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings()) -> DataFrame:
    """``docs`` with a struct column ``langid`` (renamed if taken), see ``RESULT``."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    langs = list(dictionaries)

    @F.pandas_udf(RESULT)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sizes = _Sizes(shared.value, settings)
        for texts in batches:
            rows = []
            for text in texts:
                data = text.strip().encode() if text else b""
                if data and langs:
                    rows.append(decide(sizes(b" " + data + b" "), langs, settings))
                else:
                    rows.append(("und", 0.0, 0.0, False))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "margin", "accepted"])

    return docs.withColumn(result_column(docs), scored(letters_only(docs["text"])))


def result_column(docs: DataFrame) -> str:
    from sessionscope.llm.common import fresh

    return fresh(docs, "langid")
