"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from labelled texts: those that occur
in clearly more toxic than clean texts.  Features of a text are densities of lexicon words,
how close they stand to second-person words, capitals, punctuation and obfuscation
(letters mixed with digits or signs; such words are also looked up with the letters they
stand for).  Boosted trees are fitted on part of the labelled sample and calibrated by
isotonic regression on the rest.

Null and empty texts have all features 0 and get the score that follows.  With labels of
one class only, or none, the score is the share of toxic ones (0 without labels).  Equal
texts get equal scores.  Samples are drawn by text hash and bounded by ``Settings``; what is
scored is every whole text.  Labels that are null, and all other columns, are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.common import Scratch, fresh, text_of

# Words that address a reader, in the languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted tus".split()
)
# Signs that stand for letters.
LEET = str.maketrans("013457@$!|*", "oieastasili"[:11])
WORD = re.compile(r"\w[\w@$!|*]*\w|\w")
PREFIXES = (4, 5, 6)
NEAR = 10  # words
FEATURES = (
    "lexicon_words", "lexicon_density", "lexicon_distinct", "lexicon_densest", "second_person_density",
    "second_person_proximity", "capital_share", "capital_words", "punctuation_rate", "exclamation_rate",
    "obfuscation_rate", "obfuscated_lexicon", "words_log",
)


@dataclass(frozen=True)
class Settings:
    """``lexicon_rows`` and ``model_rows`` bound the labelled samples."""

    lexicon_rows: int = 8_000
    model_rows: int = 20_000
    lexicon_terms: int = 1_000
    min_share: float = 0.005  # of the toxic texts that hold a lexicon term
    min_log_odds: float = 3.0
    trees: int = 20
    depth: int = 4
    calibration_share: int = 4  # one part in so many


def _sample(labelled: DataFrame, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, by text hash; all if there are fewer."""
    if total <= rows:
        return labelled
    return labelled.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * rows / total))


def learn_lexicon(labelled: DataFrame, settings: Settings) -> list[str]:
    """Terms by log odds of occurring in a toxic text; each distinct text counts once."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))
    starts = [F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in PREFIXES]
    texts = labelled.dropDuplicates(["text"]).select("toxic", F.array_distinct(F.concat(words, *starts)).alias("terms"))
    totals = texts.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    toxic, clean = totals["toxic"] or 0, totals["n"] - (totals["toxic"] or 0)
    counts = texts.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n")
    )
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    least = max(3, math.ceil(settings.min_share * toxic))
    chosen = counts.where(F.col("t") >= least).withColumn("odds", odds).where(F.col("odds") >= settings.min_log_odds)
    return [row.term for row in chosen.orderBy(F.desc("odds"), "term").limit(settings.lexicon_terms).collect()]


def _character_kinds() -> np.ndarray:
    """Letter (1), capital (2, beside 1), sign (4) for every character below 2**16."""
    kinds = np.zeros(1 << 16, dtype=np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        kinds[code] = c.isalpha() + 2 * c.isupper() + 4 * (not c.isalnum() and not c.isspace())
    return kinds


def character_counts(text: str, kinds: np.ndarray) -> tuple[int, int, int]:
    """Letters, capitals and signs; characters from 2**16 on count as none of them."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.bincount(kinds[codes[codes < len(kinds)]], minlength=8)
    return tuple(int(sum(counts[k] for k in range(8) if k & bit)) for bit in (1, 2, 4))


class Featurizer:
    def __init__(self, lexicon: list[str]):
        self.words = {t for t in lexicon if not t.endswith("*")}
        self.starts = {t[:-1] for t in lexicon if t.endswith("*")}
        self.known: dict[str, tuple[bool, bool, bool]] = {}
        self.kinds = _character_kinds()

    def _in_lexicon(self, word: str) -> bool:
        return word in self.words or any(len(word) > n and word[:n] in self.starts for n in PREFIXES)

    def _look_up(self, word: str) -> tuple[bool, bool, bool]:
        """In the lexicon; only once signs are read as letters; letters mixed with other signs."""
        plain = self._in_lexicon(word)
        mixed = not word.isalpha() and any(c.isalpha() for c in word)
        read = mixed and not plain and self._in_lexicon(word.translate(LEET))
        return plain or read, read, mixed

    def __call__(self, text: str) -> list[float]:
        words = WORD.findall(text)
        if not words:
            return [0.0] * len(FEATURES)
        lower = [w.lower() for w in words]
        if len(self.known) > 300_000:
            self.known.clear()
        for word in set(lower):
            if word not in self.known:
                self.known[word] = self._look_up(word)
        looked = [self.known[w] for w in lower]
        hits = [i for i, (hit, _, _) in enumerate(looked) if hit]
        you = [i for i, w in enumerate(lower) if w in SECOND_PERSON]
        n = len(words)
        letters, capitals, signs = character_counts(text, self.kinds)
        densest, proximity = 0, 0.0
        if hits:
            at = np.array(hits)
            densest = int((np.searchsorted(at, at + NEAR) - np.arange(len(at))).max())
            if you:
                place = np.searchsorted(you, at)
                left = np.abs(at - np.array(you)[np.clip(place - 1, 0, len(you) - 1)])
                right = np.abs(np.array(you)[np.clip(place, 0, len(you) - 1)] - at)
                proximity = float(np.exp(-np.minimum(left, right) / NEAR).mean())
        return [
            float(len(hits)), len(hits) / n, float(len({lower[i] for i in hits})), float(densest), len(you) / n,
            proximity, capitals / max(1, letters), sum(len(w) > 1 and w.isupper() for w in words) / n,
            signs / max(1, len(text)), text.count("!") / n,
            sum(m for _, _, m in looked) / n, float(sum(r for _, r, _ in looked)), math.log1p(n),
        ]


def features(text: Column, lexicon: list[str]) -> Column:
    @F.pandas_udf("array<double>")
    def computed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        featurizer = Featurizer(lexicon)
        for texts in batches:
            yield pd.Series([featurizer(text) for text in texts], dtype=object)

    return computed(text)


@dataclass
class ToxicityModel:
    lexicon: list[str]
    trees: object = None
    calibration: object = None
    constant: float = 0.0

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with a column ``toxicity`` (renamed if taken), 0 to 1."""
        name = fresh(docs, "toxicity")
        if self.trees is None:
            return docs.withColumn(name, F.lit(float(self.constant)))
        held = docs.select(F.struct("*").alias("doc"), features(text_of(docs), self.lexicon).alias("values"))
        raw = self.trees.transform(held.select("doc", array_to_vector("values").alias("features")))
        rated = raw.select("doc", vector_to_array("probability")[1].alias("raw"))
        final = self.calibration.transform(rated)
        value = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
        return final.select(*[F.col("doc")[c].alias(c) for c in docs.columns], value.alias(name))


def fit(labelled: DataFrame, settings: Settings = Settings()) -> ToxicityModel:
    """From ``text`` and ``toxic`` (0 or 1) of labelled rows."""
    rows = labelled.where("toxic IN (0, 1)").select(text_of(labelled).alias("text"), F.col("toxic").cast("int"))
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if toxic in (0, total):
        return ToxicityModel([], constant=toxic / total if total else 0.0)
    lexicon = learn_lexicon(_sample(rows, settings.lexicon_rows, total), settings)
    scratch = Scratch(labelled.sparkSession, "toxicity")
    part = F.pmod(F.xxhash64("text", F.lit(2)), F.lit(settings.calibration_share)).alias("part")
    sample = _sample(rows, settings.model_rows, total)
    table = scratch.write(sample.select("toxic", part, features(F.col("text"), lexicon).alias("values")), "features")
    ready = table.select(F.col("toxic").cast("double").alias("label"), "part", array_to_vector("values").alias("features"))
    held = ready.where("part = 0")
    fitted = ready.where("part > 0")
    if held.select("label").distinct().count() < 2 or fitted.select("label").distinct().count() < 2:
        held = fitted = ready  # too few labels to set some apart
    trees = GBTClassifier(maxIter=settings.trees, maxDepth=settings.depth, seed=5).fit(fitted)
    rated = trees.transform(held).select("label", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(rated)
    return ToxicityModel(lexicon, trees, calibration)
