"""Benchmark decontamination by spaced seeds; only DataFrame operations.

A seed is the hash of the words that a fixed mask marks inside a window, so substituted
words at the other places do no harm.  Seeds of all benchmark items meet seeds of all
documents.  A meeting fixes an alignment of item and document; along it, words are compared
one by one.  An item is found in a document if

* at least ``share`` of the item's words match, or
* ``min_words`` or more words match in a stretch of the item in which no two substituted
  words follow each other and at least ``share`` of the words match.

Of any five-word pieces that an item or stretch is cut into, one has at most one substituted
word, since at most a fifth of the words is substituted.  The masks compare four words of
five, each choice of four, so every overlap that the rule accepts shares a seed.  This
holds for shares of 0.8 or more.

Words are runs of letters and digits in lower case.  Items below five words are sought
whole: one word of them is more than a fifth.  Null or wordless texts on either side match nothing.  Equal items are each reported.  Documents that
share a doc_id count as one; rows with null doc_id are reported under null.  Only doc_id
and text, item_id and text are read.  The seeds of the benchmark are broadcast while
they are counted to be at most ``BROADCAST_SEEDS``; otherwise both sides are shuffled by
seed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.common import Scratch

# Places of a window that each mask compares.  The first mask also fits
# a window of four words, where it stands for the places 1 to 4 of the window before.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
SPAN = 1 + max(max(mask) for mask in MASKS)
BROADCAST_SEEDS = 2_000_000


@dataclass(frozen=True)
class Rule:
    min_words: int = 13
    share: float = 0.8

    def __post_init__(self):
        if self.share < 0.8:
            raise ValueError("share must be 0.8 or more: seeds allow one substituted word in five")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seed(hashes: Column, at: Column, number: int, places: tuple) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(hashes, at + p) for p in places])


def _seed_rows(rows: DataFrame, *kept: str) -> DataFrame:
    """One row per window and mask: ``at`` and ``seed`` beside the kept columns.

    ``hashes`` is dropped before rows multiply, so no row carries a whole text.  Windows
    hold the hashes of their words; masks are hashed from them in generated code.
    """
    used = sorted({p for mask in MASKS for p in mask})
    windows = F.transform(
        F.sequence(F.lit(0), F.size("hashes") - SPAN + 1),
        lambda i: F.struct(i.alias("at"), *[F.get("hashes", i + p).alias(f"w{p}") for p in used]),
    )
    placed = rows.where(F.size("hashes") >= SPAN).select(*kept, F.inline(windows))
    # In the last window there is no last word; null meets nothing.
    seeds = [
        F.when(F.col(f"w{max(mask)}").isNotNull(), F.xxhash64(F.lit(n), *[f"w{p}" for p in mask]))
        for n, mask in enumerate(MASKS)
    ]
    return placed.select(*kept, "at", F.explode(F.array(*seeds)).alias("seed"))


def _short_rows(rows: DataFrame, sizes: list[int], *kept: str) -> DataFrame:
    """Seeds over all words of windows of the given sizes, which are below ``SPAN``."""
    made = None
    for size in sizes:
        at = F.sequence(F.lit(0), F.size("hashes") - size)
        seeds = F.transform(
            at, lambda i: F.struct(i.alias("at"), _seed(F.col("hashes"), i, -size, tuple(range(size))).alias("seed"))
        )
        part = rows.where(F.size("hashes") >= size).select(*kept, F.inline(seeds))
        made = part if made is None else made.union(part)
    return made


def contaminated(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, item_id, item_words and the most matching words along one alignment."""
    return passages(docs, benchmark, rule).groupBy("doc_id", "item_id").agg(
        F.max("n").alias("item_words"), F.max(F.size("places")).alias("matches")
    )


def passages(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Accepted alignments: doc_id, h (the text's xxhash64), item_id, n, shift, places and breaks."""
    scratch = Scratch(docs.sparkSession, "decontam")
    items = benchmark.select("item_id", word_hashes(benchmark["text"]).alias("hashes")).where(F.size("hashes") > 0)
    items = scratch.write(items.withColumn("n", F.size("hashes")), "items")
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), word_hashes(docs["text"]).alias("hashes"))
    # At most SPAN - 1 distinct sizes.
    sizes = [row.n for row in items.where(F.col("n") < SPAN).select("n").distinct().orderBy("n").collect()]
    test, train = _seed_rows(items, "item_id", "n"), _seed_rows(texts, "doc_id", "h")
    if sizes:
        whole = items.select("item_id", "n", F.lit(0).alias("at"), _whole_seed(sizes).alias("seed"))
        test = test.union(whole.where(F.col("n") < SPAN))
        train = train.union(_short_rows(texts, sizes, "doc_id", "h"))
    test = scratch.write(test.withColumnRenamed("at", "item_at"), "seeds")
    if test.count() <= BROADCAST_SEEDS:
        test = F.broadcast(test)
    hits = train.join(test, "seed").select("doc_id", "h", "item_id", "n", (F.col("at") - F.col("item_at")).alias("shift"))
    per_doc = hits.distinct().groupBy("doc_id", "h").agg(F.collect_list(F.struct("item_id", "n", "shift")).alias("hits"))
    found = scratch.write(per_doc, "hits")

    same = texts["doc_id"].eqNullSafe(found["doc_id"]) & (texts["h"] == found["h"])
    parts = F.transform(
        "hits",
        lambda c: F.struct(
            c["item_id"].alias("item_id"),
            c["shift"].alias("shift"),
            F.slice("hashes", F.greatest(c["shift"], F.lit(0)) + 1, c["n"] + F.least(c["shift"], F.lit(0))).alias("part"),
        ),
    )
    aligned = texts.join(found.select("doc_id", "h", "hits"), same).select(texts["doc_id"], texts["h"], F.inline(parts))
    paired = aligned.join(items.select("item_id", "n", F.col("hashes").alias("own")), aligned["item_id"].eqNullSafe(items["item_id"]))
    lead = F.greatest(-F.col("shift"), F.lit(0))
    matching = F.filter(
        F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.get(F.col("own"), j) == F.get(F.col("part"), j - lead)
    )
    # A stretch goes on over one substituted word; breaks are matches two or more behind.
    places = paired.select("doc_id", "h", aligned["item_id"], "n", "shift", matching.alias("places"))
    breaks = F.filter(
        F.sequence(F.lit(0), F.size("places") - 1),
        lambda i: (i == 0) | (F.get(F.col("places"), i) - F.get(F.col("places"), i - 1) > 2),
    )
    cut = places.where(F.size("places") > 0).withColumn("breaks", breaks)

    def stretch(i: Column, k: Column) -> Column:
        last = F.coalesce(F.get(F.col("breaks"), k + 1), F.size("places")) - 1
        length = F.get(F.col("places"), last) - F.get(F.col("places"), i) + 1
        count = last - i + 1
        return (count >= rule.min_words) & (count >= rule.share * length)

    long_enough = F.exists(F.transform("breaks", stretch), lambda good: good)
    return cut.where((F.size("places") >= rule.share * F.col("n")) | long_enough)


def _whole_seed(sizes: list[int]) -> Column:
    chosen = F.lit(None).cast("long")
    for size in sizes:
        seed = _seed(F.col("hashes"), F.lit(0), -size, tuple(range(size)))
        chosen = F.when(F.col("n") == size, seed).otherwise(chosen)
    return chosen


# The SQL check keeps the masks it was written with, so it is a check on what they reach only.
SQL_MASKS = ((0, 1, 2, 4, 7, 9), (0, 2, 3, 6, 7, 8), (0, 1, 4, 5, 6, 9))
SQL_SPAN = 10


def _sql_seed(places: tuple) -> str:
    return " || ' ' || ".join(f"w[p0 + {p + 1}]" for p in places)


SQL = f"""
WITH texts AS (
    SELECT doc_id, row_number() OVER () AS r,
           list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
items AS (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
    FROM benchmark),
item_at AS (SELECT item_id, w, unnest(range(0, len(w) - {SQL_SPAN - 1})) AS p0 FROM items WHERE len(w) >= {SQL_SPAN}),
text_at AS (SELECT doc_id, r, w, unnest(range(0, len(w) - {SQL_SPAN - 1})) AS p0 FROM texts WHERE len(w) >= {SQL_SPAN}),
test AS ({" UNION ALL ".join(f"SELECT item_id, p0, {n} AS m, {_sql_seed(mask)} AS seed FROM item_at" for n, mask in enumerate(SQL_MASKS))}),
train AS ({" UNION ALL ".join(f"SELECT doc_id, r, p0, {n} AS m, {_sql_seed(mask)} AS seed FROM text_at" for n, mask in enumerate(SQL_MASKS))}),
hits AS (SELECT DISTINCT doc_id, r, item_id, train.p0 - test.p0 AS shift FROM train JOIN test USING (m, seed)),
matching AS (
    SELECT h.doc_id, h.r, h.item_id, h.shift, len(i.w) AS n, j
    FROM hits h JOIN items i USING (item_id) JOIN texts t ON t.r = h.r,
         unnest(range(0, len(i.w))) AS u(j)
    WHERE j + h.shift >= 0 AND j + h.shift < len(t.w) AND i.w[j + 1] = t.w[j + h.shift + 1]),
gaps AS (
    SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY r, item_id, shift ORDER BY j) <= 2 THEN 0 ELSE 1 END AS opens
    FROM matching),
stretches AS (
    SELECT *, sum(opens) OVER (PARTITION BY r, item_id, shift ORDER BY j) AS stretch FROM gaps),
counted AS (
    SELECT doc_id, r, item_id, shift, n, stretch, count(*) AS c, max(j) - min(j) + 1 AS l
    FROM stretches GROUP BY ALL),
judged AS (
    SELECT doc_id, item_id, n, sum(c) AS total, bool_or(c >= 13 AND c >= 0.8 * l) AS long_enough
    FROM counted GROUP BY doc_id, r, item_id, shift, n)
SELECT doc_id, item_id, CAST(max(n) AS INTEGER) AS item_words, CAST(max(total) AS INTEGER) AS matches
FROM judged WHERE total >= 0.8 * n OR long_enough GROUP BY doc_id, item_id
"""
