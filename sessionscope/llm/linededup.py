"""Repeated line runs by prefix doubling over line sequences.

Only DataFrame operations.  A document is a sequence of lines; a line keeps the blank
lines after it and is compared without outer white space.  A run of lines that holds at
least ``min_words`` words and occurred before (in ascending doc_id, then text hash, then
place) is deleted; the first occurrence stays.

Prefix doubling names every suffix by its first 1, 2, 4, ... lines.  The name is the
place of the first suffix with these lines, so names are exact and need no numbering,
and suffixes with one name are an LCP interval of that depth.  A suffix whose lines
occur once is in no interval and drops out, so the tables shrink with each doubling.
The interval of any depth l in between is named by the two overlapping doubled names that
cover l lines.  Every maximal repeated run is the union of the shortest runs of
``min_words`` words that begin or end at each of its lines; those have at most
``min_words`` lines, which bounds the doublings.  Such a run goes if its interval's
first suffix is another one.

Null texts stay null with no lines, empty ones empty.  Rows equal in doc_id and text
are one document and get the same result.  A null doc_id sorts last.  Only doc_id and
text are read.  Copies group before anything is joined, and joins put the many
members of a group on the side that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.llm.common import Scratch

BLANKS = " \t\r\n"
LAST = (1 << 63) - 1
PLACE = ("d", "h", "pos")


def _units(text: Column) -> Column:
    """Lines with the line ends and blank lines that follow them."""
    return F.split(text, r"(?<=\n)(?=[ \t\r]*[^ \t\r\n])")


def _bare(unit: Column) -> Column:
    return F.btrim(unit, F.lit(BLANKS))


def _keys(docs: DataFrame) -> list[Column]:
    return [
        F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("d"),
        F.xxhash64(docs["text"]).alias("h"),
    ]


def _place() -> Column:
    return F.struct(*PLACE)


def lines(docs: DataFrame) -> DataFrame:
    """d, h, pos, words and digest of every line that is not blank."""
    exploded = docs.select(*_keys(docs), F.posexplode(_units(docs["text"])).alias("pos", "unit"))
    bare = exploded.select("d", "h", "pos", _bare(F.col("unit")).alias("line")).where("line != ''")
    return bare.select(
        "d", "h", "pos", F.size(F.split("line", r"\s+")).alias("words"), F.md5("line").alias("digest")
    )


def _repeated(rows: DataFrame, *names: str) -> DataFrame:
    """The groups that occur at several places, with the first place as ``name``."""
    places = rows.groupBy(*names).agg(F.min(_place()).alias("name"), F.max(_place()).alias("last"))
    return places.where("name != last").drop("last")


def _doubled(level: DataFrame, step: int) -> DataFrame:
    """Names of twice as many lines: pairs of a name and the name ``step`` lines on."""
    ahead = Window.partitionBy("d", "h").orderBy("pos").rangeBetween(step, step)
    pairs = level.withColumn("next", F.first("name").over(ahead)).where(F.col("next").isNotNull())
    pairs = pairs.select(*PLACE, F.col("name").alias("one"), F.col("next").alias("two"))
    return pairs.join(_repeated(pairs, "one", "two"), ["one", "two"]).select(*PLACE, "name")


def _reach(words: Column, enough: int) -> Column:
    """How many leading entries add up to ``enough``; null if all do not."""
    state = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))

    def add(s: Column, w: Column) -> Column:
        open_ = s["sum"] < enough
        return F.struct(
            F.when(open_, s["sum"] + w).otherwise(s["sum"]).alias("sum"),
            F.when(open_, s["n"] + 1).otherwise(s["n"]).alias("n"),
        )

    done = F.aggregate(words, state, add)
    return F.when(done["sum"] >= enough, done["n"])


def _shortest_runs(repeated: DataFrame, min_words: int) -> DataFrame:
    """d, h, pos, size of the shortest runs of enough words from and up to each line."""
    by_place = Window.partitionBy("d", "h").orderBy("pos")
    stretch = repeated.withColumn("stretch", F.col("pos") - F.row_number().over(by_place))
    here = Window.partitionBy("d", "h", "stretch").orderBy("pos")
    ahead = F.collect_list("words").over(here.rowsBetween(0, min_words - 1))
    behind = F.reverse(F.collect_list("words").over(here.rowsBetween(1 - min_words, 0)))
    sized = stretch.select(*PLACE, _reach(ahead, min_words).alias("on"), _reach(behind, min_words).alias("back"))
    begins = sized.where(F.col("on").isNotNull()).select("d", "h", "pos", F.col("on").alias("size"))
    ends = sized.where(F.col("back").isNotNull()).select(
        "d", "h", (F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("size")
    )
    return begins.union(ends).distinct()


def deleted_ranges(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """d, h and the sorted, disjoint line ranges (begin, stop) of later copies."""
    table = scratch.write(lines(docs), "lines")
    named = table.join(_repeated(table, "digest"), "digest")
    base = scratch.write(named.select(*PLACE, "words", "name").dropDuplicates(list(PLACE)), "names-0")
    scratch.drop("lines")
    runs = scratch.write(_shortest_runs(base, min_words), "runs")
    longest = runs.agg(F.max("size")).first()[0] or 0
    level, levels, step, doublings = base.select(*PLACE, "name"), [], 1, 0
    while step <= longest:
        levels.append(level.withColumn("level", F.lit(doublings)))
        doublings += 1
        if 2 * step > longest:
            break
        level = scratch.write(_doubled(level, step), f"names-{doublings}")
        step *= 2
    if not levels:
        levels = [level.withColumn("level", F.lit(0))]
    names = levels[0]
    for more in levels[1:]:
        names = names.union(more)

    # A run of l lines is named by the doubled names of its first and last 2**level lines.
    level_of = F.length(F.bin("size")) - 1
    leveled = runs.withColumn("level", level_of).withColumn(
        "tail", F.col("pos") + F.col("size") - F.pow(F.lit(2), F.col("level")).cast("int")
    )
    first = names.withColumnRenamed("name", "one")
    second = names.select("level", "d", "h", F.col("pos").alias("tail"), F.col("name").alias("two"))
    classed = leveled.join(first, ["level", "d", "h", "pos"]).join(second, ["level", "d", "h", "tail"])
    classed = scratch.write(classed.select(*PLACE, "size", "one", "two"), "classed")
    copies = classed.join(_repeated(classed, "size", "one", "two"), ["size", "one", "two"]).where(
        _place() != F.col("name")
    )
    # Overlapping ranges become one.
    order = Window.partitionBy("d", "h").orderBy("pos", "size")
    stop = F.col("pos") + F.col("size")
    reached = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = copies.select("d", "h", "pos", "size", F.when(F.col("pos") <= reached, 0).otherwise(1).alias("opens"))
    merged = opened.withColumn("range", F.sum("opens").over(order)).groupBy("d", "h", "range")
    ranges = merged.agg(F.min("pos").alias("begin"), F.max(stop).alias("stop"))
    return ranges.groupBy("d", "h").agg(F.sort_array(F.collect_list(F.struct("begin", "stop"))).alias("ranges"))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Every row of ``docs`` with its columns as a struct ``doc``, and n_lines, n_removed and text.

    ``text`` is what is left; ``doc.text`` is the input.
    """
    scratch = Scratch(docs.sparkSession, "linededup")
    ranges = scratch.write(deleted_ranges(docs, min_words, scratch), "ranges")
    keyed = docs.select(*_keys(docs), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    # Texts are shuffled at every size, so that needs grow in proportion.
    joined = keyed.join(ranges.hint("merge"), ["d", "h"], "left")

    def gone(i: Column) -> Column:
        return F.exists("ranges", lambda r: (i >= r["begin"]) & (i < r["stop"]))

    units = _units(F.col("doc.text"))
    kept = F.when(F.col("ranges").isNull(), F.col("doc.text")).otherwise(
        F.array_join(F.filter(units, lambda unit, i: ~gone(i)), "")
    )
    blank_head = F.when(_bare(F.element_at(units, 1)) == "", 1).otherwise(0)
    removed = F.aggregate("ranges", F.lit(0), lambda n, r: n + r["stop"] - r["begin"])
    return joined.select(
        "doc",
        F.coalesce(F.size(units) - blank_head, F.lit(0)).alias("n_lines"),
        F.coalesce(removed, F.lit(0)).alias("n_removed"),
        kept.alias("text"),
    )


SQL = """
WITH given AS (
    SELECT row_number() OVER () AS r, doc_id, text FROM documents),
split AS (
    SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS p0,
           len(string_split(text, chr(10))) AS n FROM given WHERE text IS NOT NULL),
units AS (
    SELECT r, doc_id, p0, line || CASE WHEN p0 < n THEN chr(10) ELSE '' END AS line,
           trim(line, ' ' || chr(9) || chr(13)) AS bare,
           sum(CASE WHEN trim(line, ' ' || chr(9) || chr(13)) = '' THEN 0 ELSE 1 END)
               OVER (PARTITION BY r ORDER BY p0) AS u FROM split),
seq AS (
    SELECT r, doc_id, u, bare, len(string_split_regex(bare, '\\s+')) AS words FROM units WHERE bare <> ''),
diagonals AS (
    SELECT b.r, b.u, b.words, a.r AS r0, b.u - a.u AS diagonal
    FROM seq a JOIN seq b ON a.bare = b.bare AND (a.doc_id, a.u) < (b.doc_id, b.u)),
stretches AS (
    SELECT *, u - row_number() OVER (PARTITION BY r, r0, diagonal ORDER BY u) AS stretch FROM diagonals),
runs AS (
    SELECT r, min(u) AS lo, max(u) AS hi FROM stretches
    GROUP BY r, r0, diagonal, stretch HAVING sum(words) >= 50),
flagged AS (
    SELECT units.*, EXISTS (SELECT 1 FROM runs WHERE runs.r = units.r AND units.u BETWEEN lo AND hi) AS gone
    FROM units),
rebuilt AS (
    SELECT r, count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (bare <> '' AND gone) AS n_removed,
           coalesce(string_agg(line, '' ORDER BY p0) FILTER (NOT gone), '') AS text
    FROM flagged GROUP BY r)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines,
       CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed, rebuilt.text
FROM given LEFT JOIN rebuilt USING (r)
"""
