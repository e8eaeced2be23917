"""Near-duplicate groups by HyperMinHash.

A document's shingle hashes fall into ``REGISTERS`` ranges.  A register keeps, of the
smallest hash in its range, the number of leading zeros and ``MANTISSA`` bits after the
first one: 16 bits where MinHash keeps 64.  A set of 512 hashes or more is cut into 288
ranges; a smaller one would leave most of them empty, so it is hashed again, half the
ranges and twice the hash functions for each halving (``LAYOUTS``).  A set that may be
linked with one of the next layout has registers of that layout, too.

Registers are banded; a band key is the hash of its registers, and a band without a
shingle has none.  At a similarity of 0.8 two sets share none of the bands with a chance of
at most (1 - 0.8**6)**48, 5e-7; registers that stay empty lower it.

Work is on classes of documents with equal sets, so copies cost nothing.  Candidates are
estimated from the registers, corrected for registers that agree by chance, and dropped
only five deviations below the limit; the rest are confirmed on the full sets.

1. Each member of a bucket is held against the bucket's smallest class: a row each,
   however large the bucket is.
2. Components are formed.  Members of large buckets that still hold several of them are
   dealt again by longer keys, two such buckets each, whose groups are more alike; each member is held
   against a member of each of its groups drawn by hash, and components are merged
   (``ROUNDS``).  This leaves few outsiders.
3. In buckets that then hold several components every pair across components is a
   candidate.  Small buckets are joined.  In large ones the outsiders, members without the
   bucket's most frequent component, meet all others block by block inside tasks, which give
   out lists of the pairs that the registers find plausible; the full sets of two blocks then
   meet in a task that confirms its lists.  Members of one component never meet.
4. Confirmed pairs join the links and components are formed again.

So no candidate that could change a component stays untested, and no group's pairs are all
listed.  A set's documents share a component.  Null and wordless texts have no shingles
and are linked with nothing.  A null doc_id sorts last: it is never a component's id
unless the component has no other.  Rows that repeat a doc_id are separate documents in
one component if their texts are linked.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.common import Scratch, text_of
from sessionscope.llm.components import components
from sessionscope.llm.shingles import mix, shingle_set

REGISTERS, PER_BAND, MANTISSA = 288, 6, 10
BANDS = REGISTERS // PER_BAND
EMPTY = 0xFFFF
# Hash functions for sets from 4, 8, 16 ... 512 hashes on; the rest of the registers are ranges.
LAYOUTS = {2: 288, 3: 96, 4: 32, 5: 16, 6: 8, 7: 4, 8: 2, 9: 1}
_SEEDS = np.concatenate([[np.uint64(0)], mix(np.arange(2000, 2000 + REGISTERS - 1, dtype=np.uint64))])
_WEIGHTS = mix(np.arange(1, PER_BAND + 1, dtype=np.uint64))
_BAND_SEEDS = mix(np.arange(1000, 1000 + BANDS, dtype=np.uint64))
BLOCK = 256  # members of a bucket compared at once
BLOCK_HASHES = 1 << 20  # shingles of these members, about
SMALL = 16  # members of a bucket whose pairs are joined
ROUNDS = ((1, 7, 19), (3, 11, 23))  # how far apart the two bands of a longer key are

SKETCH = (
    "row long, doc_id long, text_hash long, n_shingles long, set_key binary, "
    "layout int, registers binary, upper binary, bands array<long>, upper_bands array<long>"
)


@dataclass(frozen=True)
class Limits:
    words: int = 5
    percent: int = 80

    def __post_init__(self) -> None:
        if not 50 <= self.percent <= 100:
            raise ValueError("percent must lie between 50 and 100: a set has registers for two layouts at most")


def layout_of(n: int) -> int:
    """The layout of a set of n hashes: the power of two below, between 2 and 9."""
    return min(max(int(n).bit_length() - 1, 2), 9)


def registers(hashes: np.ndarray, layout: int) -> np.ndarray:
    """Leading zeros and mantissa of the smallest hash in each range of each function, in 16 bits."""
    functions = LAYOUTS[layout]
    ranges = REGISTERS // functions
    step = np.uint64(((1 << 64) - 1) // ranges + (ranges > 1))
    values = hashes[None, :] if functions == 1 else mix(hashes[None, :] ^ _SEEDS[:functions, None])
    at = np.minimum(values // step, np.uint64(ranges - 1))
    place = (at.astype(np.int64) + ranges * np.arange(functions)[:, None]).ravel()
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    np.minimum.at(least, place, (values - at * step).ravel())
    filled = np.zeros(REGISTERS, dtype=bool)
    filled[place] = True
    fraction, exponent = np.frexp(least[filled].astype(np.float64) + 1.0)
    zeros = np.clip(65 - exponent, 0, 62)
    mantissa = ((fraction - 0.5) * (2 << MANTISSA)).astype(np.int64)
    result = np.full(REGISTERS, EMPTY, dtype=np.uint16)
    result[filled] = (zeros.astype(np.int64) << MANTISSA) | mantissa
    return result


def band_keys(values: np.ndarray, layout: int) -> np.ndarray:
    """A key for each band that is not empty; its last six bits are the band's number."""
    bands = values.reshape(BANDS, PER_BAND)
    used = (bands != EMPTY).any(axis=1)
    keys = mix((bands.astype(np.uint64) * _WEIGHTS).sum(axis=1) ^ (_BAND_SEEDS + np.uint64(layout)))
    keys = (keys & ~np.uint64(63)) | np.arange(BANDS, dtype=np.uint64)
    return keys[used].astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of register rows, and the number of registers it rests on.

    Registers of different hashes agree with a chance of about
    ``2**-MANTISSA / (2 ln 2) * n_a n_b / (n_a + n_b)**2``.
    """
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    equal = ((a == b) & (a != EMPTY)).sum(axis=-1)
    chance = 2.0**-MANTISSA / (2 * np.log(2)) * n_a * n_b / (n_a + n_b).astype(float) ** 2
    share = equal / np.maximum(used, 1)
    return (share - chance) / (1 - chance), np.maximum(used, 1)


def plausible(a, b, n_a, n_b, percent: int) -> np.ndarray:
    """Whether full sets must be compared: sizes allow it and the estimate is not far below."""
    similarity, used = estimate(a, b, n_a, n_b)
    limit = percent / 100
    # The deviation of a share of registers at the limit, and one register for few of them.
    slack = 5 * np.sqrt(limit * (1 - limit) / used) + 1 / used
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sizes & (similarity >= limit - slack)


def common_bands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which bands two register rows share, for broadcast rows."""
    equal = (a == b).reshape(*np.broadcast_shapes(a.shape, b.shape)[:-1], BANDS, PER_BAND).all(axis=-1)
    return equal & (np.broadcast_to(a, np.broadcast_shapes(a.shape, b.shape)).reshape(equal.shape + (PER_BAND,)) != EMPTY).any(axis=-1)


def sketch(docs: DataFrame, limits: Limits) -> DataFrame:
    """Set size, set key, registers and band keys; ``row`` is unique once written."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), limits.words)
                own, top = layout_of(len(found)), layout_of(len(found) * 100 // limits.percent)
                values = registers(found, own)
                upper = registers(found, top) if top > own else None
                rows.append((
                    len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), own, values.tobytes(),
                    None if upper is None else upper.tobytes(), band_keys(values, own),
                    None if upper is None else band_keys(upper, top),
                ))
            n = batch.num_rows
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + n), pa.int64()), batch.column("doc_id"), batch.column("text_hash"),
                 *(pa.array(list(values), kind) for values, kind in zip(columns, kinds))],
                ["row", "doc_id", "text_hash", "n_shingles", "set_key", "layout", "registers", "upper", "bands", "upper_bands"],
            )
            row += n

    return _hashed_docs(docs).mapInArrow(sketched, SKETCH)


def _hashed_docs(docs: DataFrame) -> DataFrame:
    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return chosen.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _estimated(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose registers leave a similarity at the limit possible."""

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        left, right = (np.frombuffer(b"".join(s), dtype=np.uint16).reshape(-1, REGISTERS) for s in (a, b))
        return pd.Series(plausible(left, right, n_a.to_numpy(), n_b.to_numpy(), percent))

    def side(row: str, end: str) -> DataFrame:
        return sketches.select(
            F.col("row").alias(row), *(F.col(c).alias(c + end) for c in ("layout", "registers", "upper", "n_shingles"))
        )

    def common(own: str, other: str):
        """Registers of the larger of both layouts."""
        upper = F.coalesce("upper" + own, "registers" + own)
        return F.when(F.col("layout" + own) < F.col("layout" + other), upper).otherwise(F.col("registers" + own))

    both = pairs.join(side("u", "_u"), "u").join(side("v", "_v"), "v").where(_sizes("n_shingles_u", "n_shingles_v", percent))
    return both.where(likely(common("_u", "_v"), common("_v", "_u"), "n_shingles_u", "n_shingles_v")).select("u", "v")


def _sizes(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _sets(rows: DataFrame, sketches: DataFrame, docs: DataFrame, limits: Limits) -> DataFrame:
    """row, hashes: the full set of each of ``rows`` (row)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text.as_py(), limits.words).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.binary())], ["row", "hashes"])

    places = sketches.join(rows, "row", "left_semi").select("row", "doc_id", "text_hash")
    texts = _hashed_docs(docs)
    same = texts["doc_id"].eqNullSafe(places["doc_id"]) & (texts["text_hash"] == places["text_hash"])
    return texts.join(places, same).select("row", "text").mapInArrow(sets, "row long, hashes binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, limits: Limits) -> DataFrame:
    """The pairs (u, v) whose full sets (row, hashes) reach the limit."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        result = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            result.append(100 * common >= limits.percent * (len(x) + len(y) - common))
        return pd.Series(result, dtype=bool)

    u = sets.select(F.col("row").alias("u"), F.col("hashes").alias("hu"))
    v = sets.select(F.col("row").alias("v"), F.col("hashes").alias("hv"))
    return pairs.join(u, "u").join(v, "v").where(linked("hu", "hv")).select("u", "v")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("row")).union(pairs.select(F.col("v").alias("row"))).distinct()


def _long_keys(bands: str, strides: tuple[int, ...]):
    """Hashes of two bands each, whose numbers are as far apart as ``strides`` say."""

    def keys(band, stride: int):
        wanted = (band.bitwiseAND(F.lit(63)) + stride) % BANDS
        partners = F.filter(bands, lambda other: other.bitwiseAND(F.lit(63)) == wanted)
        return F.transform(partners, lambda other: F.xxhash64(band, other))

    return F.flatten(F.transform(bands, lambda band: F.concat(*(keys(band, stride) for stride in strides))))


def _merge_by_long_keys(
    open_rows: DataFrame, rows: DataFrame, chosen: DataFrame, sets: DataFrame, limits: Limits, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) found in groups of longer keys, and ``rows`` (row, root) with merged roots.

    Rows with different roots that share a longer key share both of its buckets, so both are open:
    a row has longer keys of the bands of its large open buckets only (``open_rows``: row, band, above).
    """
    own = [F.collect_set(F.when(F.col("above") == above, F.col("band"))).alias(name) for name, above in (("bands", False), ("upper_bands", True))]
    keyed = scratch.write(open_rows.groupBy("row").agg(*own), "keyed")
    chosen = scratch.write(chosen.join(rows.select("row"), "row", "left_semi"), "close")
    links = rows.select(F.col("row").alias("u"), F.col("row").alias("v")).where("false")
    for turn, strides in enumerate(ROUNDS):
        keys = F.concat(_long_keys("bands", strides), _long_keys("upper_bands", strides))
        member = scratch.write(
            keyed.select("row", F.explode(F.array_distinct(keys)).alias("key")).join(rows, "row"), f"long-{turn}"
        )
        drawn = F.min_by(F.struct("row", "root"), F.xxhash64("row", F.lit(turn))).alias("centre")
        lo, hi = F.min("root").alias("lo"), F.max("root").alias("hi")
        centres = member.groupBy("key").agg(drawn, lo, hi).where("lo != hi").select("key", "centre")
        stars = (
            member.join(centres, "key")
            .where(F.col("root") != F.col("centre.root"))
            .select(F.greatest("row", "centre.row").alias("u"), F.least("row", "centre.row").alias("v"))
            .distinct()
        )
        likely = scratch.write(_estimated(stars, chosen, limits.percent), f"long-likely-{turn}")
        found = scratch.write(_confirmed(likely, sets, limits), f"long-links-{turn}")
        links = links.union(found)
        ends = [rows.select(F.col("row").alias(end), F.col("root").alias(f"root_{end}")) for end in "uv"]
        between = found.join(ends[0], "u").join(ends[1], "v").select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))
        merged = components(between, scratch, f"long-roots-{turn}").select(F.col("node").alias("root"), F.col("root").alias("new"))
        rows = scratch.write(
            rows.join(merged, "root", "left").select("row", F.coalesce("new", "root").alias("root")), f"rows-{turn}"
        )
        scratch.drop(f"long-{turn}", f"long-likely-{turn}")
    scratch.drop("keyed", "close")
    return links, rows


def _block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Lists (us, vs) of plausible pairs across components inside large buckets.

    The outsiders of a bucket and its other members become blocks of about BLOCK rows, more
    if sets are large; a block of outsiders meets every other block, two at a time in a
    task.  A row's home is a block, too, of all rows on the same side of the same component in
    their largest bucket, so that all lists between two homes become one and are confirmed together.
    """

    def blocks(rows, total):
        """A power of two, so that homes do not depend on small differences of size."""
        wanted = F.greatest(rows / BLOCK, total / BLOCK_HASHES, F.lit(1.0))
        return F.pow(F.lit(2.0), F.ceil(F.log2(wanted))).cast("int")

    def place(bucket):
        outside = bucket["main"] != F.col("root")
        inner, outer = blocks(bucket["size"] - bucket["n_out"], bucket["total"] - bucket["total_out"]), blocks(bucket["n_out"], bucket["total_out"])
        # Blocks of outsiders are numbered first.
        own = F.when(outside, F.pmod(F.xxhash64("row"), outer)).otherwise(outer + F.pmod(F.xxhash64("row"), inner)).cast("int")
        names = {
            "size": bucket["size"], "band": bucket["band"], "own": own, "outer": outer, "inner": inner,
            "above": bucket["above"], "main": bucket["main"], "outside": outside,
        }
        return F.struct(*(c.alias(n) for n, c in names.items()))

    placed = members.withColumn("places", F.transform("buckets", place)).drop("buckets")
    top = F.array_max("places")
    placed = placed.withColumn("main", top["main"]).withColumn("outside", top["outside"])
    homes = placed.groupBy("main", "outside").agg(blocks(F.count("*"), F.sum("n_shingles")).alias("homes"))
    placed = placed.join(homes, ["main", "outside"])
    placed = placed.withColumn("home", F.xxhash64("main", "outside", F.pmod(F.xxhash64("row"), "homes")))
    placed = placed.withColumn("place", F.explode("places"))
    own_registers = F.when(F.col("place.above"), F.col("upper")).otherwise(F.col("registers"))
    member = F.struct("row", "root", "n_shingles", "home", own_registers.alias("registers"))
    packed = placed.groupBy("place.band", "place.own", "place.outer", "place.inner").agg(F.collect_list(member).alias("members"))
    last = F.when(F.col("own") < F.col("outer"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1
    keyed = packed.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        "band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "members"
    )

    def columns(group: pd.DataFrame, own: int) -> tuple[np.ndarray, ...]:
        found = [m for block in group.loc[group["own"] == own, "members"] for m in block]
        numbers = [(m["row"], m["root"], m["n_shingles"], m["home"]) for m in found]
        data = np.frombuffer(b"".join(m["registers"] for m in found), dtype=np.uint16)
        return *np.array(numbers, dtype=np.int64).reshape(-1, 4).T, data.reshape(-1, REGISTERS)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        low, high, band = (int(group[c].iloc[0]) for c in ("low", "high", "band"))
        rows, roots, sizes, homes, regs = columns(group, high)
        found = [np.zeros((0, 4), dtype=np.int64)]
        for row, root, n, home, own in zip(*columns(group, low)):
            fit = np.flatnonzero(roots != root)
            fit = fit[plausible(own[None, :], regs[fit], np.full(len(fit), n), sizes[fit], percent)]
            # A pair counts in the first of the buckets that hold both.
            fit = fit[common_bands(own[None, :], regs[fit]).argmax(axis=1) == band & 63]
            fit = fit[rows[fit] < row] if low == high else fit
            pairs = np.stack([np.full(len(fit), home), homes[fit], np.full(len(fit), row), rows[fit]], axis=1)
            turned = pairs[:, 0] > pairs[:, 1]
            pairs[turned] = pairs[turned][:, [1, 0, 3, 2]]
            found.append(pairs)
        pairs = pd.DataFrame(np.concatenate(found), columns=["home_u", "home_v", "us", "vs"])
        if not len(pairs):
            return pairs.astype({"us": object, "vs": object})
        return pairs.groupby(["home_u", "home_v"]).agg(list).reset_index()

    kind = "home_u long, home_v long, us array<long>, vs array<long>"
    found = keyed.groupBy("band", "low", "high").applyInPandas(compare, kind)
    # At most the pairs of two homes, whose size is that of a block.
    return found.groupBy("home_u", "home_v").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("us", "vs")))


def _block_links(lists: DataFrame, sets: DataFrame, limits: Limits) -> DataFrame:
    """The listed pairs whose full sets reach the limit; a set travels once for each pair of homes."""
    homes = F.col("home_u").alias("at_u"), F.col("home_v").alias("at_v")
    needed = lists.select(*homes, F.explode(F.array_union("us", "vs")).alias("row")).distinct()
    sets = needed.join(sets, "row")

    def confirm(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        parts = [np.frombuffer(h, dtype=np.uint64) for h in sets["hashes"]]
        sizes = np.array([len(p) for p in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        values, words = np.unique(np.concatenate(parts), return_inverse=True)
        at = pd.Series(np.arange(len(parts)), index=sets["row"].to_numpy())
        us, vs = (at.loc[np.concatenate(pairs[c].to_numpy())].to_numpy() for c in ("us", "vs"))
        order = np.lexsort((vs, us))
        us, vs = us[order], vs[order]
        mark, found = np.zeros(len(values), dtype=bool), []
        for group in np.split(np.arange(len(us)), np.flatnonzero(np.diff(us)) + 1):
            u = us[group[0]]
            own = words[starts[u] : starts[u + 1]]
            mark[own] = True
            for v in np.unique(vs[group]):
                common = np.count_nonzero(mark[words[starts[v] : starts[v + 1]]])
                if 100 * common >= limits.percent * (sizes[u] + sizes[v] - common):
                    found.append((u, v))
            mark[own] = False
        rows = at.index.to_numpy()[np.array(found, dtype=np.int64).reshape(-1, 2)]
        return pd.DataFrame({"u": rows.max(axis=1), "v": rows.min(axis=1)})

    return lists.groupBy("home_u", "home_v").cogroup(sets.groupBy("at_u", "at_v")).applyInPandas(confirm, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "neardup")
    sketches = scratch.write(sketch(docs, limits), "sketches")
    filled = sketches.where("n_shingles > 0")
    classes = scratch.write(
        filled.groupBy("set_key").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id")), "classes"
    )
    heads = sketches.join(classes.select("row"), "row", "left_semi")
    own = heads.select("row", "n_shingles", F.lit(False).alias("above"), F.explode("bands").alias("band"))
    above = heads.select("row", "n_shingles", F.lit(True).alias("above"), F.explode("upper_bands").alias("band"))
    bands = scratch.write(own.union(above), "bands")
    buckets = bands.groupBy("band").agg(F.min("row").alias("first"), F.count("*").alias("size"), F.sum("n_shingles").alias("total")).where("size > 1")
    # Only buckets with company go on.
    shared = scratch.write(bands.join(buckets, "band"), "shared")
    scratch.drop("bands")
    # Registers of the classes that share a bucket; nothing else is compared.
    company = shared.select("row").distinct()
    chosen = scratch.write(
        sketches.drop("set_key", "bands", "upper_bands").join(company, "row", "left_semi"), "company"
    )
    stars = shared.where("row != first").select(F.col("row").alias("u"), F.col("first").alias("v")).distinct()
    likely = scratch.write(_estimated(stars, chosen, limits.percent), "likely")
    # Rows that repeat both id and text give a set twice.
    sets = scratch.write(_sets(_ends(likely), chosen, docs, limits), "sets").dropDuplicates(["row"])
    links = scratch.write(_confirmed(likely, sets, limits), "links")
    scratch.drop("sets")
    roots = components(links, scratch, "first")

    # Buckets that still hold several components: test across them.
    member = shared.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn(
        "root", F.coalesce("root", "row")
    )
    open_bands = member.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    unresolved = scratch.write(
        member.join(open_bands.select("band"), "band", "left_semi").drop("first"), "unresolved"
    )
    scratch.drop("shared")
    late_sets = _sets(unresolved.select("row").distinct(), chosen, docs, limits)
    late_sets = scratch.write(late_sets, "late-sets").dropDuplicates(["row"])
    crowded = unresolved.where(F.col("size") > SMALL)
    rows = scratch.write(crowded.select("row", "root").distinct(), "rows")
    merged, rows = _merge_by_long_keys(crowded.select("row", "band", "above"), rows, chosen, late_sets, limits, scratch)

    small = unresolved.where(F.col("size") <= SMALL)
    other = small.select("band", F.col("row").alias("v"), F.col("root").alias("root_v"), F.col("n_shingles").alias("n_v"))
    across = (
        small.join(other, "band")
        .where((F.col("root") != F.col("root_v")) & (F.col("row") > F.col("v")))
        .where(_sizes("n_shingles", "n_v", limits.percent))
        .select(F.col("row").alias("u"), "v")
    )
    tested = likely.select("u", "v")
    more = scratch.write(_estimated(across.distinct().join(tested, ["u", "v"], "left_anti"), chosen, limits.percent), "more")
    late = _confirmed(more, late_sets, limits)

    wide = scratch.write(crowded.drop("root").join(rows, "row"), "wide")
    counts = wide.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("own"))
    inside = F.max(F.struct("n", "root", "own"))
    mains = counts.groupBy("band").agg(inside.alias("most"), F.sum("n").alias("all"), F.sum("own").alias("hashes"))
    mains = mains.where(F.col("all") > F.col("most.n")).select(
        "band",
        F.col("most.root").alias("main"),
        (F.col("all") - F.col("most.n")).alias("n_out"),
        (F.col("hashes") - F.col("most.own")).alias("total_out"),
    )
    bucket = F.struct("band", "size", "total", "above", "main", "n_out", "total_out")
    large = wide.join(mains, "band").groupBy("row", "root", "n_shingles").agg(F.collect_list(bucket).alias("buckets"))
    large = scratch.write(large.join(chosen.select("row", "registers", "upper"), "row"), "large")
    lists = scratch.write(_block_pairs(large, limits.percent), "lists")
    late = late.union(merged).union(_block_links(lists, late_sets, limits))
    all_links = scratch.write(links.union(late), "all-links")
    scratch.drop("lists", "late-sets", "unresolved", "wide", "large")
    final = components(all_links, scratch, "final")

    rooted = classes.join(final.withColumnRenamed("node", "row"), "row", "left").withColumn(
        "root", F.coalesce("root", "row")
    )
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    owners = rooted.join(ids, "root").select("set_key", "component_id")
    owned = sketches.select("doc_id", "text_hash", "n_shingles", "set_key").join(owners, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return owned.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
