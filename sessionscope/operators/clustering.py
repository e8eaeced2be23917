"""K-Means over weighted points: every (k, start) pair advances in the same pass.

Users with equal features are one point with a weight.  A pass reads the points once,
brings each task's sums per centre together, and returns a row per centre and pair: what reaches the
driver depends on the number of centres only.  Starts are drawn by k-means++ from digests of user ids,
so the same table gives the same centres on any cluster, and SQL can follow every step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A prime modulus and a multiplier of full period: draws of a point differ by start and step.
PRIME = 2**31 - 1
MULTIPLIER = 48271
STEPS = 64
RACE, SETTLED = 1e-4, 1e-9
DISTANCE_DIGITS = 9

Centres = np.ndarray  # one row per centre


def factor(start: int, step: int) -> int:
    return pow(MULTIPLIER, 1 + STEPS * start + step, PRIME)


def weighted_points(rows: DataFrame, features: tuple[str, ...], id_column: str, seed: int) -> DataFrame:
    """``x, n, first, draw``: distinct feature vectors, how many rows each stands for, and their smallest id."""
    x = F.array(*[F.col(name).cast("double") for name in features]).alias("x")
    points = rows.groupBy(x).agg(F.count("*").alias("n"), F.min(id_column).alias("first"))
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("first").cast("string"))), 1, 12)
    return points.withColumn("draw", F.conv(digest, 16, 10).cast("long") % (PRIME - 1) + 1)


class _Scaled:
    """Reads points batch by batch, standardised."""

    def __init__(self, means: np.ndarray, stds: np.ndarray):
        self.means, self.stds = means, np.where(stds > 0, stds, 1.0)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                values = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                yield (values - self.means) / self.stds, part.column("n").to_numpy().astype(float), part


def squared_distances(x: np.ndarray, centres: Centres) -> np.ndarray:
    """Rounded, so that points midway between two centres, frequent among counts and flags, always go to the first."""
    return np.stack([((x - centre) ** 2).sum(axis=1) for centre in centres], axis=1).round(DISTANCE_DIGITS)


@dataclass
class _Draw:
    """For each start, the point with the earliest arrival: a race weighted by n times the squared distance."""

    scaled: _Scaled
    centres: list[Centres]
    step: int

    SCHEMA = "start int, score double, first string, x array<double>"

    def __call__(self, batches):
        best: dict[int, tuple] = {}
        for x, n, part in self.scaled.blocks(batches):
            draw, first = part.column("draw").to_numpy(), part.column("first").cast(pa.string())
            for start, centres in enumerate(self.centres):
                far = squared_distances(x, centres).min(axis=1) if len(centres) else np.ones(len(x))
                uniform = (draw * factor(start, self.step)) % PRIME / PRIME
                with np.errstate(divide="ignore"):
                    score = np.where(far > 0, -np.log(uniform) / (n * far), np.inf)
                for i in np.flatnonzero(score == score.min()):
                    found = (float(score[i]), first[int(i)].as_py(), x[i].tolist())
                    if np.isfinite(score[i]) and (start not in best or found < best[start]):
                        best[start] = found
        if best:
            rows = [{"start": s, "score": b[0], "first": b[1], "x": b[2]} for s, b in best.items()]
            schema = pa.schema([("start", pa.int32()), ("score", pa.float64()), ("first", pa.string()), ("x", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class _Moments:
    """Per pair and centre: weight, sums of coordinates, sum of squared norms, squared distance to the centre."""

    scaled: _Scaled
    pairs: list[Centres]

    SCHEMA = "pair int, centre int, sums array<double>"

    def __call__(self, batches):
        totals: dict[int, np.ndarray] = {}
        for x, n, _ in self.scaled.blocks(batches):
            columns = np.column_stack([np.ones(len(x)), x, (x**2).sum(axis=1)])
            for pair, centres in enumerate(self.pairs):
                apart = squared_distances(x, centres)
                nearest = apart.argmin(axis=1)
                weighted = np.column_stack([columns, apart[np.arange(len(x)), nearest]]) * n[:, None]
                found = np.stack([np.bincount(nearest, weights=w, minlength=len(centres)) for w in weighted.T], axis=1)
                totals[pair] = totals.get(pair, 0) + found
        rows = [{"pair": p, "centre": c, "sums": sums.tolist()} for p, t in totals.items() for c, sums in enumerate(t) if sums[0] > 0]
        if rows:
            schema = pa.schema([("pair", pa.int32()), ("centre", pa.int32()), ("sums", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class _Silhouettes:
    """Per pair and centre: the sum of its points' silhouettes, squared Euclidean."""

    scaled: _Scaled
    pairs: list[tuple[Centres, np.ndarray]]  # centres and moments of the pairs

    def __call__(self, batches):
        totals: dict[int, np.ndarray] = {}
        for x, n, _ in self.scaled.blocks(batches):
            norms = (x**2).sum(axis=1)
            for pair, (centres, moments) in enumerate(self.pairs):
                sizes = moments[:, 0]
                nearest = squared_distances(x, centres).argmin(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    apart = norms[:, None] + moments[:, -2] / sizes - 2 * x @ (moments[:, 1:-2] / sizes[:, None]).T
                    apart = np.where(sizes > 0, np.maximum(apart, 0.0), np.inf)
                    own = apart[np.arange(len(x)), nearest] * sizes[nearest] / (sizes[nearest] - 1)
                    apart[np.arange(len(x)), nearest] = np.inf
                    other = apart.min(axis=1)
                    score = np.where((sizes[nearest] > 1) & (np.maximum(own, other) > 0), (other - own) / np.maximum(own, other), 0.0)
                found = np.bincount(nearest, weights=score * n, minlength=len(centres))
                totals[pair] = totals.get(pair, 0) + found
        rows = [{"pair": p, "centre": c, "sums": [float(s)]} for p, t in totals.items() for c, s in enumerate(t)]
        if rows:
            schema = pa.schema([("pair", pa.int32()), ("centre", pa.int32()), ("sums", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Fit:
    """Centres on the standardised scale, their moments, the cost, and silhouettes (null for a single segment)."""

    centres: Centres
    moments: np.ndarray
    cost: float
    silhouette: float | None = None
    silhouettes: list[float] | None = None


class Points:
    """Standardised weighted points, kept in memory between passes; closes by ``with``."""

    def __init__(self, points: DataFrame, means: list[float], stds: list[float]):
        self.table = points
        self.scaled = _Scaled(np.array(means), np.array(stds))

    def __enter__(self) -> "Points":
        self.table.persist()
        return self

    def __exit__(self, *_):
        self.table.unpersist()

    def starts(self, starts: int, k: int) -> list[Centres]:
        """``k`` centres for each start, fewer if there are fewer points."""
        found: list[list] = [[] for _ in range(starts)]
        for step in range(k):
            drawn = self.table.mapInArrow(_Draw(self.scaled, [np.array(c) for c in found], step), _Draw.SCHEMA)
            best = drawn.groupBy("start").agg(F.min(F.struct("score", "first", "x")).alias("best"))
            for row in best.collect():
                found[row["start"]].append(row["best"]["x"])
        return [np.array(c) for c in found]

    def _sums(self, step, pairs: int, width: int) -> list[dict[int, np.ndarray]]:
        rows = self.table.mapInArrow(step, _Moments.SCHEMA)
        total = F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)])
        found: list[dict[int, np.ndarray]] = [{} for _ in range(pairs)]
        for row in rows.groupBy("pair", "centre").agg(total.alias("sums")).collect():
            found[row["pair"]][row["centre"]] = np.array(row["sums"])
        return found

    def moments(self, pairs: list[Centres]) -> list[np.ndarray]:
        width = pairs[0].shape[1] + 3
        found = self._sums(_Moments(self.scaled, pairs), len(pairs), width)
        return [np.stack([sums.get(c, np.zeros(width)) for c in range(len(centres))]) for sums, centres in zip(found, pairs)]

    def fit(self, starts: list[Centres], max_iter: int, tolerance: float) -> list[Fit]:
        """Moves all centres to the means of their points until none would move further than ``tolerance``.

        A centre without points stays where it is.
        """
        fits = [Fit(centres, np.empty(0), float("inf")) for centres in starts]
        moving = list(range(len(fits)))
        for _ in range(max_iter + 1):
            again = []
            for i, moments in zip(moving, self.moments([fits[i].centres for i in moving])):
                fit, weights = fits[i], moments[:, :1]
                means = np.where(weights > 0, moments[:, 1:-2] / np.maximum(weights, 1), fit.centres)
                far = np.sqrt(((means - fit.centres) ** 2).sum(axis=1)).max() > tolerance
                # The moments stay those of the centres that they were taken with.
                fits[i] = Fit(means if far else fit.centres, moments, float(moments[:, -1].sum()))
                again += [i] if far else []
            moving = again
            if not moving:
                break
        return fits

    def score(self, fits: list[Fit]) -> None:
        """Adds silhouettes, from one more pass and the moments of the fits."""
        scored = [f for f in fits if (f.moments[:, 0] > 0).sum() > 1]
        if not scored:
            return
        sums = self._sums(_Silhouettes(self.scaled, [(f.centres, f.moments) for f in scored]), len(scored), 1)
        for fit, found in zip(scored, sums):
            by_centre = np.array([found.get(c, np.zeros(1))[0] for c in range(len(fit.centres))])
            fit.silhouette = float(by_centre.sum() / fit.moments[:, 0].sum())
            fit.silhouettes = (by_centre / np.maximum(fit.moments[:, 0], 1)).tolist()


def best_of(fits: list[Fit]) -> Fit:
    """The lowest cost to six digits; equal costs go to the earliest start."""
    return min(fits, key=lambda fit: round(fit.cost, 6))


def best_fits(points: Points, ks: list[int], starts: int, max_iter: int) -> dict[int, Fit]:
    """For every k the best of its starts, with silhouettes; all pairs share the passes.

    The starts of a smaller k are the first centres of a larger one.  Starts are compared once they
    move by less than ``RACE``; the winners go on until every centre is the mean of its points.
    """
    drawn = points.starts(starts, max(ks))
    fits = points.fit([centres[:k] for k in ks for centres in drawn], max_iter, RACE)
    winners = [best_of(fits[i * starts : (i + 1) * starts]) for i in range(len(ks))]
    final = points.fit([fit.centres for fit in winners], max_iter, SETTLED)
    points.score(final)
    return dict(zip(ks, final))
