"""User features, K-Means segments and persona names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.rates import ratio, round_columns
from sessionscope.labels import ENGAGED, LOYAL, ONE_TIME, WINDOW
from sessionscope.operators.clustering import DISTANCE_DIGITS, Fit, Points, best_fits, weighted_points
from sessionscope.operators.quality import first_drawn, sample_cut, within_cut
from sessionscope.schema import DEVICES
from sessionscope.sources.scratch import Stored

# The clustering inputs, in order.
FEATURES = (
    "total_sessions",
    "conversion_rate",
    "revenue_per_session",
    "avg_steps",
    "days_active",
    "device_mobile",
    "device_desktop",
)


def primary_device(sessions: DataFrame) -> DataFrame:
    """The device a user came with most often; ties go to the first name.

    Sessions collapse to one row per user and device before the choice.
    """
    counts = (
        sessions.where(F.col("device").isNotNull() & F.col("user_id").isNotNull())
        .groupBy("user_id", "device")
        .agg(F.count("*").alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("device").alias("name")))
    return (
        counts.groupBy("user_id")
        .agg(best.alias("best"))
        .select(
            "user_id",
            F.col("best.name").alias("primary_device"),
            (-F.col("best.rank")).alias("device_sessions"),
        )
    )


def device_values(sessions: DataFrame, at_most: int = 100) -> tuple[str, ...]:
    """The fixed devices, then all others that occur, by name: one small aggregation.

    A table with more than ``at_most`` devices has no sensible one-hot, and says so.
    """
    seen = sessions.where(F.col("device").isNotNull()).select("device").distinct().limit(at_most + 1).collect()
    if len(seen) > at_most:
        raise ValueError(f"More than {at_most} devices: name those to encode.")
    return (*DEVICES, *sorted({row["device"] for row in seen} - set(DEVICES)))


def user_features(sessions: DataFrame, devices: tuple[str, ...] | None = DEVICES) -> DataFrame:
    """One row per user, from a single shuffle on ``user_id``.

    One column ``device_...`` per value in ``devices``, whether it occurs or not; with ``None`` the fixed
    ones and every other device of the table (``device_values``).

    The day set and the device counts of a user are bounded by the calendar
    and the device list and are combined before the shuffle.
    """
    devices = device_values(sessions) if devices is None else devices
    users = (
        sessions.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            F.count("*").alias("total_sessions"),
            F.sum("converted").alias("total_conversions"),
            F.sum("revenue").alias("total_revenue"),
            F.avg("steps_completed").alias("avg_steps"),
            F.avg("page_load_ms").alias("avg_page_load_ms"),
            F.size(F.collect_set("date")).cast("bigint").alias("days_active"),
            F.mode("device", True).alias("primary_device"),
        )
    )
    n = F.col("total_sessions")
    return users.withColumns(
        {
            "conversion_rate": ratio(F.col("total_conversions"), n),
            "revenue_per_session": ratio(F.col("total_revenue"), n),
        }
        | {
            f"device_{name}": F.when(F.col("primary_device") == name, 1).otherwise(0)
            for name in devices
        }
    )


def _filled() -> list[Column]:
    return [_filled_column(name).alias(name) for name in FEATURES]


def _scale_row(filled: DataFrame) -> DataFrame:
    return filled.agg(
        *[F.avg(name).alias(f"_mean_{name}") for name in FEATURES],
        *[F.stddev_pop(name).alias(f"_std_{name}") for name in FEATURES],
    )


def _filled_column(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _scaled(value: Column, mean: Column, std: Column) -> Column:
    """Zero mean, unit population spread; a constant feature stays at zero."""
    return (value - mean) / F.when(std > 0, std).otherwise(1.0)


def scaled_features(features: DataFrame) -> DataFrame:
    """The clustering inputs, standardised with population deviations.

    The statistics are one row, so attaching them broadcasts one row.
    """
    filled = features.select("user_id", *_filled())
    joined = filled.crossJoin(F.broadcast(_scale_row(filled)))
    return joined.select(
        "user_id",
        *[
            _scaled(F.col(name), F.col(f"_mean_{name}"), F.col(f"_std_{name}")).alias(name)
            for name in FEATURES
        ],
    )


def segment_profile(labelled: DataFrame) -> DataFrame:
    """Size and means per segment."""
    return labelled.groupBy("segment_id").agg(
        F.count("*").alias("count"),
        F.avg("total_sessions").alias("avg_sessions"),
        F.avg("conversion_rate").alias("avg_cr"),
        F.avg("revenue_per_session").alias("avg_revenue"),
        F.avg("days_active").alias("avg_days_active"),
    )


def persona_rules(profile: DataFrame) -> DataFrame:
    """Names each segment by the first rule that fits; names may repeat."""
    # The thresholds.
    cr, revenue, visits = F.col("avg_cr"), F.col("avg_revenue"), F.col("avg_sessions")
    name = (
        F.when((cr > 0.06) & (revenue > 60), LOYAL)
        .when((cr > 0.03) & (visits > 3), ENGAGED)
        .when((cr < 0.01) & (visits < 2), ONE_TIME)
        .otherwise(WINDOW)
    )
    return profile.withColumn("segment_name", name)


# --- clustering ---------------------------------------------------------

# Features are rounded to so many digits before points are counted: sums of the same
# revenue in another order are the same point.
FEATURE_DIGITS = 9


def training_users(sessions: DataFrame, max_users: int | None, seed: int = 42) -> DataFrame:
    """Features of ``min(max_users, users)`` seeded users, or of all with ``None``.

    The cut is taken on user ids, so sessions of other users drop out before
    the feature aggregation.
    """
    if max_users is None:
        return user_features(sessions)
    known = sessions.where(F.col("user_id").isNotNull())
    ids = known.select("user_id").distinct()
    cut = sample_cut(ids, max_users, "user_id", seed)
    drawn = first_drawn(user_features(within_cut(known, cut, "user_id", seed)), max_users, "user_id", seed)
    # The limit leaves one partition; fitting needs many.
    return drawn.repartition("user_id")


def _point_columns() -> list[Column]:
    return [F.round(_filled_column(name), FEATURE_DIGITS).alias(name) for name in FEATURES]


class SegmentModel:
    """Standardisation constants and centres, in the order of their segment ids.

    Segments are numbered by their centres (conversion rate, then sessions), so that numbers do
    not depend on the start.  ``silhouette`` is the mean over users, squared Euclidean, and
    ``silhouettes`` the means by segment; null with fewer than two segments.
    """

    def __init__(self, means: list[float], stds: list[float], fit: Fit):
        keys = FEATURES.index("conversion_rate"), FEATURES.index("total_sessions")
        order = sorted(range(len(fit.centres)), key=lambda i: tuple(round(float(fit.centres[i][k]), 6) for k in keys))
        self.means, self.stds = means, stds
        self.centres = [[float(v) for v in fit.centres[i]] for i in order]
        self.cost, self.silhouette = fit.cost, fit.silhouette
        self.silhouettes = fit.silhouettes and [fit.silhouettes[i] for i in order]

    def scaled(self) -> list[Column]:
        """The standardised inputs over user features."""
        constants = zip(_point_columns(), self.means, self.stds)
        return [_scaled(value, F.lit(mean), F.lit(std)) for value, mean, std in constants]

    def label(self, features: DataFrame, coordinates: bool = False) -> DataFrame:
        """``features`` with ``segment_id``, the nearest centre; row by row, no shuffle.

        ``coordinates`` adds each standardised input (``x_...``), its centre (``centre_...``) and the squared distance.
        """
        centres = F.array(*[F.array(*[F.lit(v) for v in centre]) for centre in self.centres])

        def apart(centre: Column) -> Column:
            squares = F.zip_with("_x", centre, lambda a, b: (a - b) * (a - b))
            return F.round(F.aggregate(squares, F.lit(0.0), lambda total, square: total + square), DISTANCE_DIGITS)

        placed = features.withColumn("_x", F.array(*self.scaled()))
        placed = placed.withColumn("_apart", F.transform(centres, apart))
        nearest = F.array_position("_apart", F.array_min("_apart")).cast("int") - 1
        found = placed.withColumn("segment_id", nearest)
        if not coordinates:
            return found.drop("_x", "_apart")
        named = {f"x_{name}": F.get("_x", F.lit(i)) for i, name in enumerate(FEATURES)}
        named["squared_distance"] = F.array_min("_apart")
        rows = [(i, *centre) for i, centre in enumerate(self.centres)]
        schema = ", ".join(["segment_id int", *[f"centre_{name} double" for name in FEATURES]])
        own = features.sparkSession.createDataFrame(rows, schema)
        return found.withColumns(named).drop("_x", "_apart").join(F.broadcast(own), "segment_id")


def _fits(users: DataFrame, ks: list[int], seed: int, starts: int, max_iter: int) -> tuple[dict, list, list]:
    inputs = users.select("user_id", *_point_columns())
    row = _scale_row(inputs).first()
    means = [row[f"_mean_{name}"] or 0.0 for name in FEATURES]
    stds = [row[f"_std_{name}"] or 0.0 for name in FEATURES]
    if row[f"_mean_{FEATURES[0]}"] is None:
        raise ValueError("There are no users to segment.")
    with Points(weighted_points(inputs, FEATURES, "user_id", seed), means, stds) as points:
        return best_fits(points, ks, starts, max_iter), means, stds


def fit_segments(users: DataFrame, k: int = 4, seed: int = 42, starts: int = 10, max_iter: int = 300) -> SegmentModel:
    """Best of several K-Means starts over user features, all starts in the same passes.

    ``users`` is read more than once: give a stored table (``store_users``).
    """
    fits, means, stds = _fits(users, [k], seed, starts, max_iter)
    return SegmentModel(means, stds, fits[k])


def store_users(sessions: DataFrame, max_users: int | None = None, seed: int = 42) -> Stored:
    """The user features, written once: fitting, labels and profiles read them and not the sessions."""
    return Stored(training_users(sessions, max_users, seed), "user-features")


def labelled_users(
    sessions: DataFrame,
    k: int = 4,
    seed: int = 42,
    starts: int = 10,
    max_users: int | None = None,
    only_sample: bool = False,
    max_iter: int = 300,
    coordinates: bool = False,
) -> tuple[DataFrame, SegmentModel]:
    """Features of every user with ``segment_id``, and the model.

    Fitted on all users, or on ``max_users`` seeded ones if named; ``only_sample`` labels these only.
    """
    trained = store_users(sessions, max_users, seed).table
    model = fit_segments(trained, k, seed, starts, max_iter)
    users = trained if max_users is None or only_sample else store_users(sessions).table
    return model.label(users, coordinates), model


def user_segments(sessions: DataFrame, coordinates: bool = False, digits: int | None = None, **fitting) -> DataFrame:
    """Every user with segment, persona name and the exported features; ``fitting`` as in ``labelled_users``.

    With ``coordinates`` a row also carries its place and its centre, by which the fit can be checked; ``digits`` rounds means
    and coordinates.
    """
    labelled, _ = labelled_users(sessions, coordinates=coordinates, **fitting)
    more = [c for c in labelled.columns if c.startswith(("x_", "centre_")) or c == "squared_distance"]
    named = name_users(labelled, more)
    return named if digits is None else round_columns(named, dict.fromkeys(["conversion_rate", "revenue_per_session", *more], digits))


def name_users(labelled: DataFrame, more: list[str] | tuple = ()) -> DataFrame:
    """Joins the persona names back; the profile has one row per segment."""
    names = persona_rules(segment_profile(labelled)).select("segment_id", "segment_name")
    return labelled.join(F.broadcast(names), "segment_id").select(
        "user_id",
        "segment_id",
        "segment_name",
        "total_sessions",
        "conversion_rate",
        "revenue_per_session",
        "days_active",
        *more,
    )


def fitted_profile(labelled: DataFrame, model: SegmentModel) -> DataFrame:
    """Profile, name and silhouette of every fitted segment, beside the silhouette of the whole fit."""
    rows = [(i, s, model.silhouette) for i, s in enumerate(model.silhouettes or [None] * len(model.centres))]
    scores = labelled.sparkSession.createDataFrame(rows, "segment_id int, segment_silhouette double, silhouette double")
    # One row per centre.
    return persona_rules(segment_profile(labelled)).join(F.broadcast(scores), "segment_id")


def user_segment_profile(sessions: DataFrame, digits: int | None = None, **fitting) -> DataFrame:
    """``fitted_profile`` from sessions; ``fitting`` as in ``labelled_users``."""
    profile = fitted_profile(*labelled_users(sessions, **fitting))
    means = ("avg_sessions", "avg_cr", "avg_revenue", "avg_days_active", "segment_silhouette", "silhouette")
    return profile if digits is None else round_columns(profile, dict.fromkeys(means, digits))


def optimal_k(
    sessions: DataFrame,
    ks: range = range(2, 8),
    seed: int = 42,
    starts: int = 10,
    max_users: int | None = None,
    max_iter: int = 300,
    digits: int | None = None,
) -> DataFrame:
    """Cost and silhouette (squared Euclidean) per k; the best k is marked, the smaller one on a tie of six digits.

    All pairs of k and start share the passes over one stored user table.
    """
    stored = store_users(sessions, max_users, seed)
    fits, _, _ = _fits(stored.table, list(ks), seed, starts, max_iter)
    stored.drop()
    scores = {k: fit.silhouette for k, fit in fits.items() if fit.silhouette is not None}
    best = max(scores, key=lambda k: (round(scores[k], 6), -k), default=None)
    shown = (lambda v: v) if digits is None else (lambda v: v if v is None else round(v, digits))
    rows = [(k, shown(fit.cost), shown(fit.silhouette), k == best) for k, fit in fits.items()]
    return sessions.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double, recommended boolean")
