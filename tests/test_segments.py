"""Fitted segments, checked by what must hold for any good clustering."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from builders import sessions_of, ts
from sessionscope.operators import clustering, segments
from sessionscope.sources.events import load_sessions


@pytest.fixture(scope="module")
def table(spark):
    """Three clearly different kinds of users."""
    rows = []
    for i in range(30):
        rows.append({"user_id": f"A{i}", "steps_completed": 1, "bounced": 1})
        for day in range(1, 6):
            visit = {"user_id": f"B{i}", "timestamp": ts(f"2024-01-{day:02d}T10:00:00"), "device": "desktop"}
            rows.append({**visit, "steps_completed": 3})
        rows.append({"user_id": f"C{i}", "device": "tablet", "converted": 1, "revenue": 90.0 + i % 3})
    return sessions_of(spark, rows)


def test_segments_follow_the_kinds(table):
    rows = segments.user_segments(table, k=3, starts=4).collect()
    assert len(rows) == 90 and len({r.user_id for r in rows}) == 90
    kinds = {}
    for r in rows:
        kinds.setdefault(r.user_id[0], set()).add((r.segment_id, r.segment_name))
    assert all(len(found) == 1 for found in kinds.values())
    assert kinds["C"] == {(2, "High-Value Loyal Buyers")}
    assert kinds["A"] == {(0, "One-Time Browsers")}
    assert kinds["B"] == {(1, "Window Shoppers (Retargetable)")}


def points_of(table, k=1):
    """The standardised features of every user, and the segments fitted on them."""
    users = segments.store_users(table).table
    model = segments.fit_segments(users, k=k, starts=4)
    rows = users.collect()
    data = np.array([[float(r[name]) for name in segments.FEATURES] for r in rows])
    spread = data.std(axis=0)
    return (data - data.mean(axis=0)) / np.where(spread > 0, spread, 1.0), model


def test_fit_is_certified(spark):
    """Nearest centres, centres at the means, cost and silhouettes, all recomputed from single users."""
    sessions = load_sessions(spark, "/root/testdata/sf0.001")
    points, model = points_of(sessions, k=4)
    centres = np.array(model.centres)
    apart = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
    labels = apart.argmin(axis=1)
    assert len(set(labels)) == 4
    for j in range(4):
        assert centres[j] == pytest.approx(points[labels == j].mean(axis=0), abs=1e-9)
    assert model.cost == pytest.approx(apart.min(axis=1).sum(), rel=1e-9)
    pairs = ((points[:, None, :] - points[None]) ** 2).sum(axis=2)
    scores = []
    for i, label in enumerate(labels):
        inside = pairs[i, labels == label].sum() / ((labels == label).sum() - 1)
        outside = min(pairs[i, labels == other].mean() for other in set(labels) - {label})
        scores.append((outside - inside) / max(outside, inside))
    assert model.silhouette == pytest.approx(np.mean(scores), abs=1e-9)
    for j in range(4):
        assert model.silhouettes[j] == pytest.approx(np.mean(np.array(scores)[labels == j]), abs=1e-9)
    rows = model.label(segments.user_features(sessions), coordinates=True).collect()
    for r in rows:
        x = np.array([r[f"x_{name}"] for name in segments.FEATURES])
        own = [r[f"centre_{name}"] for name in segments.FEATURES]
        assert own == model.centres[r.segment_id]
        assert r.squared_distance == pytest.approx(((x - centres) ** 2).sum(axis=1).min(), abs=1e-9)


def test_best_of_starts_is_the_cheapest(spark):
    sessions = load_sessions(spark, "/root/testdata/sf0.001")
    users = segments.store_users(sessions).table
    costs = [segments.fit_segments(users, k=5, starts=n).cost for n in (1, 3, 6)]
    assert costs[0] >= costs[1] >= costs[2]


def test_seeds_change_the_draws(spark):
    sessions = load_sessions(spark, "/root/testdata/sf0.001")
    users = segments.store_users(sessions).table
    fits = [segments.fit_segments(users.repartition(n), k=6, seed=seed, starts=1).centres for n, seed in ((1, 1), (5, 1), (5, 2))]
    assert np.allclose(fits[0], fits[1], atol=1e-9)
    assert not np.allclose(fits[0], fits[2], atol=1e-3)


def test_draws_follow_the_weights(spark):
    """The first centre is a user drawn at random: heavy points are drawn as often as they weigh."""
    rows = [(f"a{i}", 0.0) for i in range(300)] + [(f"b{i}", 1.0) for i in range(100)]
    frame = spark.createDataFrame(rows, "id string, v double")
    drawn = []
    for seed in range(8):
        with clustering.Points(clustering.weighted_points(frame, ("v",), "id", seed), [0.0], [1.0]) as points:
            drawn += [centres[0][0] for centres in points.starts(50, 1)]
    assert 0.15 < np.mean(drawn) < 0.35


def test_optimal_k_finds_three(table):
    scores = {r.k: r for r in segments.optimal_k(table, ks=range(2, 5), starts=3).collect()}
    assert [k for k, r in scores.items() if r.recommended] == [3]


def test_fewer_kinds_than_segments(spark):
    same = sessions_of(spark, [{"user_id": f"U{i}"} for i in range(4)] + [{"user_id": "V", "device": "desktop"}])
    labelled, model = segments.labelled_users(same, k=4, starts=2)
    assert len(model.centres) == 2 and {r.segment_id for r in labelled.collect()} == {0, 1}
    one = sessions_of(spark, [{"user_id": "U1"}, {"user_id": "U2"}])
    labelled, model = segments.labelled_users(one, k=3, starts=2)
    assert model.silhouette is None and {r.segment_id for r in labelled.collect()} == {0}
    assert segments.optimal_k(one, ks=range(2, 4)).where("recommended").count() == 0
    assert segments.fitted_profile(labelled, model).first().silhouette is None


def test_no_users_is_an_error(spark):
    with pytest.raises(ValueError, match="no users"):
        segments.user_segments(sessions_of(spark, [{"user_id": None}]))


def test_profile_carries_silhouettes(table):
    rows = segments.user_segment_profile(table, k=3, starts=3).collect()
    assert sum(r["count"] for r in rows) == 90 and len({r.silhouette for r in rows}) == 1
    assert sum(r["count"] * r.segment_silhouette for r in rows) / 90 == pytest.approx(rows[0].silhouette)


def test_only_the_sample_is_labelled_on_request(table):
    labelled = segments.user_segments(table, k=2, starts=1, max_users=20, only_sample=True)
    assert labelled.count() == 20
    assert dict(labelled.dtypes)["total_sessions"] == "bigint"


def test_training_users_are_the_smallest_draws(spark, table):
    drawn = {r.user_id for r in segments.training_users(table, 25).select("user_id").collect()}
    everyone = table.select("user_id").distinct().withColumn("d", F.md5(F.concat(F.lit("42:"), "user_id")))
    expected = {r.user_id for r in everyone.orderBy("d").limit(25).collect()}
    assert drawn == expected
    full = {r.user_id: r for r in segments.user_features(table).collect()}
    assert all(full[r.user_id] == r for r in segments.training_users(table, 25).collect())


def test_scaled_features_have_unit_population_spread(spark):
    features = segments.user_features(load_sessions(spark, "/root/testdata/sf0.001"))
    scaled = segments.scaled_features(features)
    stats = scaled.agg(
        *[F.avg(n).alias(f"m_{n}") for n in segments.FEATURES],
        *[F.stddev_pop(n).alias(f"s_{n}") for n in segments.FEATURES],
    ).first()
    for name in segments.FEATURES:
        assert stats[f"m_{name}"] == pytest.approx(0, abs=1e-9)
        assert stats[f"s_{name}"] == pytest.approx(1, abs=1e-9)


def test_constant_feature_scales_to_zero(spark):
    same = sessions_of(spark, [{"user_id": "U1"}, {"user_id": "U2"}])
    row = segments.scaled_features(segments.user_features(same)).first()
    assert all(row[name] == 0.0 for name in segments.FEATURES)
