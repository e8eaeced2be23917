"""Hard negatives against a comparison of all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionscope.llm.hardneg import Mining, Packed, hard_negatives, whole

SCHEMA = "vec_id long, embedding array<double>, label int, row string, block string, score long, rank int, vector string"


def vectors_frame(spark, rows):
    """Embeddings with further columns whose names the operator uses inside."""
    return spark.createDataFrame([(*row, "x", "y", 1, 2, "z") for row in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("low, high", [(-150, 150), (0, 1), (-(2**20), 5), (10**6, 10**6 + 3), (-(2**61), 2**61), (-(10**25), 10**25), (7, 7)])
def test_packed_products_are_exact(low, high):
    rng = random.Random(high)
    for size in (0, 1, 3, 64):
        rows = [[rng.randint(low, high) for _ in range(size)] for _ in range(37)]
        kind = np.int64 if max(abs(low), abs(high)) < 2**62 else object
        rows = np.array(rows, dtype=kind).reshape(37, size)
        reach = 1 << max(abs(low), abs(high), 1).bit_length()
        scores = Packed(rows, reach).scores(rows[:5])
        expected = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in rows] for x in rows[:5]]
        assert [[int(s) for s in line] for line in scores] == expected


def test_several_candidates_share_a_number():
    packed = Packed(np.arange(-8, 8).reshape(8, 2), 16)
    assert packed.fields > 1 and packed.words.shape == (2, math.ceil(8 / packed.fields))
    assert packed.kind is np.float64 and packed.words.max() < 2.0**53


def test_whole_numbers():
    assert whole(np.array([[0.5, -0.001, 1.0]]), 256).tolist() == [[128, -1, 256]]
    assert whole(np.array([[1e300, -1.5]]), 256).tolist() == [[int(1e300) * 256, -384]]


def brute_force(rows, is_anchor, mining):
    fine = [
        (i, math_floor(v), label)
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for at, (i, v, label) in enumerate(fine):
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for k, (j, w, other) in enumerate(fine) if k != at and len(w) == len(v)]
        positives = sorted(s[:2] for s in scored if s[2] == label)[: mining.positives]
        for p, j in positives:
            fits = sorted(s[:2] for s in scored if s[2] != label and mining.low * -p <= 100 * -s[0] <= mining.high * -p)
            found += [(i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(fits[: mining.negatives], 1)]
    return sorted(tuple(x if abs(x) < 2**63 else None for x in row) for row in found)


def math_floor(v):
    return [int(x) * 256 if abs(x) >= 2.0**53 else math.floor(256 * x) for x in v]


def table(seed, n, size, labels, odd):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, rng.gauss(0, 0.3)]) for _ in range(size)], rng.randrange(labels)) for i in range(n)]
    if odd:
        rows += [rows[7]] * 3 + [(i, rows[0][1], 1) for i in (300, 301, 302)]  # repeated rows and equal vectors
        rows += [(400, None, 1), (401, [0.1, None], 1), (402, [float("nan"), 1.0], 1), (403, [float("inf"), 0.0], 0), (404, [0.1] * size, None), (None, [0.1] * size, 1)]
        rows += [(500, [], 0), (501, [], 0), (502, [], 1), (503, [0.5], 0), (504, [0.5], 0), (505, [0.5], 1), (506, [0.45], 1)]
    return rows


@pytest.mark.parametrize("seed, size, labels, odd, block", [(1, 4, 3, True, 8192), (2, 8, 2, True, 10), (3, 16, 1, False, 50), (4, 3, 5, False, 7)])
def test_hard_negatives_match_brute_force(spark, seed, size, labels, odd, block):
    rows = table(seed, 160, size, labels, odd)
    mining = Mining(block=block)
    found = hard_negatives(vectors_frame(spark, rows), F.col("vec_id") % 7 == 0, mining).collect()
    assert sorted(tuple(r) for r in found) == brute_force(rows, lambda i: i % 7 == 0, mining)


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e20, 1.0], 0), (1, [1e20, 2.0], 0), (2, [0.95e20, 1.0], 1), (3, [0.9e20, 5.0], 1), (4, [-1e20, 0.0], 1), (5, [1.0, 0.5], 0)]
    found = hard_negatives(vectors_frame(spark, rows), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 1, 1, 2, None, None), (0, 1, 2, 3, None, None)]


def test_no_vectors(spark):
    found = hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0)
    assert found.count() == 0
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
