from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sessionscope.functions import stats


def row_of(spark, **values):
    return spark.createDataFrame([tuple(float(v) for v in values.values())], list(values))


@pytest.mark.parametrize(
    "z, p", [(0.0, 1.0), (1.0555, 0.291197), (-3.451, 0.000558514), (1.959964, 0.05), (40.0, 0.0)]
)
def test_normal_tail(z, p):
    assert stats.two_sided_normal(z) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize(
    "t, df, p",
    [(2.228, 10, 0.05001), (12.706, 1, 0.05), (0.0, 7, 1.0), (-2.228, 10, 0.05001), (1.0, 1, 0.5)],
)
def test_student_tail(t, df, p):
    assert stats.two_sided_student(t, df) == pytest.approx(p, abs=2e-5)


def test_student_tail_approaches_normal():
    for t in (0.3, 1.7, 4.0):
        assert stats.two_sided_student(t, 1e7) == pytest.approx(stats.two_sided_normal(t), rel=1e-5)


@pytest.mark.parametrize("df", [1e7, 1e8, 1e9, 1e10, 1e11, 1e12])
@pytest.mark.parametrize("t", [0.05, 0.3, 1.0, 1.7, 2.5, 4.0, 9.0])
def test_student_tail_at_large_n(t, df):
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    limit = math.erfc(t / math.sqrt(2)) + density * (t**3 + t) / (2 * df)
    assert stats.two_sided_student(t, df) == pytest.approx(limit, rel=1e-9)


@pytest.mark.parametrize("t", [0.01, 0.4, 1.0, 1.2, 3.0, 50.0, 1e6])
def test_student_tail_closed_forms(t):
    assert stats.two_sided_student(t, 1) == pytest.approx(2 * math.atan(1 / t) / math.pi, rel=1e-12)
    root = math.sqrt(2 + t * t)
    assert stats.two_sided_student(-t, 2) == pytest.approx(2 / (root * (root + t)), rel=1e-12)


def test_student_tail_against_integration():
    df, t, steps = 23.7, 1.83, 20000
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    h = t / steps
    total = sum(
        (1 if i in (0, steps) else 4 if i % 2 else 2) * (1 + (i * h) ** 2 / df) ** (-(df + 1) / 2)
        for i in range(steps + 1)
    )
    assert stats.two_sided_student(t, df) == pytest.approx(1 - 2 * scale * total * h / 3, abs=1e-10)


def test_pooled_z_squared_is_the_chi_square_of_the_table(spark):
    frame = row_of(spark, x1=30, n1=200, x2=18, n2=210)
    z = frame.select(stats.pooled_z(*[F.col(c) for c in frame.columns])).first()[0]
    observed = [[30, 170], [18, 192]]
    rows, columns, total = [200, 210], [48, 362], 410
    chi = sum(
        (observed[i][j] - rows[i] * columns[j] / total) ** 2 / (rows[i] * columns[j] / total)
        for i in range(2)
        for j in range(2)
    )
    assert z * z == pytest.approx(chi)
    assert z > 0  # group 1 minus group 2


def test_degenerate_inputs_give_null(spark):
    frame = row_of(spark, x1=0, n1=5, x2=0, n2=5)
    z = stats.pooled_z(*[F.col(c) for c in frame.columns])
    assert frame.select(z, stats.normal_p(z)).first() == (None, None)


def test_interval_is_unpooled(spark):
    frame = row_of(spark, x1=20, n1=100, x2=30, n2=100)
    low, high = frame.select(*stats.proportion_diff_ci(*[F.col(c) for c in frame.columns])).first()
    half = 1.96 * math.sqrt(0.2 * 0.8 / 100 + 0.3 * 0.7 / 100)
    assert (low, high) == pytest.approx((0.1 - half, 0.1 + half))


def test_welch(spark):
    frame = row_of(spark, m1=10, v1=4, n1=16, m2=11, v2=9, n2=25)
    m1, v1, n1, m2, v2, n2 = [F.col(c) for c in frame.columns]
    t, df = frame.select(stats.welch_t(m1, v1, n1, m2, v2, n2), stats.welch_df(v1, n1, v2, n2)).first()
    a, b = 4 / 16, 9 / 25
    assert t == pytest.approx(-1 / math.sqrt(a + b))
    assert df == pytest.approx((a + b) ** 2 / (a * a / 15 + b * b / 24))
