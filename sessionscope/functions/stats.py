"""Significance tests over aggregated rows.

The sufficient statistics (counts, sums, means, variances) come from Spark
aggregates and the test statistics are Column arithmetic.  Only the tail
probability needs Python, and it runs on the one to a few dozen result rows.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionscope.functions.rates import ratio
from sessionscope.schema import Z_95

# Ship the helpers below with the tasks: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pooled_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Two-proportion z statistic with pooled variance; sign is group 1 - group 2."""
    p1, p2 = ratio(x1, n1), ratio(x2, n2)
    pooled = ratio(x1 + x2, n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (ratio(F.lit(1), n1) + ratio(F.lit(1), n2)))
    return ratio(p1 - p2, se)


def proportion_diff_ci(
    x1: Column, n1: Column, x2: Column, n2: Column, z: float = Z_95
) -> tuple[Column, Column]:
    """Unpooled interval of ``p2 - p1``."""
    p1, p2 = ratio(x1, n1), ratio(x2, n2)
    half = z * F.sqrt(ratio(p1 * (1 - p1), n1) + ratio(p2 * (1 - p2), n2))
    return (p2 - p1) - half, (p2 - p1) + half


def _mean_variances(v1: Column, n1: Column, v2: Column, n2: Column) -> tuple[Column, Column]:
    return ratio(v1, n1), ratio(v2, n2)


def welch_t(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    """Unequal-variance t statistic; sign is group 1 - group 2."""
    a, b = _mean_variances(v1, n1, v2, n2)
    return ratio(m1 - m2, F.sqrt(a + b))


def welch_df(v1: Column, n1: Column, v2: Column, n2: Column) -> Column:
    a, b = _mean_variances(v1, n1, v2, n2)
    return ratio((a + b) * (a + b), ratio(a * a, n1 - 1) + ratio(b * b, n2 - 1))


def mean_diff_ci(
    m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column, z: float = Z_95
) -> tuple[Column, Column]:
    """Normal-approximation interval of ``m2 - m1``."""
    a, b = _mean_variances(v1, n1, v2, n2)
    half = z * F.sqrt(a + b)
    return (m2 - m1) - half, (m2 - m1) + half


def correlation_t(r: Column, n: Column) -> Column:
    """t statistic of a Pearson correlation with ``n - 2`` degrees of freedom."""
    return ratio(r * F.sqrt((n - 2).cast("double")), F.sqrt(1 - r * r))


TERMS = 20_000


def _body_fraction(a: float, y: float) -> float:
    """Continued fraction of I_y(1/2, a) over its front (modified Lentz); quick for small ``a * y``."""
    tiny, b = 1e-300, 0.5
    c, d = 1.0, 1.0 - (a + b) * y / (b + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, TERMS):
        even = m * (a - m) * y / ((b + 2 * m - 1) * (b + 2 * m))
        odd = -(b + m) * (a + b + m) * y / ((b + 2 * m) * (b + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"no convergence at a={a}, y={y}")


def _tail_fraction(a: float, u: float) -> float:
    """2F1(1/2, 1; a + 1; -u) as Gauss's fraction: positive terms only, so nothing cancels."""
    c, d, value = 1.0, 0.0, 1.0
    for k in range(TERMS):
        odd = (k + 0.5) * u * (a + k) / (a + 2 * k) / (a + 2 * k + 1)
        even = (k + 1) * u * (a + k + 0.5) / (a + 2 * k + 1) / (a + 2 * k + 2)
        for term in (odd, even):
            d = 1.0 / (1.0 + term * d)
            c = 1.0 + term / c
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return 1.0 / value
    raise ArithmeticError(f"no convergence at a={a}, u={u}")


def _log_gamma_step(a: float) -> float:
    """log(Gamma(a + 1/2) / Gamma(a)), moved up to where Stirling's remainders are exact."""
    moved, z = 0.0, a + 20.0
    for i in range(20):
        moved += math.log1p(-0.5 / (a + i + 0.5))

    def remainder(v: float) -> float:
        return 1 / (12 * v) - 1 / (360 * v**3) + 1 / (1260 * v**5) - 1 / (1680 * v**7)

    return moved + z * math.log1p(0.5 / z) - 0.5 + 0.5 * math.log(z) + remainder(z + 0.5) - remainder(z)


def two_sided_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def two_sided_student(t: float, df: float) -> float:
    """``P(|T| > |t|)``; the part above ``y = t*t / (df + t*t)`` is never taken as ``1 - y``."""
    if math.isinf(t):
        return 0.0
    a, square = df / 2.0, t * t
    y = square / (df + square)
    if y <= 0.0:
        return 1.0
    log_front = _log_gamma_step(a) - 0.5 * math.log(math.pi) - a * math.log1p(square / df) + 0.5 * math.log(y)
    if y * (a + 2.5) > 1.5:
        return math.exp(log_front) * _tail_fraction(a, df / square) / (a * y)
    return 1.0 - 2.0 * math.exp(log_front) * _body_fraction(a, y)


@F.pandas_udf(T.DoubleType())
def tail_probability(stat: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p value: Student t where ``df`` is given, else standard normal."""

    def one(s, f):
        if pd.isna(s):
            return None
        return two_sided_normal(s) if pd.isna(f) else two_sided_student(s, f)

    return pd.Series([one(s, f) for s, f in zip(stat, df)], dtype="float64")


def normal_p(stat: Column) -> Column:
    return tail_probability(stat, F.lit(None).cast("double"))


def student_p(stat: Column, df: Column) -> Column:
    return tail_probability(stat, df.cast("double"))
