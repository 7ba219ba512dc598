"""Interval arithmetic as columns, distribution tails as Arrow kernels.

The kernels only ever see rows of finished statistics, never raw data.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe import fixed_values as fv
from gradeframe.functions.text import col


def wilson(k: Column | str, n: Column | str, z: float = fv.Z95) -> dict[str, Column]:
    """Accuracy, bounds, centre and half width of the Wilson interval; zeros when n = 0."""
    n_, k_ = col(n).cast("double"), col(k).cast("double")
    p = k_ / F.nullif(n_, F.lit(0.0))
    z2n = F.lit(z * z) / F.nullif(n_, F.lit(0.0))
    center = (p + z2n / 2) / (1 + z2n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / F.nullif(n_, F.lit(0.0)) + z2n / (4 * F.nullif(n_, F.lit(0.0)))) / (1 + z2n)

    def or_zero(c: Column) -> Column:
        return F.when(n_ > 0, c).otherwise(F.lit(0.0))

    return {
        "accuracy": or_zero(p),
        "ci_lower": or_zero(F.greatest(F.lit(0.0), center - half)),
        "ci_upper": or_zero(F.least(F.lit(1.0), center + half)),
        "center": or_zero(center),
        "half_width": or_zero(half),
    }


def fnr_corrected(accuracy: Column | str, fnr: Column | str) -> Column:
    """Accuracy once false negatives are counted, at most 1."""
    a, f = col(accuracy), col(fnr)
    corrected = a / F.nullif(1 - f, F.lit(0.0))
    return F.when((f >= 1) | a.isNull(), a).when(corrected > 1, 1.0).otherwise(corrected)


def _continued_fraction(step, start: float, tiny: float = 1e-300, rounds: int = 1000) -> float:
    """Modified Lentz evaluation of start + a1/(b1 + a2/(b2 + ...))."""
    value = start or tiny
    c, d = value, 0.0
    for i in range(1, rounds):
        a, b = step(i)
        d = b + a * d or tiny
        c = b + a / c or tiny
        d = 1.0 / d
        change = c * d
        value *= change
        if abs(change - 1.0) < 1e-15:
            break
    return value


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(b, a, 1.0 - x)

    def step(i: int) -> tuple[float, float]:
        if i == 1:
            return 1.0, 1.0
        m, odd = divmod(i - 1, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(log_front) / a * _continued_fraction(step, 0.0)


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    log_front = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - total * math.exp(log_front)

    def step(i: int) -> tuple[float, float]:
        n = i - 1
        return (1.0 if n == 0 else -n * (n - a)), x + 2 * n + 1 - a

    return math.exp(log_front) * _continued_fraction(step, 0.0)


def t_two_sided(t: float, df: float) -> float:
    if not math.isfinite(t):
        return 0.0
    return beta_tail(df / 2.0, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def chi2_sf(statistic: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution."""
    return pd.Series([
        None if pd.isna(s) or pd.isna(d) else gamma_tail(d / 2.0, s / 2.0) for s, d in zip(statistic, df)
    ], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    def tail(value: float, size: float) -> float | None:
        if pd.isna(value) or pd.isna(size) or size < 3:
            return None
        rest = 1.0 - value * value
        if rest <= 0.0:
            return 0.0
        return t_two_sided(value * math.sqrt((size - 2) / rest), size - 2)

    return pd.Series([tail(a, b) for a, b in zip(r, n)], dtype="float64")


def correlation_p(r: Column | str, n: Column | str) -> Column:
    """Two-sided p-value of a correlation coefficient over n pairs."""
    return _correlation_p(col(r), col(n).cast("double"))
