"""Upper tails of the normal, chi-square and t distributions for one-row-per-test tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def normal_two_sided(z: Column) -> Column:
    return _normal(z.cast("double"))


def chi2_upper(x: Column, df: Column) -> Column:
    return _chi2(x.cast("double"), df.cast("double"))


def t_two_sided(t: Column, df: Column) -> Column:
    return _student(t.cast("double"), df.cast("double"))


@F.pandas_udf(T.DoubleType())
def _normal(z: pd.Series) -> pd.Series:
    return z.map(lambda v: min(1.0, math.erfc(v / math.sqrt(2))), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_missing_or(gamma_upper, k / 2, v / 2) for v, k in zip(x, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _student(t: pd.Series, df: pd.Series) -> pd.Series:
    tails = [_missing_or(lambda v, k: beta_lower(k / 2, 0.5, k / (k + v * v)), v, k) for v, k in zip(t, df)]
    return pd.Series(tails, dtype="float64")


def _missing_or(fn, *args):
    return float("nan") if any(a is None or math.isnan(a) for a in args) else fn(*args)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: power series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    return scale * _fraction(lambda k: -k * (k - a), lambda k: x + 1 - a + 2 * k)


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised lower incomplete beta."""
    if x <= 0 or x >= 1:
        return min(1.0, max(0.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a

    def numerator(k: int) -> float:
        m = k // 2
        if k % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    return front * _fraction(numerator, lambda k: 1.0)


def _fraction(num, den, rounds: int = 10_000) -> float:
    """1 / (den(0) + num(1) / (den(1) + num(2) / ...)), evaluated forwards."""
    tiny = 1e-300
    value = den(0) or tiny
    c, d = value, 0.0
    for k in range(1, rounds):
        d = den(k) + num(k) * d or tiny
        c = den(k) + num(k) / c or tiny
        d = 1 / d
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 / value
