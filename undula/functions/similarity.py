"""Similarity aggregates that stay inside the JVM.

All of them are plain aggregate expressions, so they work in ``groupBy().agg``
(with map-side combine) and over a window frame alike.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

METHODS = ("pearson", "spearman", "cosine")


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation that is 0 when either side is constant.

    ``F.corr`` raises DIVIDE_BY_ZERO on constant input in ANSI mode. The central
    moments are exact zeros for constant input, so no tolerance is needed.
    """
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.coalesce(F.try_divide(F.covar_samp(x, y), spread), F.lit(0.0))


def safe_cosine(x: Column | str, y: Column | str) -> Column:
    """Cosine similarity, 0 when either side has zero norm."""
    x, y = _col(x), _col(y)
    norms = F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))
    return F.coalesce(F.try_divide(F.sum(x * y), norms), F.lit(0.0))


def phase_locking(x: Column | str, y: Column | str) -> Column:
    """Phase locking of two real series: the phase of a real sample is 0 or pi."""
    return F.abs(F.avg(_half_turn(x) * _half_turn(y)))


def similarity(method: str, x: Column | str, y: Column | str) -> Column:
    """Similarity of two paired columns; Spearman expects ranks as input."""
    check_method(method)
    return safe_cosine(x, y) if method == "cosine" else safe_corr(x, y)


def check_method(method: str, allowed: tuple[str, ...] = METHODS) -> None:
    if method not in allowed:
        raise ValueError(f"unsupported method {method!r}, use one of {allowed}")


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded value without negative zero, for comparable output."""
    return F.round(_col(c), digits) + F.lit(0.0)


def _half_turn(c: Column | str) -> Column:
    return F.when(_col(c) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
