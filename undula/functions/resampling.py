"""Order statistics of uniform draws, for bootstrap quantiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

TAGGED = "array<struct<tag:struct<level_idx:int,replica:int,weight:double>,pos:long>>"


def resample_positions(seed: Column, n: Column, levels: Sequence[float], replicas: int) -> Column:
    """Sorted positions hit by the two order statistics around each level, per replica."""
    levels = [float(q) for q in levels]

    @F.pandas_udf(TAGGED)
    def draw(seeds: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([_draw(int(s), int(k), levels, replicas) for s, k in zip(seeds, sizes)])

    return draw(seed, n)


def _draw(seed: int, n: int, levels: list[float], replicas: int) -> list[dict]:
    rng = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF)
    out = []
    for idx, level in enumerate(levels):
        at = level * (n - 1)
        low = int(np.floor(at))
        # the (low+1)-th smallest of n uniforms, then the minimum of the n-low-1 uniforms above it
        first = rng.beta(low + 1, n - low, replicas)
        above = n - low - 1
        second = first + (1 - first) * rng.beta(1, above, replicas) if above > 0 else first
        for weight, draws in ((1 - (at - low), first), (at - low, second)):
            spots = np.minimum((draws * n).astype(np.int64), n - 1)
            out.extend(
                {"tag": {"level_idx": idx, "replica": r, "weight": weight}, "pos": int(p)} for r, p in enumerate(spots)
            )
    return out
