"""Pooling of speeds by time scale and their distributions (family D)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from undula.functions.resampling import resample_positions
from undula.operators.order_stats import medians, medians_of_lists, order_statistics, quantiles, row_numbers

POOLS = ("short", "mid", "long")
STRATEGIES = ("pad", "drop")
# Flat-index ranges of the three pools, both ends included.
FLAT_RANGES = ((0, 9), (10, 30), (31, 60))


def window_index(windows: Sequence[int]) -> Column:
    """0-based position of ``window_size`` in the sorted list of sizes."""
    sizes = F.array(*[F.lit(w) for w in sorted(windows)])
    return (F.array_position(sizes, F.col("window_size")) - 1).cast("int")


def pool_by_limits(speeds: DataFrame, windows: Sequence[int], limits: tuple[int, int]) -> DataFrame:
    """Add ``pool``: short, mid or long by window position."""
    idx = window_index(windows)
    short_mid, mid_long = limits
    return speeds.withColumn(
        "pool", F.when(idx < short_mid, "short").when(idx < mid_long, "mid").otherwise("long")
    )


def align_lengths(pooled: DataFrame, strategy: str, keys: Sequence[str] = ("pool",)) -> DataFrame:
    """'pad' leaves long rows as they are; 'drop' keeps subjects whose pool has the modal length.

    On a tie the length that the smallest subject has wins.
    """
    if strategy not in STRATEGIES:
        raise ValueError("strategy must be 'pad' or 'drop'")
    if strategy == "pad":
        return pooled
    lengths = pooled.groupBy(*keys, "subject").agg(F.count(F.lit(1)).alias("_len"))
    tally = lengths.groupBy(*keys, "_len").agg(F.count(F.lit(1)).alias("_n"), F.min("subject").alias("_first"))
    modal = tally.groupBy(*keys).agg(F.max(F.struct("_n", -F.col("_first"), "_len")).alias("_m"))
    kept = lengths.join(modal, list(keys)).where(F.col("_len") == F.col("_m._len")).select(*keys, "subject")
    return pooled.join(kept, [*keys, "subject"], "left_semi")


def pool_by_flat_index(speeds: DataFrame, windows: Sequence[int], taus: Sequence[int]) -> DataFrame:
    """Pool by the position in the flattened (window, tau) list; positions beyond the ranges drop out."""
    tau_list = F.array(*[F.lit(t) for t in taus])
    flat = window_index(windows) * len(taus) + (F.array_position(tau_list, F.col("tau")) - 1).cast("int")
    pool = None
    for name, (low, high) in zip(POOLS, FLAT_RANGES):
        inside = F.col("flat_index").between(low, high)
        pool = F.when(inside, name) if pool is None else pool.when(inside, name)
    return speeds.withColumn("flat_index", flat).withColumn("pool", pool).where("pool is not null")


def by_population(pooled: DataFrame, groups: DataFrame) -> DataFrame:
    """Attach group labels; a subject in several groups is repeated."""
    return pooled.join(groups.select("label", "subject"), "subject")


def pool_by_halves(speeds: DataFrame, windows: Sequence[int], with_all: bool = False) -> DataFrame:
    """Pool windows into short and long at the middle of the list; optionally repeat as 'all'."""
    half = F.when(window_index(windows) < len(windows) // 2, "short").otherwise("long")
    if not with_all:
        return speeds.withColumn("pool", half)
    return speeds.withColumn("pool", F.explode(F.array(half, F.lit("all"))))


def subject_medians(speeds: DataFrame, keys: Sequence[str] = ("subject",), out: str = "median_speed") -> DataFrame:
    """Median per ``keys`` of rows that hold one speed, or a list of speeds, each."""
    if dict(speeds.dtypes)["speed"].startswith("array"):
        return medians_of_lists(speeds, keys, "speed", out)
    return medians(speeds, keys, "speed", out)


# ---- histograms and distribution functions ---------------------------------------------


def normalized_histograms(
    df: DataFrame, keys: Sequence[str], value: str, bins: int = 250, low: float = 0.0, high: float = 1.2
) -> DataFrame:
    """Counts per bin over a fixed range, divided by the largest count of all groups."""
    width = (high - low) / bins
    x = F.col(value)
    slot = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    filled = df.where((x >= low) & (x <= high)).groupBy(*keys, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    counts = grid.join(filled, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))
    peak = counts.agg(F.max("n").alias("_peak"))
    center = F.lit(low) + (F.col("bin") + 0.5) * width
    return counts.join(F.broadcast(peak)).select(
        *keys, "bin", center.alias("center"), "n", (F.col("n") / F.col("_peak")).alias("normalized")
    )


def density_histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 150) -> DataFrame:
    """Density over bins between the minimum and maximum of each group; empty bins are 0."""
    keys = list(keys)
    x = F.col(value)
    ends = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(x).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    placed = df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))
    slot = F.least(F.floor((x - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    filled = placed.groupBy(*keys, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    density = F.coalesce("n", F.lit(0)) / (F.col("_n") * width)
    return grid.join(filled, [*keys, "bin"], "left").select(*keys, "bin", density.alias("density"))


def empirical_cdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sorted values with k/n; tied values get increasing steps."""
    numbered = row_numbers(df, keys, value, "_k")
    return numbered.select(*keys, value, (F.col("_k") / F.col("n")).alias("cdf"))


# ---- quantiles -------------------------------------------------------------------------


def level_grid(first: float, last: float, count: int) -> list[float]:
    return [first + (last - first) * k / (count - 1) for k in range(count)]


def quantile_difference(table: DataFrame, group: str = "label", keys: Sequence[str] = ("pool",)) -> DataFrame:
    """Difference of each quantile to the previous group in label order.

    ``table`` is a quantile table: groups x pools x levels, its size set by parameters.
    """
    w = W.partitionBy(*keys, "level_idx").orderBy(group)
    return table.withColumn("diff", F.col("quantile") - F.lag("quantile").over(w)).where("diff is not null")


def quantile_slope_difference(table: DataFrame, group: str = "label", keys: Sequence[str] = ("pool",)) -> DataFrame:
    """Difference between successive groups of the rise from one level to the next."""
    along = W.partitionBy(*keys, group).orderBy("level_idx")
    rise = table.withColumn("slope", F.col("quantile") - F.lag("quantile").over(along)).where("slope is not null")
    across = W.partitionBy(*keys, "level_idx").orderBy(group)
    return rise.withColumn("slope_diff", F.col("slope") - F.lag("slope").over(across)).where("slope_diff is not null")


def quantile_pairs(table: DataFrame, group: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles of every two groups side by side with the sign of their difference."""
    keys = list(keys)
    a = table.select(*keys, "level_idx", F.col(group).alias("g1"), F.col("quantile").alias("q1"))
    b = table.select(*keys, "level_idx", F.col(group).alias("g2"), F.col("quantile").alias("q2"))
    return (
        a.join(b, [*keys, "level_idx"])
        .where("g1 < g2")
        .withColumn("diff", F.col("q2") - F.col("q1"))
        .withColumn("side", F.signum("diff").cast("int"))
    )


def quantile_matrix(
    speeds: DataFrame, levels: Sequence[float], positive_only: bool = False, log: bool = False, group: str = "label"
) -> DataFrame:
    """Quantiles per group and window size, optionally of positive speeds and on a log scale."""
    if positive_only:
        speeds = speeds.where(F.col("speed") > 0)
    out = quantiles(speeds, [group, "window_size"], "speed", levels)
    return out.withColumn("quantile", F.ln("quantile")) if log else out


def bootstrap_ci(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    levels: Sequence[float],
    replicas: int = 1000,
    seed: int = 0,
    confidence: float = 0.95,
) -> DataFrame:
    """Confidence band of quantiles under resampling with replacement.

    The resampled quantile needs two neighbouring order statistics of n uniform draws, and their
    joint law is known (Beta spacings). Drawing them directly gives resamples of full size n
    without generating n * replicas rows; the data are ordered once.
    """
    draws = resample_positions(F.xxhash64(F.lit(seed), *keys), F.col("n"), levels, replicas)
    picked = order_statistics(df, keys, value, draws, many=True)
    per_replica = picked.groupBy(*keys, F.col("tag.level_idx").alias("level_idx"), F.col("tag.replica").alias("replica")).agg(
        F.sum(F.col("tag.weight") * F.col(value)).alias("_q")
    )
    edge = (1 - confidence) / 2
    # one value per replica, so the group size is the number of replicas
    band = F.percentile("_q", F.array(F.lit(edge), F.lit(1 - edge)))
    level_of = F.element_at(F.array(*[F.lit(float(q)) for q in levels]), F.col("level_idx") + 1)
    return (
        per_replica.groupBy(*keys, "level_idx")
        .agg(band.alias("_b"))
        .select(*keys, "level_idx", level_of.alias("level"), F.get("_b", F.lit(0)).alias("low"), F.get("_b", F.lit(1)).alias("high"))
    )


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max per group.

    Durations take few distinct values, so the quartiles come from the value counts.
    """
    keys = list(keys)
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quartiles = (
        quantiles(df, keys, value, [0.25, 0.5, 0.75])
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("level_idx") == k, F.col("quantile"))).alias(n) for k, n in enumerate(("q25", "q50", "q75"))])
    )
    return moments.join(quartiles, keys)
