"""Fluidity and local dimension of the trajectory of samples (family I).

Every sample is compared with every other sample of its subject. Samples are hashed into tiles and
compared tile against tile inside the tasks. A sample's upper quantile of -ln(distance) is found by
counting: two rounds of counts per sample narrow the range that holds it, the values of that range
leave the tiles once each with their number, and with the exact threshold known only the values
above it leave the tiles. No round sends more than a share of the distances, whatever their ties.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from undula.functions.partitioning import cut_lineage, spread
from undula.operators.order_stats import quantiles
from undula.operators.pairing import tile_pairs

EPS = float(np.finfo(float).eps)
CELLS = 128
ROUNDS = 2
#: Subjects of up to so many tiles are ranked without rounds of counts; the thresholds are the same.
FEW_TILES = 4
SAMPLE = ["subject", "t"]
SCALES = ("mean_excess", "l_moments")


def every(signals: DataFrame, step: int) -> DataFrame:
    """The samples 0, step, 2 * step and so on."""
    if step < 1:
        raise ValueError(f"step must be at least 1, not {step}")
    return signals.where(F.col("t") % step == 0) if step > 1 else signals


def sample_rows(signals: DataFrame, step: int = 1) -> DataFrame:
    """(subject, t, x, n) with the regions of a sample in one array and n samples per subject."""
    taken = every(signals, step)
    packed = F.array_sort(F.collect_list(F.struct("region", "value")))
    vectors = taken.groupBy(*SAMPLE).agg(packed.alias("_p")).select(*SAMPLE, F.col("_p.value").alias("x"))
    sizes = taken.groupBy("subject").agg((F.max("t") / step + 1).cast("long").alias("n"))
    return vectors.join(sizes, "subject")


def closeness(signals: DataFrame, tile: int = 1024) -> DataFrame:
    """-ln(distance + eps) to all other samples: rows (subject, t, other, y, n)."""
    rows = sample_rows(signals).withColumn("u", F.lit(float("-inf")))
    return _by_tile(rows, ["u"], _above, ["t", "other", "y"], tile)


def exceedances(signals: DataFrame, quantile: float = 0.98, tile: int = 1024, step: int = 1) -> DataFrame:
    """Values above each sample's own quantile: rows (subject, t, pos, y, u); pos counts the other samples.

    With ``step`` only every so many samples are compared, and pos counts those.
    """
    rows = cut_lineage(sample_rows(signals, step))
    marked = cut_lineage(rows.join(thresholds(rows, quantile, tile), SAMPLE))
    over = _by_tile(marked, ["u"], _above, ["t", "other", "y"], tile).join(marked.select(*SAMPLE, "u"), SAMPLE)
    slot = (F.col("other") / step).cast("long")
    pos = F.when(F.col("other") > F.col("t"), slot - 1).otherwise(slot)
    return over.select(*SAMPLE, pos.alias("pos"), "y", "u")


def thresholds(rows: DataFrame, quantile: float, tile: int = 1024) -> DataFrame:
    """The quantile of every sample's values, with linear interpolation: (subject, t, u).

    ``rows`` is (subject, t, x, n), read more than once. Samples without others have no threshold. Where
    no subject has more than ``FEW_TILES`` tiles, what its samples send of each is little without rounds of counts.
    """
    largest = rows.agg(F.max("n")).first()[0] or 0
    at = F.lit(quantile) * (F.col("n") - 2)
    # no two samples are further apart than twice the largest norm of their subject
    reach = rows.groupBy("subject").agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("_r"))
    widest = 2 * F.sqrt("_r") * (1 + 1e-9) + 1
    state = rows.where("n > 1").join(reach, "subject").select(
        *SAMPLE,
        "n",
        "x",
        (-F.ln(widest)).alias("lo"),
        F.lit(float(np.ceil(-np.log(EPS)))).alias("hi"),
        (F.col("n") - 1 - F.floor(at)).alias("need"),
    )
    for _ in range(ROUNDS if largest > FEW_TILES * tile else 0):
        state = cut_lineage(_narrowed(state, tile))
    # the values of one sample's last range, equal ones once per tile; their one shuffle serves all that follows
    sent = spread(_by_tile(state, ["lo", "hi", "need"], _values, ["t", "y", "c"], tile), *SAMPLE)
    low_first = W.partitionBy(*SAMPLE).orderBy(F.col("y").desc())
    ranked = (
        sent.groupBy(*SAMPLE, "y")
        .agg(F.sum("c").alias("c"))
        .join(state.select(*SAMPLE, "n", "need", "hi"), SAMPLE)
        .withColumn("_upto", F.sum("c").over(low_first))
    )

    def ranks(r: Column) -> Column:
        return (F.col("_upto") >= r) & (F.col("_upto") - F.col("c") < r)

    next_above = F.when(F.col("need") > 1, ranks(F.col("need") - 1)).otherwise(F.col("y") >= F.col("hi"))
    frac = at - F.floor(at)
    return (
        ranked.groupBy(*SAMPLE)
        .agg(
            F.max(F.when(ranks(F.col("need")), F.col("y"))).alias("_lo"),
            F.min(F.when(next_above, F.col("y"))).alias("_hi"),
            F.max(frac).alias("_f"),
        )
        .select(*SAMPLE, F.when(F.col("_f") > 0, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).otherwise(F.col("_lo")).alias("u"))
    )


def _narrowed(state: DataFrame, tile: int) -> DataFrame:
    """One round: every sample's range [lo, hi) cut to the cell that holds its value of rank ``need`` from above."""
    counts = (
        _by_tile(state, ["lo", "hi", "need"], _counts, ["t", "cell", "c"], tile)
        .groupBy(*SAMPLE, "cell")
        .agg(F.sum("c").alias("c"))
        .withColumn("_upto", F.sum("c").over(W.partitionBy(*SAMPLE).orderBy(F.col("cell").desc())))
    )
    found = counts.join(state, SAMPLE).where((F.col("_upto") >= F.col("need")) & (F.col("_upto") - F.col("c") < F.col("need")))

    def edge(k: Column) -> Column:
        return F.col("lo") + (F.col("hi") - F.col("lo")) * k / CELLS

    return found.select(
        *SAMPLE,
        "n",
        "x",
        edge(F.col("cell")).alias("lo"),
        F.when(F.col("cell") == CELLS - 1, F.col("hi")).otherwise(edge(F.col("cell") + 1)).alias("hi"),
        (F.col("need") - (F.col("_upto") - F.col("c"))).alias("need"),
    )


def _by_tile(rows: DataFrame, marks: Sequence[str], work, out: Sequence[str], tile: int) -> DataFrame:
    """``work`` on every two tiles of samples with their ``marks``: rows (subject, n, out)."""
    tiles = tile_pairs(rows, ["subject", "n"], "t", ["x", *marks], tile)
    sides = [F.col(f"{side}.{c}") for side in "ab" for c in ("t", "x", *marks)]
    cells = tiles.select("subject", "n", work("same", *sides).alias("_c"))
    # the outer form, because the plain one adds a filter on the work, which would be done twice
    single = cells.select("subject", "n", F.explode_outer(F.arrays_zip(*[f"_c.{c}" for c in out])).alias("_c"))
    return single.where("_c.t is not null").select("subject", "n", *[f"_c.{c}" for c in out])


def _sides(own: bool, a: tuple, b: tuple) -> Iterator[tuple]:
    """-ln distances of the samples of a tile (rows) to those of the other, from both sides; none to oneself."""
    x, other = np.vstack(a[1]), np.vstack(b[1])
    y = -np.log(np.sqrt(np.stack([((other - row) ** 2).sum(axis=1) for row in x])) + EPS)
    if own:
        np.fill_diagonal(y, -np.inf)
    yield y, a, b
    if not own:
        yield y.T, b, a


def _frame(columns: Sequence[str], parts: list[list[tuple]]) -> pd.DataFrame:
    """One row per tile pair; each part is a list of equally long arrays per column."""
    return pd.DataFrame([[np.concatenate(c) for c in zip(*part)] for part in parts], columns=list(columns))


def _lists(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, T.ArrayType(kind)) for name, kind in kinds.items()])


@F.pandas_udf(_lists(t=T.LongType(), cell=T.IntegerType(), c=T.LongType()))
def _counts(
    same: pd.Series,
    at: pd.Series,
    ax: pd.Series,
    alo: pd.Series,
    ahi: pd.Series,
    aneed: pd.Series,
    bt: pd.Series,
    bx: pd.Series,
    blo: pd.Series,
    bhi: pd.Series,
    bneed: pd.Series,
) -> pd.DataFrame:
    found = []
    for own, *tiles in zip(same, at, ax, alo, ahi, aneed, bt, bx, blo, bhi, bneed):
        part = []
        for y, (t, _, lo, hi, need), _ in _sides(own, tiles[:5], tiles[5:]):
            edges = lo[:, None] + (hi - lo)[:, None] * np.arange(CELLS) / CELLS
            for row, label, e, top, r in zip(y, t, edges, hi, need):
                inside = row[(row >= e[0]) & (row < top)]
                n = np.bincount(np.searchsorted(e, inside, "right") - 1, minlength=CELLS)
                # below its r largest values a tile cannot hold the one sought
                cell = np.flatnonzero((n > 0) & (n[::-1].cumsum()[::-1] - n < r))
                part.append((np.full(len(cell), label), cell, n[cell]))
        found.append(part)
    return _frame(["t", "cell", "c"], found)


@F.pandas_udf(_lists(t=T.LongType(), y=T.DoubleType(), c=T.LongType()))
def _values(
    same: pd.Series,
    at: pd.Series,
    ax: pd.Series,
    alo: pd.Series,
    ahi: pd.Series,
    aneed: pd.Series,
    bt: pd.Series,
    bx: pd.Series,
    blo: pd.Series,
    bhi: pd.Series,
    bneed: pd.Series,
) -> pd.DataFrame:
    """The largest values in a sample's range with their number, and the least one beyond it, which counts nothing."""
    found = []
    for own, *tiles in zip(same, at, ax, alo, ahi, aneed, bt, bx, blo, bhi, bneed):
        part = []
        for y, (t, _, lo, hi, need), _ in _sides(own, tiles[:5], tiles[5:]):
            falling = -np.sort(-y, axis=1)
            first, end = (falling >= hi[:, None]).sum(axis=1), (falling >= lo[:, None]).sum(axis=1)
            place = np.arange(y.shape[1])
            opens = np.diff(falling, axis=1, prepend=np.inf) != 0
            opens[np.arange(len(t)), np.minimum(first, y.shape[1] - 1)] = True
            r, c = np.nonzero(opens & (place >= first[:, None]) & (place < end[:, None]))
            # equal values are a stretch up to the next one that opens in the row
            upto = np.where(np.append(r[1:], -1) == r, np.append(c[1:], 0), end[r])
            kept = c - first[r] < need[r]
            part.append((t[r][kept], falling[r, c][kept], (upto - c)[kept]))
            beyond = np.flatnonzero(first > 0)
            part.append((t[beyond], falling[beyond, first[beyond] - 1], np.zeros(len(beyond), np.int64)))
        found.append(part)
    return _frame(["t", "y", "c"], found)


@F.pandas_udf(_lists(t=T.LongType(), other=T.LongType(), y=T.DoubleType()))
def _above(same: pd.Series, at: pd.Series, ax: pd.Series, au: pd.Series, bt: pd.Series, bx: pd.Series, bu: pd.Series) -> pd.DataFrame:
    found = []
    for own, *tiles in zip(same, at, ax, au, bt, bx, bu):
        part = []
        for y, (t, _, u), (others, *_) in _sides(own, tiles[:3], tiles[3:]):
            r, c = np.nonzero(y > u[:, None])
            part.append((t[r], others[c], y[r, c]))
        found.append(part)
    return _frame(["t", "other", "y"], found)


def fluidity(over: DataFrame, samples: DataFrame, quantile: float = 0.98) -> DataFrame:
    """Extremal index per sample: (subject, t, theta); NULL where no gap separates the exceedances.

    ``samples`` is (subject, t), so samples without exceedances keep a row.
    """
    gap = F.col("pos") - F.lag("pos").over(W.partitionBy("subject", "t").orderBy("pos"))
    q = 1 - quantile
    sums = (
        over.withColumn("_gap", gap)
        .groupBy("subject", "t")
        .agg(
            F.count("_gap").alias("_n"),
            F.count_if(F.col("_gap") > 1).alias("_c"),
            F.sum((F.col("_gap") - 1) * q).alias("_s"),
        )
    )
    total = F.col("_s") + F.col("_n") + F.col("_c")
    theta = (total - F.sqrt(total * total - 8 * F.col("_c") * F.col("_s"))) / (2 * F.col("_s"))
    return samples.join(sums, ["subject", "t"], "left").select("subject", "t", F.when(F.col("_s") > 0, theta).alias("theta"))


def local_dimension(over: DataFrame, samples: DataFrame, scale: str = "mean_excess") -> DataFrame:
    """Inverse scale of the excess over the threshold, the largest exceedance left out: (subject, t, dimension).

    ``mean_excess`` takes the mean, the scale of an exponential tail. ``l_moments`` takes the scale of a
    generalised Pareto tail from its first two L-moments; it is NULL without two excesses that differ.
    """
    if scale not in SCALES:
        raise ValueError(f"scale must be one of {SCALES}, not {scale!r}")
    excess = F.col("y") - F.col("u")
    if scale == "mean_excess":
        sums = over.groupBy(*SAMPLE).agg((F.sum(excess) - F.max(excess)).alias("_s"), (F.count(F.lit(1)) - 1).alias("_n"))
        size, known = F.col("_s") / F.col("_n"), F.col("_n") > 0
    else:
        # a group holds the exceedances of one sample
        rank = F.row_number().over(W.partitionBy(*SAMPLE).orderBy("y"))
        n = F.count(F.lit(1)).over(W.partitionBy(*SAMPLE))
        kept = over.select(*SAMPLE, excess.alias("_e"), rank.alias("_r"), (n - 1).alias("_n")).where("_r <= _n and _n > 1")
        sums = kept.groupBy(*SAMPLE).agg(
            F.avg("_e").alias("_l1"), (2 * F.avg((F.col("_r") - 1) / (F.col("_n") - 1) * F.col("_e")) - F.avg("_e")).alias("_l2")
        )
        size, known = (F.col("_l1") / F.col("_l2") - 1) * F.col("_l1"), F.col("_l2") > 1e-9 * F.col("_l1")
    return samples.join(sums, SAMPLE, "left").select(*SAMPLE, F.when(known, 1 / (size + EPS)).alias("dimension"))


def percentile_summary(values: DataFrame, members: DataFrame, value: str, levels=(0.05, 0.5, 0.95)) -> DataFrame:
    """Percentiles per subject over its samples, averaged per group: (label, level_idx, level, mean)."""
    per_subject = quantiles(values, ["subject"], value, levels)
    return (
        per_subject.join(members.select("label", "subject"), "subject")
        .groupBy("label", "level_idx", "level")
        .agg(F.avg("quantile").alias("mean"))
    )
