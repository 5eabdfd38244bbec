"""Scores of all windows of all sizes from running sums of a block of samples.

A block is the packed samples of one series and a stretch of time, with the samples that its last
windows reach into. Sums of the samples, their squares and their products are taken once per block; a window of
any size is the difference of two of their places, so a further size costs the same whether it is
short or long. The sums run over centred values in extended precision. A window whose spread is
small beside that of its block, where the difference would cancel, and every window with a null is
worked out from its own samples instead. A window whose samples are all equal scores 0 exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Share of a block's mean square below which a window's is worked out from its samples.
SMALL = 1e-4
#: Scores passed on at a time.
ROWS = 1 << 18
#: Samples x regions x regions of the blocks that are stacked.
STACK = 1 << 18


def _running(x: np.ndarray) -> np.ndarray:
    """Sums of the samples before each place, per block."""
    return np.concatenate([np.zeros_like(x[:, :1]), np.cumsum(x, axis=1)], axis=1)


def direct_correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise covariance of the samples where both are there, over the spreads of each; 0 where one is constant."""
    both = ~(np.isnan(x) | np.isnan(y))
    out = np.zeros(len(x))
    with np.errstate(invalid="ignore", divide="ignore"):
        n = both.sum(axis=1)
        dx = np.where(both, x - (np.where(both, x, 0).sum(axis=1) / n)[:, None], 0.0)
        dy = np.where(both, y - (np.where(both, y, 0).sum(axis=1) / n)[:, None], 0.0)
        scale = _spread(x) * _spread(y)
        r = (dx * dy).sum(axis=1) / (n - 1) / scale
    usable = (n > 1) & (scale > 0)
    out[usable] = r[usable]
    return out


def _spread(x: np.ndarray) -> np.ndarray:
    """Sample standard deviation of each row without its nulls, exactly 0 for equal samples."""
    there = ~np.isnan(x)
    n = there.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        d = np.where(there, x - (np.where(there, x, 0).sum(axis=1) / n)[:, None], 0.0)
        s = np.sqrt((d * d).sum(axis=1) / (n - 1))
    low, high = np.where(there, x, np.inf).min(axis=1), np.where(there, x, -np.inf).max(axis=1)
    return np.where((low >= high) | (n < 2), 0.0, s)


class Blocks:
    """Blocks of equal sample times and regions, worked off together.

    ``x`` is (blocks, samples, regions) with NaN for null, ``there`` marks the cells that exist, ``t`` is ascending.
    """

    def __init__(self, t: np.ndarray, x: np.ndarray, there: np.ndarray, method: str, pairs: tuple[np.ndarray, np.ndarray]):
        self.t, self.x, self.method, self.i, self.j = t, x, method, *pairs
        self.cells = None if there.all() else _running(there.astype(np.int64))
        null = np.isnan(x)
        self.nulls = _running(null.astype(np.int64)) if null.any() else None
        if method == "plv":
            self.agree = _running(np.where((x[:, :, self.i] < 0) == (x[:, :, self.j] < 0), 1.0, -1.0))
            return
        if x.shape[1] > 1:
            self.changes = _running((x[:, 1:] != x[:, :-1]).astype(np.int64))
        filled = np.where(null, 0.0, x)
        c = (filled - filled.mean(axis=1, keepdims=True)).astype(np.longdouble)
        self.sums, self.squares = _running(c), _running(c * c)
        self.products = _running(c[:, :, self.i] * c[:, :, self.j])
        self.usual = (self.squares[:, -1:] / max(1, x.shape[1])).astype(np.float64)

    def scores(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(blocks) x (windows that start at places ``at``) x (pairs): scores and whether both regions have every sample."""
        to = at + size
        if self.cells is None:
            whole = np.ones((len(self.x), len(at), len(self.i)), bool)
        else:
            full = self.cells[:, to] - self.cells[:, at] == size
            whole = full[:, :, self.i] & full[:, :, self.j]
        if self.method == "plv":
            return np.abs(self.agree[:, to] - self.agree[:, at]) / size, whole
        s = self.sums[:, to] - self.sums[:, at]
        v = self.squares[:, to] - self.squares[:, at] - s * s / size
        flat = self.changes[:, to - 1] == self.changes[:, at]
        short = (v <= SMALL * size * self.usual) & ~flat
        if self.nulls is not None:
            short |= self.nulls[:, to] > self.nulls[:, at]
            flat &= self.nulls[:, to] == self.nulls[:, at]
        root = np.sqrt(np.where(flat | short, 1.0, v))
        r = self.products[:, to] - self.products[:, at] - s[:, :, self.i] * s[:, :, self.j] / size
        r = (r / (root[:, :, self.i] * root[:, :, self.j])).astype(np.float64)
        constant = flat[:, :, self.i] | flat[:, :, self.j]
        r[constant] = 0.0
        if short.any():
            again = np.argwhere((short[:, :, self.i] | short[:, :, self.j]) & ~constant)
            step = max(1, ROWS // size)
            for lo in range(0, len(again), step):
                b, w, p = again[lo : lo + step].T
                rows = at[w][:, None] + np.arange(size)
                r[b, w, p] = direct_correlation(self.x[b[:, None], rows, self.i[p][:, None]], self.x[b[:, None], rows, self.j[p][:, None]])
        return r, whole


def _unpacked(samples: pa.Array, k: int):
    """t, regions, matrix and mask of one packed block."""
    rows = samples[k].values
    t = rows.field("t").to_numpy(zero_copy_only=False)
    vec = rows.field("vec")
    lengths = np.diff(vec.offsets.to_numpy())
    cells = vec.flatten()
    region, value = cells.field("region").to_numpy(zero_copy_only=False), cells.field("value").to_numpy(zero_copy_only=False)
    regions = np.unique(region)
    x = np.full((len(t), len(regions)), np.nan)
    there = np.zeros(x.shape, bool)
    row, column = np.repeat(np.arange(len(t)), lengths), np.searchsorted(regions, region)
    x[row, column] = value.astype(np.float64)
    there[row, column] = True
    return t, regions, x, there


def _stacks(batches, method: str, diagonal: bool):
    """(rows of the batch, batch, block number, regions, blocks): neighbouring rows of equal times and regions are stacked."""
    for batch in batches:
        samples, number = batch.column("samples"), batch.column("block").to_numpy()
        held = []
        for k in range(batch.num_rows):
            t, regions, x, there = _unpacked(samples, k)
            alike = held and number[k] == held[0][1] and np.array_equal(t, held[0][2]) and np.array_equal(regions, held[0][3])
            if held and not (alike and (len(held) + 1) * len(t) * len(regions) ** 2 <= STACK):
                yield _stacked(batch, held, method, diagonal)
                held = []
            held.append((k, number[k], t, regions, x, there))
        if held:
            yield _stacked(batch, held, method, diagonal)


def _stacked(batch, held, method, diagonal):
    _, number, t, regions, _, _ = held[0]
    pairs = np.tril_indices(len(regions), 0 if diagonal else -1)
    blocks = Blocks(t, np.stack([h[4] for h in held]), np.stack([h[5] for h in held]), method, pairs)
    return np.array([h[0] for h in held]), batch, number, regions, blocks


def _places(t: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """Those of the places ``begins`` where a window without gaps starts."""
    at = begins[begins + size <= len(t)]
    return at[t[at + size - 1] - t[at] == size - 1]


def _listed(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of ``counts`` values each, one after another."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def window_scores(packed: DataFrame, keys: Sequence[str], windows: Sequence[int], lag: int, span: int, method: str, diagonal: bool) -> DataFrame:
    """(keys, window_size, lag, frame, i, j, fc) from ``packed`` (keys, block, samples array<struct<t, vec>>)."""
    keys, windows = list(keys), list(windows)
    whole = ["window_size", "lag", "frame", "i", "j"]
    schema = T.StructType([packed.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in whole] + [T.StructField("fc", T.DoubleType())])

    def rows(batches):
        for own, batch, number, regions, blocks in _stacks(batches, method, diagonal):
            t, i, j = blocks.t, regions[blocks.i], regions[blocks.j]
            begins = np.flatnonzero((t // span == number) & (t % lag == 0))
            for size in windows:
                at = _places(t, begins, size)
                step = max(1, ROWS // max(1, len(own) * len(i)))
                for lo in range(0, len(at), step):
                    part = at[lo : lo + step]
                    r, complete = blocks.scores(part, size)
                    b, f, p = np.nonzero(complete)
                    made = [np.full(len(f), size), np.full(len(f), lag), t[part][f] // lag, i[p], j[p]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(c).take(pa.array(own[b])) for c in keys] + [pa.array(v.astype(np.int32)) for v in made] + [pa.array(r[b, f, p])],
                        names=[*keys, *whole, "fc"],
                    )

    return packed.mapInArrow(rows, schema)


def window_series(packed: DataFrame, keys: Sequence[str], windows: Sequence[int], lag: int, span: int, method: str) -> DataFrame:
    """(keys, block, window_size, lag, i, j, fc array<double>): the scores of a link over the windows of a block, in order."""
    keys, windows = list(keys), list(windows)
    whole = ["block", "window_size", "lag", "i", "j"]
    schema = T.StructType(
        [packed.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in whole] + [T.StructField("fc", T.ArrayType(T.DoubleType()))]
    )

    def rows(batches):
        for own, batch, number, regions, blocks in _stacks(batches, method, False):
            t, i, j = blocks.t, regions[blocks.i], regions[blocks.j]
            begins = np.flatnonzero((t // span == number) & (t % lag == 0))
            source = pa.array(np.repeat(own, len(i)))
            of_keys = [batch.column(c).take(source) for c in keys]
            for size in windows:
                at = _places(t, begins, size)
                if not len(at) or not len(i):
                    continue
                r, complete = blocks.scores(at, size)
                r, complete = r.transpose(0, 2, 1), complete.transpose(0, 2, 1)
                made = [np.full(len(source), v) for v in (number, size, lag)] + [np.tile(i, len(own)), np.tile(j, len(own))]
                yield pa.RecordBatch.from_arrays(
                    of_keys + [pa.array(v.astype(np.int32)) for v in made] + [_listed(complete.sum(axis=2).ravel(), r[complete], pa.float64())],
                    names=[*keys, *whole, "fc"],
                )

    return packed.mapInArrow(rows, schema)


def row_similarity(a: np.ndarray, b: np.ndarray, method: str) -> np.ndarray:
    """Similarity along the last axis over the places that neither side lacks (NaN); 0 where a side is constant or has no norm."""
    n = float(a.shape[-1])
    lacking = np.isnan(a) | np.isnan(b)
    if lacking.any():
        n = np.maximum((~lacking).sum(axis=-1, keepdims=True), 1).astype(float)
        fill = lambda x: np.where(lacking, 0.0, x)
        ends = lambda x: (np.where(lacking, np.inf, x).min(axis=-1), np.where(lacking, -np.inf, x).max(axis=-1))
    else:
        fill = lambda x: x
        ends = lambda x: (x.min(axis=-1), x.max(axis=-1))
    void = np.zeros(a.shape[:-1], bool)
    if method == "cosine":
        a, b = fill(a), fill(b)
    else:
        for x in (a, b):
            low, high = ends(x)
            void |= low >= high
        a = fill(a - fill(a).sum(axis=-1, keepdims=True) / n)
        b = fill(b - fill(b).sum(axis=-1, keepdims=True) / n)
    dot = lambda x, y: np.einsum("...k,...k->...", x, y)
    norm = np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))
    void |= norm <= 0
    return np.where(void, 0.0, dot(a, b) / np.where(void, 1.0, norm))


def window_speeds(
    packed: DataFrame, keys: Sequence[str], plan: dict[int, list[tuple[int, int, int]]], lag: int, span: int, method: str, clipped: bool
) -> DataFrame:
    """(keys, window_size, tau, step, frame1 array<int>, speed array<double>), frames in order.

    ``plan`` lists (tau, step, guard) per window size. A block carries the samples of the frames up to the largest
    step and guard beyond its own, so frames meet their partners where they are made.
    """
    keys = list(keys)
    whole = ["window_size", "tau", "step"]
    lists = [T.StructField("frame1", T.ArrayType(T.IntegerType())), T.StructField("speed", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([packed.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in whole] + lists)

    def rows(batches):
        for own, batch, number, regions, blocks in _stacks(batches, "pearson", False):
            made = [m for size, steps in plan.items() for m in _speeds_of(blocks, number, span, lag, size, steps, method, clipped)]
            if not made:
                continue
            source = pa.array(np.concatenate([own[m[0]] for m in made]))
            numbers = [np.concatenate([np.full(len(m[0]), m[k]) for m in made]).astype(np.int32) for k in (1, 2, 3)]
            counts = np.concatenate([m[4] for m in made])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(source) for c in keys]
                + [pa.array(v) for v in numbers]
                + [_listed(counts, np.concatenate([m[5] for m in made]), pa.int32()), _listed(counts, np.concatenate([m[6] for m in made]), pa.float64())],
                names=[*keys, *whole, "frame1", "speed"],
            )

    return packed.mapInArrow(rows, schema)


def _speeds_of(blocks: Blocks, number: int, span: int, lag: int, size: int, steps, method: str, clipped: bool):
    """(blocks, size, tau, step, speeds of each block, their first frames, speeds) per step."""
    t = blocks.t
    at = _places(t, np.flatnonzero(t % lag == 0), size)
    if not len(at):
        return
    r, complete = blocks.scores(at, size)
    if not complete.all():
        r = np.where(complete, r, np.nan)
    there = complete.any(axis=2)
    frame = t[at] // lag
    first = np.flatnonzero(t[at] // span == number)

    def place(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.minimum(np.searchsorted(frame, of), len(frame) - 1)
        return found, frame[found] == of

    for tau, step, guard in steps:
        partner, met = place(frame[first] + step)
        behind, guarded = place(frame[first] + guard)
        f, g, h = (x[met & guarded] for x in (first, partner, behind))
        if not len(f):
            continue
        speed = 1 - row_similarity(r[:, f], r[:, g], method)
        if clipped:
            speed = np.clip(speed, -1.0, 2.0)
        usable = there[:, f] & there[:, g] & there[:, h]
        has = np.flatnonzero(usable.any(axis=1))
        if len(has):
            yield has, size, tau, step, usable[has].sum(axis=1), np.broadcast_to(frame[f], usable.shape)[usable].astype(np.int32), speed[usable]


def packed_blocks(blocked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, block, samples): the samples of a block in one row; its size is bounded by the block."""
    place = [*keys, "block"]
    vec = F.array_sort(F.collect_list(F.struct("region", F.col("value").cast("double").alias("value"))))
    samples = blocked.groupBy(*place, "t").agg(vec.alias("vec"))
    return samples.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("t", "vec"))).alias("samples"))
