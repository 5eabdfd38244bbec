"""Speed of network change (family C): 1 - similarity(frame f, frame f + step).

The links of one frame are packed into one array before anything is shuffled, so a frame
travels as one compact row. Frames are grouped in blocks that carry the frames of the next
block up to the largest step; ``lead`` then finds the partner frames of all taus in one pass,
without a self-join, and a long stream is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from undula.functions.partitioning import spread
from undula.functions.similarity import check_method, clip, similarity
from undula.operators.connectivity import sample_blocks
from undula.operators.order_stats import average_rank_bounded, medians
from undula.operators.sliding import window_speeds

COUNTS = ("unified", "classic")
MATRICES = ("triangle", "full")


def dfc_speed(
    dfc: DataFrame,
    step: int = 1,
    method: str = "pearson",
    count: str = "unified",
    matrix: str = "triangle",
    keys: Sequence[str] = ("subject",),
    check_frames: bool | None = None,
) -> DataFrame:
    """Speeds of a stream: rows (keys, window_size, frame1, frame2, speed).

    ``unified`` yields n - step - 1 speeds, clipped to [-1, 2]; ``classic`` yields n - step,
    unclipped. ``full`` compares whole matrices (both triangles and a unit diagonal).
    A stream with no more than ``step`` frames is an error: the job that reads the speeds fails, without
    any pass of its own for the check. ``check_frames`` True counts first and raises here; False gives
    such streams no rows.
    """
    _check_step(step)
    check_method(method)
    check_method(count, COUNTS)
    check_method(matrix, MATRICES)
    if check_frames:
        require_frames(dfc, step, keys)
    guard = step + 1 if count == "unified" else step
    speeds = _speeds(dfc, 0, step, guard, method, keys, matrix, clipped=count == "unified", strict=check_frames is None)
    return speeds.drop("tau")


def require_frames(dfc: DataFrame, step: int, keys: Sequence[str] = ("subject",)) -> None:
    """Raise when any stream has no more than ``step`` frames."""
    lengths = dfc.groupBy(*keys, "window_size").agg((F.max("frame") + 1).alias("n"))
    shortest = lengths.agg(F.min("n")).first()[0]
    if shortest is not None and step >= shortest:
        raise ValueError(f"step ({step}) must be less than number of frames ({shortest})")


def split_speed(
    dfc: DataFrame,
    windows: Sequence[int],
    taus: Sequence[int],
    time_offset: int | str = "window",
    method: str = "pearson",
    keys: Sequence[str] = ("subject",),
) -> DataFrame:
    """Speeds per tau at step window + tau + offset over the frame range shared by all taus.

    ``time_offset`` 'window' uses the window size. Rows (keys, window_size, tau, frame1, frame2, speed).
    """
    check_method(method)
    plan = {}
    for size in windows:
        base = size + (size if time_offset == "window" else int(time_offset))
        plan[size] = [(size, tau, base + tau, base + max(taus) + 1) for tau in taus]
    return _per_window(dfc, plan, method, keys, clipped=True)


def partner_frames(dfc: DataFrame, windows, taus, time_offset="window", keys=("subject",)) -> DataFrame:
    """Frame index pairs of ``split_speed`` without computing any similarity."""

    spans = dfc.groupBy(*keys, "window_size").agg((F.max("frame") + 1).alias("n"))
    parts = []
    for size in windows:
        base = size + (size if time_offset == "window" else int(time_offset))
        n_pairs = F.col("n") - (base + max(taus)) - 1
        rows = (
            spans.where(F.col("window_size") == size)
            .where(n_pairs > 0)
            .select(*keys, "window_size", F.explode(F.sequence(F.lit(0), (n_pairs - 1).cast("int"))).alias("frame1"))
            .select("*", F.explode(F.array(*[F.lit(t) for t in taus])).alias("tau"))
            .withColumn("frame2", F.col("frame1") + F.col("tau") + base)
        )
        parts.append(rows)
    return _union(parts)


def partner_networks(dfc: DataFrame, step: int, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Links of the second frame of every unified pair: rows (keys, window_size, frame1, frame2, pair_id, fc2)."""
    _check_step(step)
    stream = [*keys, "window_size"]
    last = dfc.groupBy(*stream).agg(F.max("frame").alias("_last"))
    frame1 = F.col("frame") - step
    return (
        dfc.join(last, stream)
        .where((frame1 >= 0) & (F.col("frame") < F.col("_last")))
        .select(*stream, frame1.alias("frame1"), F.col("frame").alias("frame2"), "pair_id", F.col("fc").alias("fc2"))
    )


def oversampled_speed(
    dfc: DataFrame,
    windows: Sequence[int],
    tau: int = 3,
    min_tau_zero: bool = False,
    method: str = "pearson",
    keys: Sequence[str] = ("subject",),
) -> DataFrame:
    """Speed distribution for taus in [-tau, tau] (or [0, tau]) at step window + tau.

    Every tau keeps the first n - window - tau speeds, so all taus cover the same frames.
    """
    check_method(method)
    taus = range(0 if min_tau_zero else -tau, tau + 1)
    plan = {size: [(size, t, size + t, size + tau) for t in taus] for size in windows}
    return _per_window(dfc, plan, method, keys, clipped=False)


def signal_speeds(
    signals: DataFrame,
    windows: Sequence[int],
    tau: int = 3,
    min_tau_zero: bool = False,
    method: str = "pearson",
    keys: Sequence[str] = ("subject",),
    lag: int = 1,
) -> DataFrame:
    """``oversampled_speed`` of the streams of ``signals``: (keys, window_size, tau, step, frame1 array<int>, speed array<double>).

    Streams are not written out: a block of samples carries what its last frames' partners need, so samples are
    shuffled once and speeds are made beside the windows. A row holds the speeds of one block; ``speed_rows`` unfolds them.
    """
    check_method(method, ("pearson", "cosine"))
    taus = range(0 if min_tau_zero else -tau, tau + 1)
    plan = {size: [(t, size + t, size + tau) for t in taus] for size in windows}
    for rows in plan.values():
        for _, step, _ in rows:
            _check_step(step)
    packed, span = sample_blocks(signals, max(size - 1 + lag * (size + tau) for size in plan), keys)
    return window_speeds(packed, keys, plan, lag, span, method, clipped=False)


def speed_rows(packed: DataFrame) -> DataFrame:
    """One row per speed of ``signal_speeds``: (keys, window_size, tau, frame1, frame2, speed)."""
    kept = [c for c in packed.columns if c not in ("step", "frame1", "speed")]
    rows = packed.select(*kept, "step", F.explode(F.arrays_zip("frame1", "speed")).alias("_s"))
    return rows.select(*kept, F.col("_s.frame1").alias("frame1"), (F.col("_s.frame1") + F.col("step")).alias("frame2"), F.col("_s.speed").alias("speed"))


def oversampled_medians(dfc, windows, tau=3, min_tau_zero=False, method="pearson", keys=("subject",)) -> DataFrame:
    """Median of the oversampled speeds per (keys, window_size, tau)."""
    rows = oversampled_speed(dfc, windows, tau, min_tau_zero, method, keys)
    return medians(rows, [*keys, "window_size", "tau"], "speed", "median_speed")


def batch_speed(dfc: DataFrame, windows: Sequence[int], lag: int, method: str = "pearson") -> DataFrame:
    """Unified speed of several stored streams, each at step max(1, window // lag)."""
    check_method(method)
    steps = {size: max(1, size // lag) for size in windows}
    plan = {size: [(size, 0, step, step + 1)] for size, step in steps.items()}
    return _per_window(dfc, plan, method, ("subject",), clipped=True).drop("tau")


def median_speed(speeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    return medians(speeds, keys, "speed", "median_speed")


def marginal_means(medians_: DataFrame) -> DataFrame:
    """Mean, range and count of median speed by subject, by window, by tau and overall."""
    kind = (
        F.when(F.grouping("subject") == 0, "subject")
        .when(F.grouping("window_size") == 0, "window_size")
        .when(F.grouping("tau") == 0, "tau")
        .otherwise("all")
    )
    return medians_.groupingSets(
        [["subject"], ["window_size"], ["tau"], []], "subject", "window_size", "tau"
    ).agg(
        kind.alias("margin"),
        F.avg("median_speed").alias("mean_speed"),
        F.min("median_speed").alias("min_speed"),
        F.max("median_speed").alias("max_speed"),
        F.count("median_speed").alias("n"),
    )


def _check_step(step: int) -> None:
    if isinstance(step, bool) or int(step) != step or step <= 0:
        raise ValueError("step must be a positive integer")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _per_window(dfc, plan, method, keys, clipped):
    """Speeds with steps that depend on the window size, in one pass for any number of sizes.

    A frame goes, for each step of its own size only, to the pairs it starts, ends or guards; the
    block it is in already holds all three, so pairs meet without another shuffle.
    """
    for _, _, step, _ in (row for rows in plan.values() for row in rows):
        _check_step(step)
    stream = [*keys, "window_size"]
    reach = max(max(step, guard) for rows in plan.values() for _, _, step, guard in rows)
    listed = dfc.where(F.col("window_size").isin(list(plan)))
    blocked, span = _blocked(_packed_frames(listed, stream, method, "triangle"), stream, reach)
    entries = []
    for size, rows in plan.items():
        steps = [
            F.struct(F.lit(tau).alias("tau"), F.lit(step).alias("step"), F.lit(guard).alias("guard")) for _, tau, step, guard in rows
        ]
        entries += [F.lit(size), F.array(*steps)]
    parts = F.transform(
        F.element_at(F.create_map(*entries), F.col("window_size")),
        lambda s: F.array(
            F.struct(s["tau"].alias("tau"), s["step"].alias("step"), F.col("frame").alias("frame1"), F.lit(0).alias("role")),
            F.struct(s["tau"].alias("tau"), s["step"].alias("step"), (F.col("frame") - s["step"]).alias("frame1"), F.lit(1).alias("role")),
            F.struct(s["tau"].alias("tau"), s["step"].alias("step"), (F.col("frame") - s["guard"]).alias("frame1"), F.lit(2).alias("role")),
        ),
    )
    given = blocked.select(*stream, "block", "links", F.explode(F.flatten(parts)).alias("p"))
    given = given.where((F.col("p.frame1") >= 0) & (F.floor(F.col("p.frame1") / span) == F.col("block")))
    pairs = (
        given.groupBy(*stream, "block", "p.tau", "p.step", "p.frame1")
        .agg(
            F.first(F.when(F.col("p.role") == 0, F.col("links")), ignorenulls=True).alias("a"),
            F.first(F.when(F.col("p.role") == 1, F.col("links")), ignorenulls=True).alias("b"),
            F.max(F.col("p.role")).alias("guarded"),
        )
        .where("a is not null and b is not null and guarded = 2")
        .select(*stream, "block", "tau", "frame1", (F.col("frame1") + F.col("step")).alias("frame2"), "a", "b")
    )
    return _compared(pairs, stream, method, clipped)


def _blocked(frames, stream, reach):
    """Frames with the blocks they are needed in: their own and the one before, ``reach`` frames ahead."""
    span = max(256, 8 * reach)
    first = F.greatest(F.floor((F.col("frame") - reach) / span), F.lit(0))
    block = F.explode(F.sequence(first.cast("int"), F.floor(F.col("frame") / span).cast("int")))
    return spread(frames.select("*", block.alias("block")), *stream, "block"), span


def _compared(pairs, stream, method, clipped):
    speed = 1 - similarity(method, F.col("l.a"), F.col("l.b"))
    if clipped:
        speed = clip(speed, -1.0, 2.0)
    cells = pairs.select(*stream, "block", "tau", "frame1", "frame2", F.explode(F.arrays_zip("a", "b")).alias("l"))
    return (
        cells.groupBy(*stream, "block", "tau", "frame1", "frame2")
        .agg(speed.alias("speed"))
        .select(*stream, "tau", "frame1", "frame2", "speed")
    )


def _speeds(dfc, tau, step, guard, method, keys, matrix, clipped, strict=False):
    """Similarity of frame f with f + step, where frame f + guard exists, at one step for all streams.

    Block 0 holds more frames than ``step``, so a stream is too short if all that it has lie there.
    """
    stream = [*keys, "window_size"]
    blocked, span = _blocked(_packed_frames(dfc, stream, method, matrix), stream, max(step, guard))
    ahead = W.partitionBy(*stream, "block").orderBy("frame")
    usable = (F.floor(F.col("frame") / span) == F.col("block")) & F.col("guarded").isNotNull()
    if strict:
        blocked = blocked.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*stream, "block")))
        short = (F.col("block") == 0) & (F.col("_n") <= step)
        message = F.concat(F.lit(f"step ({step}) must be less than number of frames ("), F.col("_n").cast("string"), F.lit(")"))
        usable = F.when(short, F.raise_error(message).cast("boolean")).otherwise(usable)
    paired = (
        blocked.withColumn("b", F.lead("links", step).over(ahead))
        .withColumn("guarded", F.lead("frame", guard).over(ahead))
        .where(usable)
        .select(
            *stream, "block", F.lit(tau).alias("tau"), F.col("frame").alias("frame1"), (F.col("frame") + step).alias("frame2"),
            F.col("links").alias("a"), "b",
        )
    )
    return _compared(paired, stream, method, clipped)


def _packed_frames(dfc, stream, method, matrix):
    value = "fc"
    if matrix == "full":
        dfc = _whole_matrix(dfc, stream)
    if method == "spearman":
        dfc = dfc.withColumn("_rank", average_rank_bounded([*stream, "frame"], "fc"))
        value = "_rank"
    packed = F.array_sort(F.collect_list(F.struct("pair_id", F.col(value).alias("v"))))
    return (
        dfc.groupBy(*stream, "frame").agg(packed.alias("_p")).select(*stream, "frame", F.col("_p.v").alias("links"))
    )


def _whole_matrix(dfc, stream):
    """Links of both triangles plus the unit diagonal, numbered so that frames align."""
    cols = [*stream, "frame"]
    n = 1_000_000_007  # any offset beyond the largest pair id keeps the three parts apart
    both = dfc.select(
        *cols,
        F.explode(F.array(F.col("pair_id").cast("long"), F.col("pair_id").cast("long") + n)).alias("pair_id"),
        "fc",
    )
    ends = F.explode(F.array("i", "j"))
    diagonal = (
        dfc.select(*cols, ends.alias("r"))
        .distinct()
        .select(*cols, (F.col("r").cast("long") + 2 * n).alias("pair_id"), F.lit(1.0).alias("fc"))
    )
    return both.unionByName(diagonal)
