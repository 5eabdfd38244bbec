"""Correlation networks and sliding-window network streams (family B).

Region pairs are never built by joining the signals with themselves. The regions of one
sample (a set bounded by the number of channels) are packed into one row, and pairs are
unfolded from it, so only single-region rows are shuffled.

Sliding windows run on blocks of consecutive samples that carry the ``window - 1`` samples
of the next block along. Rows are shuffled once by (subject, block); the packing and the windows
of every size (``sliding``) reuse that partitioning. A subject that holds most of the samples is
spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from undula.functions.partitioning import spread
from undula.functions.similarity import check_method, phase_locking, safe_corr
from undula.operators.pairing import correlate_items
from undula.operators.sliding import packed_blocks, window_scores, window_series

FC_METHODS = ("pearson", "plv")
LAYOUTS = ("triangle", "full")


def pair_id(i: str = "i", j: str = "j"):
    """Row-major position of (i, j), i > j, in the strict lower triangle."""
    return (F.col(i) * (F.col(i) - 1) / 2 + F.col(j)).cast("int")


def sample_vectors(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (keys, t) with its regions packed in order: ``vec array<struct<region, value>>``."""
    return signals.groupBy(*keys, "t").agg(
        F.array_sort(F.collect_list(F.struct("region", "value"))).alias("vec")
    )


def unfold_pairs(vectors: DataFrame, keep: Sequence[str], diagonal: bool = False) -> DataFrame:
    """Rows (keep, i, j, x, y) with i > j (i >= j when ``diagonal``) from packed samples."""
    upto = F.col("pos") + (1 if diagonal else 0)
    return (
        vectors.select(*keep, "vec", F.posexplode("vec").alias("pos", "a"))
        .where(upto > 0)
        .select(*keep, "a", F.explode(F.slice("vec", 1, upto)).alias("b"))
        .select(
            *keep,
            F.col("a.region").alias("i"),
            F.col("b.region").alias("j"),
            F.col("a.value").alias("x"),
            F.col("b.value").alias("y"),
        )
    )


def fc_matrix(
    signals: DataFrame,
    method: str = "pearson",
    layout: str = "triangle",
    keys: Sequence[str] = ("subject",),
) -> DataFrame:
    """Static network per ``keys``: rows (keys, i, j, fc).

    ``full`` mirrors the triangle and adds the diagonal: 0 for Pearson networks, 1 for phase locking.
    """
    check_method(method, FC_METHODS)
    check_method(layout, LAYOUTS)
    score = safe_corr("x", "y") if method == "pearson" else phase_locking("x", "y")
    pairs = unfold_pairs(sample_vectors(signals, keys), keys)
    triangle = pairs.groupBy(*keys, "i", "j").agg(score.alias("fc"))
    if layout == "triangle":
        return triangle
    diagonal = signals.select(
        *keys,
        F.col("region").alias("i"),
        F.col("region").alias("j"),
        F.lit(0.0 if method == "pearson" else 1.0).alias("fc"),
    ).distinct()
    return mirror(triangle).unionByName(diagonal)


def mirror(triangle: DataFrame) -> DataFrame:
    """Both (i, j) and (j, i) for every off-diagonal row."""
    ends = F.explode(
        F.array(
            F.struct(F.col("i").alias("i"), F.col("j").alias("j")),
            F.struct(F.col("j").alias("i"), F.col("i").alias("j")),
        )
    )
    rest = [c for c in triangle.columns if c not in ("i", "j")]
    return triangle.select(*rest, ends.alias("e")).select(
        *[c for c in rest if c != "fc"], "e.i", "e.j", *[c for c in rest if c == "fc"]
    )


def dfc_stream(
    signals: DataFrame,
    windows: int | Sequence[int],
    lag: int | None = 1,
    layout: str = "2D",
    method: str = "pearson",
    keys: Sequence[str] = ("subject",),
) -> DataFrame:
    """Network of every window: rows (keys, window_size, lag, frame, i, j, pair_id, fc).

    Frame k covers samples [k*lag, k*lag + window). ``lag`` None or 0 means lag = window.
    '3D' adds the diagonal and the mirrored triangle. All window sizes that share a lag are
    computed from one shuffle and one sort.
    """
    windows = [windows] if isinstance(windows, int) else list(windows)
    check_method(method, FC_METHODS)
    if layout not in ("2D", "3D"):
        raise ValueError(f"unsupported layout {layout!r}, use '2D' or '3D'")
    if not windows or min(windows) < 2:
        raise ValueError("window sizes must be at least 2")
    if lag is not None and lag < 0:
        raise ValueError("lag must not be negative")

    overlapping = [w for w in windows if lag and lag * 4 < w]
    parts = [_stepped(signals, w, lag or w, keys, method, layout == "3D") for w in windows if w not in overlapping]
    if overlapping:
        parts.insert(0, _sliding(signals, overlapping, lag, keys, method, layout == "3D"))
    stream = parts[0]
    for part in parts[1:]:
        stream = stream.unionByName(part)
    if layout == "3D":
        upper = stream.where("i > j").select(
            *[F.col(c) for c in (*keys, "window_size", "lag", "frame")],
            F.col("j").alias("i"),
            F.col("i").alias("j"),
            "fc",
        )
        return stream.unionByName(upper)
    return stream.withColumn("pair_id", pair_id()).select(
        *keys, "window_size", "lag", "frame", "i", "j", "pair_id", "fc"
    )


def _score(method: str):
    return safe_corr("x", "y") if method == "pearson" else phase_locking("x", "y")


def _sliding(signals, windows, lag, keys, method, diagonal):
    """Windows that overlap much: blocks of samples are packed, every size reads the same running sums."""
    packed, span = sample_blocks(signals, max(windows) - 1, keys)
    return window_scores(packed, keys, windows, lag, span, method, diagonal)


def sample_blocks(signals: DataFrame, reach: int, keys: Sequence[str] = ("subject",)) -> tuple[DataFrame, int]:
    """Packed blocks of samples that carry ``reach`` samples of the next ones along, and the samples of a block."""
    span = max(256, 8 * (reach + 1))
    first = F.greatest(F.floor((F.col("t") - reach) / span), F.lit(0))
    block = F.explode(F.sequence(first.cast("int"), F.floor(F.col("t") / span).cast("int")))
    blocked = spread(signals.select(*keys, "t", "region", "value", block.alias("block")), *keys, "block")
    return packed_blocks(blocked, keys), span


def link_series(signals: DataFrame, windows: Sequence[int], lag: int = 1, method: str = "pearson", keys: Sequence[str] = ("subject",)) -> DataFrame:
    """The stream of ``dfc_stream`` with a row per link and block: (keys, block, window_size, lag, i, j, fc array<double>), frames in order.

    A summary of every link over its frames reads this form, which is far smaller than a row per frame.
    """
    check_method(method, FC_METHODS)
    if not windows or min(windows) < 2 or lag < 1:
        raise ValueError("window sizes must be at least 2 and the lag at least 1")
    packed, span = sample_blocks(signals, max(windows) - 1, keys)
    return window_series(packed, keys, windows, lag, span, method)


def _stepped(signals, size, lag, keys, method, diagonal):
    """Windows that overlap little: each sample is copied to the few frames that hold it."""
    first = F.greatest(F.ceil((F.col("t") - (size - 1)) / lag), F.lit(0)).cast("int")
    last = F.floor(F.col("t") / lag).cast("int")
    frames = F.explode(F.when(first <= last, F.sequence(first, last)))
    framed = spread(signals.withColumn("frame", frames), *keys, "frame")
    place = [*keys, "frame"]
    pairs = unfold_pairs(sample_vectors(framed, place), place, diagonal)
    return (
        pairs.groupBy(*place, "i", "j")
        .agg(_score(method).alias("fc"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == size)
        .select(*keys, F.lit(size).alias("window_size"), F.lit(lag).alias("lag"), "frame", "i", "j", "fc")
    )


def community_dfc(
    signals: DataFrame,
    partition: DataFrame,
    windows: int | Sequence[int],
    lag: int | None = 1,
) -> DataFrame:
    """Stream restricted to pairs inside one community; adds key ``community``.

    ``partition`` is (region, community), one row per channel, hence broadcast-sized.
    """
    member = signals.join(F.broadcast(partition.select("region", "community")), "region")
    return dfc_stream(member, windows, lag, keys=("subject", "community"))


def pack_links(dfc: DataFrame, keys: Sequence[str], value: str = "fc") -> DataFrame:
    """One row per ``keys`` with its links packed in pair order: ``links array<double>``."""
    packed = F.array_sort(F.collect_list(F.struct("pair_id", value)))
    return dfc.groupBy(*keys).agg(packed.alias("_p")).select(*keys, F.col(f"_p.{value}").alias("links"))


def unpack_links(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Symmetric matrix with unit diagonal rebuilt from packed links."""
    rows = packed.select(*keys, F.size("links").alias("_n"), F.posexplode("links").alias("pair_id", "fc"))
    # i is the largest integer with i*(i-1)/2 <= pair_id
    i = F.floor((F.sqrt(F.col("pair_id") * 8 + 1) + 1) / 2).cast("int")
    cells = rows.withColumn("i", i).withColumn(
        "j", (F.col("pair_id") - F.col("i") * (F.col("i") - 1) / 2).cast("int")
    )
    n_regions = F.floor((F.sqrt(F.size("links") * 8 + 1) + 1) / 2).cast("int")
    diagonal = packed.select(*keys, F.explode(F.sequence(F.lit(0), n_regions - 1)).alias("i")).select(
        *keys, "i", F.col("i").alias("j"), F.lit(1.0).alias("fc")
    )
    return mirror(cells.select(*keys, "i", "j", "fc")).unionByName(diagonal)


def fcd(dfc: DataFrame, tile: int = 64) -> DataFrame:
    """Correlation between every two frames of a stream: rows (subject, window_size, f1, f2, r), f1 < f2.

    Frames are packed and hashed into tiles; each pair of tiles is one small group, so the
    quadratic output of a long stream is spread over (number of tiles)^2 / 2 groups.
    """
    return correlate_items(dfc, ["subject", "window_size"], "frame", "pair_id", "fc", "f1", "f2", "r", tile)


def is_symmetric(matrix: DataFrame, keys: Sequence[str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Per ``keys`` whether every (i, j) agrees with (j, i) within tolerance."""
    low, high = F.least("i", "j"), F.greatest("i", "j")
    sides = (
        matrix.where("i <> j")
        .groupBy(*keys, high.alias("_hi"), low.alias("_lo"))
        .agg(
            F.max(F.when(F.col("i") > F.col("j"), F.col("fc"))).alias("a"),
            F.max(F.when(F.col("i") < F.col("j"), F.col("fc"))).alias("b"),
        )
    )

    def off(a: str, b: str):
        return F.abs(F.col(a) - F.col(b)) > atol + rtol * F.abs(F.col(b))

    bad = F.coalesce(off("a", "b") | off("b", "a"), F.lit(True))
    return sides.groupBy(*keys).agg((F.count_if(bad) == 0).alias("symmetric"))


def reorder(matrix: DataFrame, order: DataFrame, order_keys: Sequence[str] = ()) -> DataFrame:
    """Rename rows and columns to their positions: ``order`` is (order_keys, node, pos)."""
    rows = order.select(*order_keys, F.col("node").alias("i"), F.col("pos").alias("_pi"))
    cols = order.select(*order_keys, F.col("node").alias("j"), F.col("pos").alias("_pj"))
    kept = [c for c in matrix.columns if c not in ("i", "j")]
    return (
        matrix.join(rows, [*order_keys, "i"])
        .join(cols, [*order_keys, "j"])
        .select(*kept, F.col("_pi").alias("i"), F.col("_pj").alias("j"))
    )


def mean_matrix(matrix: DataFrame, members: DataFrame, cell: Sequence[str], value: str) -> DataFrame:
    """Mean of a matrix over the subjects of each group: rows (label, cell, value)."""
    return (
        matrix.join(members.select("label", "subject"), "subject")
        .groupBy("label", *cell)
        .agg(F.avg(value).alias(value))
    )


def mean_over_frames(dfc: DataFrame) -> DataFrame:
    return dfc.groupBy("subject", "window_size", "i", "j").agg(F.avg("fc").alias("mean_fc"))


def adjacency(dfc: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Links whose absolute value exceeds the threshold."""
    return dfc.where(F.abs(F.col("fc")) > threshold)
