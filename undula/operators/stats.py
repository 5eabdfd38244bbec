"""Group comparisons (family E).

Rank tests work on value counts ordered by ``running_totals``; a test ends as one row, and only
that row meets scalar maths for its p-value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from undula.functions.partitioning import cut_lineage, spread
from undula.functions.similarity import safe_corr
from undula.functions.tails import chi2_upper, normal_two_sided, t_two_sided
from undula.operators.order_stats import average_rank, average_rank_bounded, medians, running_totals, value_counts
from undula.operators.pairing import correlate_items, slope_histogram, slopes_between, tile_pairs


def mann_whitney(df: DataFrame, group: str, value: str, keys: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """Two-sided U test of every two groups, asymptotic with tie and continuity correction.

    Rows (keys, g1, g2, n1, n2, u, z[, p]); u counts wins of g1 over g2, ties half.
    """
    keys = list(keys)
    counts = value_counts(df, [*keys, group], value)
    # one row per key with its few group labels, unfolded to ordered label pairs
    labels = counts.groupBy(*keys).agg(F.collect_set(group).alias("_all"))
    firsts = labels.select(*keys, "_all", F.explode("_all").alias("_g"))
    pairs = firsts.select(*keys, "_g", F.explode("_all").alias("_h")).where("_g <> _h")
    sides = counts.withColumnRenamed(group, "_g").join(pairs, [*keys, "_g"])
    is_first = F.col("_g") < F.col("_h")
    two = (
        sides.groupBy(*keys, F.least("_g", "_h").alias("g1"), F.greatest("_g", "_h").alias("g2"), value)
        .agg(
            F.sum(F.when(is_first, F.col("cnt")).otherwise(0)).alias("c1"),
            F.sum(F.when(is_first, 0).otherwise(F.col("cnt"))).alias("c2"),
        )
    )
    ordered = running_totals(two, [*keys, "g1", "g2"], value, ["c1", "c2"])
    both = (F.col("c1") + F.col("c2")).cast("double")
    out = ordered.groupBy(*keys, "g1", "g2").agg(
        F.sum("c1").alias("n1"),
        F.sum("c2").alias("n2"),
        F.sum(F.col("c1") * (F.col("before_c2") + F.col("c2") / 2.0)).alias("u"),
        F.sum(both * both * both - both).alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    z = F.try_divide(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, spread)
    out = out.withColumn("z", z).drop("_ties")
    return out.withColumn("p", normal_two_sided(F.col("z"))) if p_values else out


def kruskal_wallis(df: DataFrame, group: str, value: str, keys: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """H test over all groups: rows (keys, n, k, h[, p])."""
    keys = list(keys)
    counts = value_counts(df, [*keys, group], value)
    merged = counts.groupBy(*keys, value).agg(
        F.sum("cnt").alias("n"), F.collect_list(F.struct(group, "cnt")).alias("_groups")
    )
    ordered = running_totals(merged, keys, value, ["n"])
    rank = F.col("before_n") + (F.col("n") + 1) / 2.0
    size = F.col("n").cast("double")
    per_value = ordered.select(
        *keys, rank.alias("_rank"), (size * size * size - size).alias("_t"), F.posexplode("_groups").alias("_pos", "_g")
    )
    per_group = per_value.groupBy(*keys, F.col(f"_g.{group}").alias("_label")).agg(
        F.sum(F.col("_rank") * F.col("_g.cnt")).alias("_r"),
        F.sum("_g.cnt").alias("_n"),
        # a value shared by several groups must count its tie term once
        F.sum(F.when(F.col("_pos") == 0, F.col("_t")).otherwise(0.0)).alias("_ties"),
    )
    n = F.sum("_n").cast("double")
    h = (12 / (n * (n + 1)) * F.sum(F.col("_r") * F.col("_r") / F.col("_n")) - 3 * (n + 1)) / (
        1 - F.sum("_ties") / (n * n * n - n)
    )
    out = per_group.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"), h.alias("h"))
    return out.withColumn("p", chi2_upper(F.col("h"), F.col("k") - 1)) if p_values else out


def benjamini_hochberg(tests: DataFrame, p: str = "p", out: str = "p_fdr", keys: Sequence[str] = ()) -> DataFrame:
    """FDR-adjusted p per family of tests; the family is one row per comparison, hence small."""
    family = W.partitionBy(*keys)
    # ranks by row number; the running minimum from the largest p makes the order of ties irrelevant
    rank = F.row_number().over(family.orderBy(F.col(p)))
    raw = F.col(p) * F.count(p).over(family) / rank
    from_top = family.orderBy(F.col("_rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    return (
        tests.withColumn("_rank", rank)
        .withColumn("_raw", raw)
        .withColumn(out, F.least(F.lit(1.0), F.min("_raw").over(from_top)))
        .drop("_rank", "_raw")
    )


def bonferroni(tests: DataFrame, p: str = "p", out: str = "p_bonferroni", keys: Sequence[str] = ()) -> DataFrame:
    m = F.count(p).over(W.partitionBy(*keys))
    return tests.withColumn(out, F.least(F.col(p) * m, F.lit(1.0)))


def stars(p: str | Column) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """Rank correlation per ``keys`` over complete rows; NULL for fewer than 3 rows."""
    keys = list(keys)
    # one row per subject here, while its history may reach back to the signals
    whole = cut_lineage(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y))
    ranked = average_rank(average_rank(whole, keys, x, "_rx"), keys, y, "_ry")
    n = F.count(F.lit(1))
    out = ranked.groupBy(*keys).agg(n.alias("n"), F.when(n > 2, safe_corr("_rx", "_ry")).alias("rho"))
    if not p_values:
        return out
    rho, dof = F.col("rho"), F.col("n") - 2
    t = F.try_divide(rho * F.sqrt(dof), F.sqrt(1 - rho * rho))
    p = F.when(rho.isNull(), F.lit(None)).when(F.abs(rho) >= 1, F.lit(0.0)).otherwise(t_two_sided(t, dof))
    return out.withColumn("p", p).withColumn("significant", F.col("p") < 0.05)


#: Least and most points of one tile of a Theil-Sen group; between them a group has ``SLOPE_TILES``.
SLOPE_TILE = (2048, 1 << 16)
SLOPE_TILES = 12
#: Pairs of a group that are formed in the last round, and the rounds that narrow down to them at most.
SLOPES_INSIDE = 1 << 20
SLOPE_ROUNDS = 12
#: Points of the largest group whose slopes are a first guess; a group with few of them starts with all angles.
GUESS_POINTS, GUESS_LEAST = 1000, 200


def theil_sen(
    df: DataFrame,
    x: str,
    y: str,
    keys: Sequence[str] = (),
    item: str = "subject",
    tile: int | None = None,
    bins: int = 16,
) -> DataFrame:
    """Median slope over all pairs with different x, and median(y) - slope * median(x).

    Two tiles count the slopes below an angle as the inversions between two orders of their points, without
    forming pairs. Rounds of such counts narrow the two middle slopes down to a sliver of the angle range that
    holds few pairs; a last round forms those and reads their exact slopes. ``item`` identifies a row inside its group.
    Equal points are one with a weight.
    """
    keys = list(keys)
    complete = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    whole = cut_lineage(complete.select(*keys, item, F.col(x).alias("x"), F.col(y).alias("y")))
    points = whole.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("w")).withColumn("_at", F.xxhash64("x", "y"))
    points = cut_lineage(points)
    largest = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if tile is None:
        tile = min(SLOPE_TILE[1], max(SLOPE_TILE[0], largest // SLOPE_TILES))
    # written once, as all rounds read them, and dealt out: the work on them is far larger than their bytes
    tiles = tile_pairs(points, keys, "_at", ["x", "y", "w"], tile)
    tiles = cut_lineage(spread(tiles, F.xxhash64(F.get("a", F.lit(0))["_at"], F.get("b", F.lit(0))["_at"])))
    sides = ["same", *[F.col(f"{side}.{c}") for side in "ab" for c in "xyw"], "low", "high"]

    per_x = points.groupBy(*keys, "x").agg(F.sum("w").alias("w")).groupBy(*keys)
    totals = cut_lineage(per_x.agg(((F.sum("w") * F.sum("w") - F.sum(F.col("w") * F.col("w"))) / 2).cast("long").alias("total")).where("total > 0"))
    half_turn = math.pi / 2 + 1e-9
    whole_turn = totals.select(*keys, F.lit(-half_turn).alias("low"), F.lit(half_turn).alias("high"), "total")
    guess = _likely_angles(points, keys, largest)
    guessed = whole_turn.drop("low", "high").join(guess, keys) if keys else whole_turn.drop("low", "high").crossJoin(guess)
    scope = cut_lineage(guessed.select(*keys, "low", "high", "total"))

    def narrowed(scope):
        counted = _beside(tiles, scope, keys).select(
            *keys, "low", "high", F.posexplode(slope_histogram(*sides, F.lit(bins))).alias("bin", "c")
        )
        # a row per key; uncut, each branch of the next round would repeat all counts
        return cut_lineage(_narrow(counted, scope, keys, bins))

    scope = narrowed(scope)
    if scope.count() < totals.count():
        # the sample of a group misled, or there was none
        scope = narrowed(whole_turn)
    for _ in range(SLOPE_ROUNDS):
        # equal slopes stay together, however narrow the range is
        if (scope.agg(F.max(F.when(F.col("high") - F.col("low") > 1e-9, F.col("inside")))).first()[0] or 0) <= SLOPES_INSIDE:
            break
        scope = narrowed(scope)
    # a little wider than the bins, so that rounding at their edges loses nothing
    more = F.greatest(F.lit(1e-12), (F.col("high") - F.col("low")) / 100)
    scope = scope.select(*keys, (F.col("low") - more).alias("low"), (F.col("high") + more).alias("high"), "total")
    inside = _beside(tiles, scope, keys)
    below = (
        inside.select(*keys, "total", F.element_at(slope_histogram(*sides, F.lit(1)), -1).alias("c"))
        .groupBy(*keys, "total")
        .agg(F.sum("c").alias("below"))
    )
    slopes = inside.select(*keys, F.explode(slopes_between(*sides)).alias("_s"))
    weighed = slopes.groupBy(*keys, F.col("_s.s").alias("s")).agg(F.sum("_s.w").alias("cnt"))
    placed = _beside(running_totals(weighed, keys, "s", ["cnt"]), below, keys)
    start = F.col("below") + F.col("before_cnt")

    def covers(pos: Column) -> Column:
        return ((pos >= start) & (pos < start + F.col("cnt"))).cast("int")

    first, second = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    share = (covers(first) + covers(second)) / 2
    slope = placed.groupBy(*keys).agg(F.sum(share * F.col("s")).alias("slope"))
    med_x, med_y = medians(whole, keys, "x", "_mx"), medians(whole, keys, "y", "_my")
    joined = _beside(_beside(slope, med_x, keys), med_y, keys)
    return joined.select(*keys, "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"))


def _likely_angles(points: DataFrame, keys: list[str], largest: int) -> DataFrame:
    """(keys, low, high): angles between which the median slope is likely to lie, from the slopes of a sample; the counts decide."""
    half_turn = math.pi / 2 + 1e-9
    few = points.where(F.pmod(F.xxhash64("x", "y", F.lit(1)), F.lit(max(1, largest // GUESS_POINTS))) == 0)

    def between(frame: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (frame[c].to_numpy(np.float64) for c in "xyw")
        low, high = -half_turn, half_turn
        if len(x) >= GUESS_LEAST:
            i, j = np.triu_indices(len(x), 1)
            i, j = i[x[i] != x[j]], j[x[i] != x[j]]
            angle, mass = np.arctan((y[j] - y[i]) / (x[j] - x[i])), w[i] * w[j]
            order = np.argsort(angle)
            upto = np.cumsum(mass[order])
            if len(order):
                off = 2.5 / math.sqrt(len(x))
                low, high = (angle[order[min(len(order) - 1, int(np.searchsorted(upto, max(0.0, min(1.0, at)) * upto[-1])))]] for at in (0.5 - off, 0.5 + off))
                # not at a slope itself, as many may equal it
                low, high = low - 1e-7 * (high - low) - 1e-12, high + 1e-7 * (high - low) + 1e-12
        return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in keys}, "low": [low], "high": [high]})

    schema = T.StructType([*(points.schema[k] for k in keys), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    return few.groupBy(*keys).applyInPandas(between, schema)


def _beside(rows: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach one row per key; without keys it is a single row."""
    return rows.join(per_key, list(keys)) if keys else rows.crossJoin(F.broadcast(per_key))


def _narrow(counted, scope, keys, bins):
    """Shrink [low, high) to the bins that hold the two middle slopes."""
    totals = counted.groupBy(*keys, "low", "high", "bin").agg(F.sum("c").alias("c"))
    key = [*keys, "low", "high"]
    # the slot after the last bin counts the angles below the range, so it goes first
    spot = F.when(F.col("bin") == bins, -1).otherwise(F.col("bin"))
    upto = W.partitionBy(*key).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    running = totals.withColumn("bin", spot).withColumn("upto", F.sum("c").over(upto))
    return (
        running.groupBy(*key)
        .agg(F.max("upto").alias("_seen"), F.collect_list(F.struct("bin", "upto", "c")).alias("_bins"))
        .transform(lambda d: _pick(d, keys, scope, bins))
    )


def _pick(found, keys, scope, bins):
    """First and last bin that contain a middle position; no row where one of the two lies outside the range."""
    found = _beside(found, scope.select(*keys, "total"), keys)
    first, second = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    hit = F.filter(
        "_bins",
        lambda b: (b["bin"] >= 0) & (b["upto"] > first) & (b["upto"] - b["c"] <= second) & (b["c"] > 0),
    )
    width = (F.col("high") - F.col("low")) / bins
    bin_low = F.array_min(F.transform("_hit", lambda b: b["bin"]))
    bin_high = F.array_max(F.transform("_hit", lambda b: b["bin"]))
    return (
        found.withColumn("_hit", hit)
        .where((F.size("_hit") > 0) & (F.col("_seen") > second) & (F.array_min(F.transform("_hit", lambda b: b["upto"] - b["c"])) <= first))
        .select(
            *keys,
            (F.col("low") + bin_low * width).alias("low"),
            (F.col("low") + (bin_high + 1) * width).alias("high"),
            "total",
            F.aggregate("_hit", F.lit(0).cast("long"), lambda n, b: n + b["c"]).alias("inside"),
        )
    )


def ols(df: DataFrame, x: str, y: str, keys: Sequence[str], p_values: bool = True) -> DataFrame:
    """Simple regression of y on x: coefficient, intercept[, p]; NULL for 3 rows or fewer."""
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count(F.lit(1))
    out = whole.groupBy(*keys).agg(
        n.alias("n"),
        F.when(n > 3, F.regr_slope(y, x)).alias("coef"),
        F.when(n > 3, F.regr_intercept(y, x)).alias("intercept"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
    )
    rest = (F.col("_syy") - F.col("coef") * F.col("_sxy")) / (F.col("n") - 2)
    t = F.try_divide(F.col("coef"), F.sqrt(F.try_divide(rest, F.col("_sxx"))))
    out = out.withColumn("t", t).drop("_sxx", "_syy", "_sxy")
    if not p_values:
        return out
    return out.withColumn("p", F.when(F.col("t").isNotNull(), t_two_sided(F.col("t"), F.col("n") - 2)))


def matrix_correlation(matrices: DataFrame, graph: str, cell: Sequence[str], value: str, method: str = "pearson") -> DataFrame:
    """Correlation of every two flattened matrices: rows (g1, g2, r). All share the same cells."""
    if method not in ("pearson", "spearman"):
        raise ValueError("method must be 'pearson' or 'spearman'")
    if method == "spearman":
        # one matrix is one group, its size the number of cells
        matrices = matrices.withColumn(value, average_rank_bounded([graph], value))
    cells = matrices.select(graph, F.struct(*cell).alias("_cell"), value)
    return correlate_items(cells, [], graph, "_cell", value, "g1", "g2", "r", tile=None)
