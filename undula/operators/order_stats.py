"""Ranks, cumulative counts and exact quantiles without one task per group.

A group may hold a third of all rows, so no group is ever sorted by one task.
Values are first collapsed to (value, weight) with map-side combine, which removes
ties. Each value then falls into a cell by a fixed monotone rule (its logarithm, cut
finely); rows are sorted inside (group, cell) only, and the totals of the cells before
give the offset. A cell with more values than a budget is cut evenly between its smallest and its
largest value, and what is still too full once more, from counts that are combined in the tasks.
The rules do not depend on the order in which rows arrive, so a recomputed task lands every row in
the same cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from undula.functions.partitioning import cut_lineage

CELLS_PER_OCTAVE = 128
#: Distinct values that one cell may hold before it is cut.
CELL_BUDGET = 1 << 18
#: At most so many cells are cut at a time, which bounds the table of them that is broadcast.
MOST_CUT = 50_000
#: A cell is cut by its logarithm, then twice evenly.
CELL = ["_cell", "_cell1", "_cell2"]


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value) with its multiplicity ``cnt``; missing values dropped."""
    clean = _whole_keys(df, [*keys, value])
    if dict(df.dtypes)[value] in ("double", "float"):
        clean = clean.where(~F.isnan(value))
    return clean.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))


def _whole_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a missing key. The joins below drop the others anyhow; said here, both branches
    of a join keep the same plan and share one shuffle."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def running_totals(df: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str]) -> DataFrame:
    """Add ``before_<w>`` (total of smaller values) and ``total_<w>`` per weight.

    ``df`` holds one row per (keys, value). Columns beside keys, value and weights pass through.
    """
    cell_key = [*keys, *CELL]
    celled = in_cells(_whole_keys(df, keys), keys, value)
    totals = celled.groupBy(*cell_key).agg(*[F.sum(w).alias(f"_in_cell_{w}") for w in weights])
    whole = W.partitionBy(*keys)
    offsets = totals.select(
        *cell_key,
        *[_before(keys, CELL, f"_in_cell_{w}").alias(f"_offset_{w}") for w in weights],
        *[F.sum(f"_in_cell_{w}").over(whole).alias(f"total_{w}") for w in weights],
    )
    local = celled.select("*", *[_before(cell_key, [value], w).alias(f"_local_{w}") for w in weights])
    joined = local.join(offsets, cell_key)
    before = [(F.col(f"_offset_{w}") + F.col(f"_local_{w}")).alias(f"before_{w}") for w in weights]
    return joined.select("*", *before).drop(
        *CELL, *[f"_local_{w}" for w in weights], *[f"_offset_{w}" for w in weights]
    )


def cell_of(value: str) -> Column:
    """Monotone integer of a number: sign and finely cut logarithm of its size."""
    v = F.col(value).cast("double")
    size = F.floor((F.log2(F.abs(v)) + 1100) * CELLS_PER_OCTAVE).cast("int") + 1
    return F.coalesce(F.when(v > 0, size).when(v < 0, -size).otherwise(0), F.lit(0))


def in_cells(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``df`` (one row per keys and value) with the columns ``CELL``, in whose order cells follow one another.

    Cells above ``CELL_BUDGET``, or above a ``MOST_CUT``-th of all values if that is more, are cut into
    parts of that size on average. Values that crowd inside such a part are cut by the second pass.
    """
    celled = df.withColumn(CELL[0], cell_of(value))
    for k in (1, 2):
        place = [*keys, *CELL[:k]]
        v = F.col(value).cast("double")
        sizes = celled.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        total = sizes.agg(F.greatest(F.lit(CELL_BUDGET), F.coalesce(F.sum("_n"), F.lit(0)) / MOST_CUT).alias("_most"))
        full = sizes.crossJoin(F.broadcast(total)).where((F.col("_n") > F.col("_most")) & (F.col("_hi") > F.col("_lo")))
        parts = F.least(F.ceil(F.col("_n") / F.col("_most")), F.lit(1 << 20)).alias("_parts")
        full = full.select(*[F.col(c).alias(f"_of_{c}") for c in place], "_lo", "_hi", parts)
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in place]
        part = F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_parts")), F.col("_parts") - 1)
        cut = celled.join(F.broadcast(full), same, "left")
        celled = cut.select(*celled.columns, F.coalesce(part, F.lit(0)).cast("int").alias(CELL[k]))
    return celled


def average_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str
) -> DataFrame:
    """Add the 1-based rank of ``value`` inside ``keys``, ties sharing their average rank."""
    counts = running_totals(value_counts(df, keys, value), keys, value, ["cnt"])
    ranks = counts.select(
        *keys, value, (F.col("before_cnt") + (F.col("cnt") + 1) / 2.0).alias(out)
    )
    return df.join(ranks, [*keys, value])


def average_rank_bounded(keys: Sequence[str], value: str) -> Column:
    """Average rank as a window expression, for groups of a known small size.

    Used where the group is one frame or one matrix, whose size is the number of links.
    """
    w = W.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(W.partitionBy(*keys, value))
    return F.rank().over(w.orderBy(value)) + (ties - 1) / 2.0


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, positions: Column, many: bool = False
) -> DataFrame:
    """Pick the values at given 0-based sorted positions of each group: rows (keys, n, tag, value).

    ``positions`` is an ``array<struct<tag, pos>>`` expression over the keys and the group size
    ``n``, evaluated once per group; its length is set by parameters, not by the data. Only cells
    that contain a wanted position are sorted. ``many`` finds the cells of the positions by one
    sort per group instead of a scan per position.
    """
    keys, cell_key = list(keys), [*keys, *CELL]
    counts = value_counts(df, keys, value)
    # written once: the cuts of the cells, their totals and their values read it
    celled = in_cells(cut_lineage(counts) if many else counts, keys, value)
    totals = celled.groupBy(*cell_key).agg(F.sum("cnt").alias("_in_cell"))
    spans = totals.select("*", _before(keys, CELL, "_in_cell").alias("_start"))
    if many:
        return _values_by_sort(celled, _cells_by_sort(spans, keys, positions), keys, value)
    hits = _cells_by_scan(spans, keys, positions)
    hits = hits.groupBy(*keys, "n", *CELL, "_start").agg(F.collect_list("_w").alias("_hits"))
    here = F.col("_start") + _before(cell_key, [value], "cnt")
    mine = F.filter(
        "_hits", lambda p: (p["pos"] >= F.col("_here")) & (p["pos"] < F.col("_here") + F.col("cnt"))
    )
    return (
        celled.join(hits, cell_key)
        .withColumn("_here", here)
        .select(*keys, "n", value, F.explode(mine).alias("_hit"))
        .select(*keys, "n", F.col("_hit.tag").alias("tag"), value)
    )


def _values_by_sort(celled: DataFrame, hits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of each wanted position: values and positions of a cell are sorted together, so that none is repeated."""
    cell_key = [*keys, *CELL]
    held = celled.select(*cell_key, _before(cell_key, [value], "cnt").alias("_at"), value)
    wanted = hits.select(*cell_key, (F.col("_w.pos") - F.col("_start")).alias("_at"), "n", F.col("_w.tag").alias("_tag"))
    upto = W.partitionBy(*cell_key).orderBy("_at", F.col("_tag").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    return (
        held.unionByName(wanted, allowMissingColumns=True)
        .withColumn("_found", F.last(value, ignorenulls=True).over(upto))
        .where(F.col("_tag").isNotNull())
        .select(*keys, "n", F.col("_tag").alias("tag"), F.col("_found").alias(value))
    )


def _cells_by_scan(spans: DataFrame, keys: Sequence[str], positions: Column) -> DataFrame:
    """Wanted positions with their cells; a group has as many cells as its values span octaves, times a constant."""
    groups = spans.groupBy(*keys).agg(
        F.sum("_in_cell").alias("n"), F.collect_list(F.struct("_start", "_in_cell", *CELL)).alias("_spans")
    )
    wanted = groups.select(*keys, "n", "_spans", F.explode(positions).alias("_w"))
    pos = F.col("_w.pos")
    holder = F.filter("_spans", lambda c: (pos >= c["_start"]) & (pos < c["_start"] + c["_in_cell"]))
    return wanted.select(*keys, "n", "_w", F.get(holder, F.lit(0)).alias("_c")).select(
        *keys, "n", "_w", *[f"_c.{c}" for c in CELL], "_c._start"
    )


def _cells_by_sort(spans: DataFrame, keys: Sequence[str], positions: Column) -> DataFrame:
    groups = spans.groupBy(*keys).agg(F.sum("_in_cell").alias("n"))
    wanted = groups.select(*keys, "n", F.explode(positions).alias("_w")).withColumn("_at", F.col("_w.pos"))
    edges = spans.select(*keys, F.col("_start").alias("_at"), F.struct(*CELL, "_start").alias("_c"))
    upto = W.partitionBy(*keys).orderBy("_at", F.col("_w").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    return (
        edges.unionByName(wanted, allowMissingColumns=True)
        .withColumn("_c", F.last("_c", ignorenulls=True).over(upto))
        .where(F.col("_w").isNotNull())
        .select(*keys, "n", "_w", *[f"_c.{c}" for c in CELL], "_c._start")
    )


def _before(keys: Sequence[str], order: Sequence[str], weight: str) -> Column:
    rows_before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(rows_before), F.lit(0))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    levels: Sequence[float],
    out: str = "quantile",
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per (keys, level_idx)."""

    def around(level: Column, idx: Column) -> Column:
        at = level * (F.col("n") - 1)
        low, frac = F.floor(at), at - F.floor(at)
        return F.array(*[_tagged(idx, w, pos) for w, pos in ((1 - frac, low), (frac, F.ceil(at)))])

    grid = F.array(*[F.lit(float(q)) for q in levels])
    picked = order_statistics(df, keys, value, F.flatten(F.transform(grid, around)))
    level_of = F.element_at(grid, F.col("level_idx") + 1)
    return (
        picked.groupBy(*keys, F.col("tag.level_idx").alias("level_idx"))
        .agg(F.sum(F.col("tag.weight") * F.col(value)).alias(out))
        .withColumn("level", level_of)
    )


def medians(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per group."""
    return quantiles(df, keys, value, [0.5], out).select(*keys, out)


#: Values of a group that one row may hold while they are sorted.
LIST_BUDGET = 1 << 18


def medians_of_lists(lists: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per group of the values in the lists of all its rows; lists hold no nulls.

    A group of up to ``LIST_BUDGET`` values is sorted as one list, a larger one value by value in cells.
    """
    keys = list(keys)
    # written once: the sizes and the lists read it
    lists = cut_lineage(lists.where(F.size(value) > 0).select(*keys, value))
    large = lists.groupBy(*keys).agg(F.sum(F.size(value).cast("long")).alias("_n")).where(F.col("_n") > LIST_BUDGET).select(*keys)
    large = cut_lineage(large)
    none = large.isEmpty()
    small = lists if none else lists.join(large, keys, "left_anti")
    whole = small.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list(value))).alias("_v"))
    n = F.size("_v")
    at = lambda k: F.get("_v", F.floor(k / 2).cast("int"))
    found = whole.select(*keys, ((at(n - 1) + at(n)) / 2).alias(out))
    if none:
        return found
    rows = lists.join(large, keys, "left_semi").select(*keys, F.explode(value).alias(value))
    return found.unionByName(medians(rows, keys, value, out))


def row_numbers(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Rows (keys, value, out, n) with ``out`` = 1.. in value order; ties get successive numbers."""
    counts = running_totals(value_counts(df, keys, value), keys, value, ["cnt"])
    numbers = F.explode(F.sequence(F.col("before_cnt") + 1, F.col("before_cnt") + F.col("cnt")))
    return counts.select(*keys, value, numbers.alias(out), F.col("total_cnt").alias("n"))


def _tagged(idx: Column, weight: Column, pos: Column) -> Column:
    tag = F.struct(idx.alias("level_idx"), weight.alias("weight"))
    return F.struct(tag.alias("tag"), pos.cast("long").alias("pos"))
