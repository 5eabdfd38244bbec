"""Communities, consensus and the comparison of partitions (families G).

``partitions`` is (graph_id, gamma_idx, run, node, community). The nodes of one partition are
packed into one row, whose size is the number of nodes of a graph, and node pairs are unfolded
from it; a large community is therefore never a shuffle key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from undula.functions.partitioning import cut_lineage
from undula.functions.similarity import safe_corr
from undula.operators import packed_detection
from undula.operators.connectivity import unfold_pairs
from undula.operators.order_stats import average_rank_bounded, medians
from undula.operators.pairing import correlate_items, tile_pairs

PARTITION = ["graph_id", "gamma_idx", "run"]


# ---- detection -------------------------------------------------------------------------


#: Rounds in which many nodes move at once before only the best mover of a graph moves.
CROWDED_ROUNDS = 6
#: A search that does not end within so many rounds is reported as an error.
ROUNDS_LIMIT = 10_000


def detect_communities(edges: DataFrame, gammas: Sequence[float], runs: int, seed: int = 0) -> DataFrame:
    """Communities of many signed weighted graphs at once, for every gamma and run.

    ``edges`` is (graph_id, i, j, w), each undirected edge once; rows (graph_id, gamma_idx, run, node,
    community). Graphs of at most ``PACKED_NODES`` nodes are packed, one row a graph, and all their trials are
    moved together inside tasks; larger ones move in rounds of joins.
    """
    small, large = _by_size(edges)
    found = packed_detection.partitions(small, gammas, runs, seed)
    return found.unionByName(detect_in_rounds(large, gammas, runs, seed)) if large is not None else found


def consensus_weights(edges: DataFrame, gammas: Sequence[float], runs: int, seed: int = 0) -> DataFrame:
    """Contingency of the detected communities over all gammas and runs: (graph_id, i, j, w), i > j."""
    small, large = _by_size(edges)
    found = packed_detection.co_assignment(small, gammas, runs, seed)
    if large is None:
        return found
    return found.unionByName(contingency(detect_in_rounds(large, gammas, runs, seed), diagonal=False))


def _by_size(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges of graphs that are packed, and those of larger graphs if there are any."""
    edges = cut_lineage(edges.select("graph_id", "i", "j", "w"))
    limit = packed_detection.PACKED_NODES
    # A graph with so few links has no more nodes than that; only the others' nodes are counted.
    many = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit / 2).select("graph_id")
    ends = edges.join(many, "graph_id", "left_semi").select("graph_id", F.explode(F.array("i", "j")).alias("_node")).distinct()
    big = cut_lineage(ends.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select("graph_id"))
    if big.isEmpty():
        return edges, None
    return edges.join(big, "graph_id", "left_anti"), edges.join(big, "graph_id", "left_semi")


def detect_in_rounds(edges: DataFrame, gammas: Sequence[float], runs: int, seed: int = 0) -> DataFrame:
    """The same for graphs of any size, as joins: in each round every node weighs the gain of joining each neighbouring community, and a hashed half of
    the nodes takes its best move, until none wants to move. Then communities become the nodes and
    move the same way, level after level, until a level changes nothing. Runs differ by seed.
    """
    sided = cut_lineage(both_directions(edges))
    strength = _strengths(sided)
    trials = F.explode(
        F.array(
            *[F.struct(F.lit(k).alias("gamma_idx"), F.lit(float(g)).alias("gamma")) for k, g in enumerate(gammas)]
        )
    )
    nodes = (
        strength.withColumn("g", trials)
        .withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
        .select("graph_id", "g.gamma_idx", "g.gamma", "run", "node", "kp", "kn", "sp", "sn")
    )
    settled = _settle(sided, nodes.withColumn("community", F.col("node")), seed)
    level = 1
    while True:
        merged = cut_lineage(_settle_merged(sided, settled, seed + level))
        if merged.where("community <> _from").isEmpty():
            break
        settled, level = merged.drop("_from"), level + 1
    rank = F.dense_rank().over(W.partitionBy(*PARTITION).orderBy("community"))
    return settled.select(*PARTITION, "node", rank.alias("community"))


def both_directions(edges: DataFrame) -> DataFrame:
    ends = F.explode(
        F.array(
            F.struct(F.col("i").alias("node"), F.col("j").alias("other")),
            F.struct(F.col("j").alias("node"), F.col("i").alias("other")),
        )
    )
    return (
        edges.where("i <> j")
        .select("graph_id", ends.alias("e"), F.greatest("w", F.lit(0.0)).alias("wp"), F.greatest(-F.col("w"), F.lit(0.0)).alias("wn"))
        .select("graph_id", "e.node", "e.other", "wp", "wn")
    )


def _strengths(sided: DataFrame) -> DataFrame:
    per_node = sided.groupBy("graph_id", "node").agg(F.sum("wp").alias("kp"), F.sum("wn").alias("kn"))
    totals = per_node.groupBy("graph_id").agg(F.sum("kp").alias("sp"), F.sum("kn").alias("sn"))
    return per_node.join(totals, "graph_id")


def _settle(sided: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """Local moves until no node wants to move; the lineage is cut every round.

    A round is a join: a node's neighbours bring their community with its total strength, the
    weights are summed per community, and the options of a node (at most its neighbours) are
    compared in one row. Nodes that move at once may undo each other's gain, so after
    ``CROWDED_ROUNDS`` only the node with the largest gain of each graph moves: the modularity then
    rises with every round and the search ends.
    """
    key = [*PARTITION]
    own = ["community", "gamma", "kp", "kn", "sp", "sn"]
    labels = cut_lineage(labels)
    for step in range(ROUNDS_LIMIT):
        crowd = labels.groupBy(*key, "community").agg(F.sum("kp").alias("cp"), F.sum("kn").alias("cn"))
        sized = labels.join(crowd, [*key, "community"])
        seen = sized.select(*key, F.col("node").alias("other"), F.col("community").alias("option"), "cp", "cn")
        near = sided.join(seen, ["graph_id", "other"]).drop("other")
        stay = sized.withColumn("option", F.col("community")).withColumn("wp", F.lit(0.0)).withColumn("wn", F.lit(0.0))
        options = (
            near.unionByName(stay, allowMissingColumns=True)
            .groupBy(*key, "node", "option")
            .agg(F.sum("wp").alias("ip"), F.sum("wn").alias("in_"), F.max("cp").alias("cp"), F.max("cn").alias("cn"), *[F.max(c).alias(c) for c in own])
        )
        choice = F.struct("option", "ip", "in_", "cp", "cn", F.xxhash64(F.lit(seed), "run", "option").alias("tie"))
        nodes = options.groupBy(*key, "node").agg(F.collect_list(choice).alias("_o"), *[F.max(c).alias(c) for c in own])
        ranked = F.transform("_o", lambda o: F.struct(_gain(o).alias("gain"), o["tie"].alias("tie"), o["option"].alias("option")))
        best = F.array_max("_ranked")
        now = F.array_max(F.transform(F.filter("_ranked", lambda o: o["option"] == F.col("community")), lambda o: o["gain"]))
        judged = cut_lineage(
            nodes.withColumn("_ranked", ranked)
            .withColumn("_best", best)
            .withColumn("_more", F.col("_best.gain") - now)
            .select(*key, "node", *own, F.col("_best.option").alias("option"), "_more", (F.col("_more") > 1e-12).alias("wants"))
        )
        if judged.where("wants").isEmpty():
            return judged.select(*key, "node", *own)
        if step < CROWDED_ROUNDS:
            goes = F.pmod(F.xxhash64(F.lit(seed), F.lit(step), *key, "node"), F.lit(2)) == 0
        else:
            first = judged.where("wants").groupBy(*key).agg(F.max(F.struct("_more", "node")).alias("_first"))
            judged = judged.join(first, key, "left")
            goes = F.col("node") == F.col("_first.node")
        moved = F.when(F.col("wants") & F.coalesce(goes, F.lit(False)), F.col("option")).otherwise(F.col("community"))
        labels = judged.select(*key, "node", moved.alias("community"), *own[1:])
    raise RuntimeError(f"communities are still moving after {ROUNDS_LIMIT} rounds")


def _gain(o: Column) -> Column:
    """Part of the signed modularity that depends on the community ``o`` a node joins."""
    mine = o["option"] == F.col("community")
    cp = o["cp"] - F.when(mine, F.col("kp")).otherwise(0.0)
    cn = o["cn"] - F.when(mine, F.col("kn")).otherwise(0.0)
    plus = o["ip"] - F.col("gamma") * F.coalesce(F.try_divide(F.col("kp") * cp, F.col("sp")), F.lit(0.0))
    minus = o["in_"] - F.col("gamma") * F.coalesce(F.try_divide(F.col("kn") * cn, F.col("sn")), F.lit(0.0))
    return F.coalesce(F.try_divide(plus, F.col("sp")), F.lit(0.0)) - F.coalesce(
        F.try_divide(minus, F.col("sp") + F.col("sn")), F.lit(0.0)
    )


def _settle_merged(sided: DataFrame, settled: DataFrame, seed: int) -> DataFrame:
    """The communities of ``settled`` as nodes, moved until none wants to: ``settled`` with the new
    communities and the old ones as ``_from``."""
    key = [*PARTITION]
    home = settled.select(*key, "node", "community")
    # (graph, gamma, run) together name a merged graph; sums of weights between communities
    between = (
        sided.join(home, ["graph_id", "node"])
        .join(home.select(*key, F.col("node").alias("other"), F.col("community").alias("_oc")), [*key, "other"])
        .where(F.col("community") != F.col("_oc"))
        .groupBy(*key, F.col("community").alias("node"), F.col("_oc").alias("other"))
        .agg(F.sum("wp").alias("wp"), F.sum("wn").alias("wn"))
        .select(F.struct(*key).alias("graph_id"), "node", "other", "wp", "wn")
    )
    units = settled.groupBy(*key, "gamma", "sp", "sn", F.col("community").alias("node")).agg(
        F.sum("kp").alias("kp"), F.sum("kn").alias("kn")
    )
    moved = _settle(
        cut_lineage(between),
        units.select(
            F.struct(*key).alias("graph_id"), "gamma_idx", "gamma", "run", "node", "kp", "kn", "sp", "sn", F.col("node").alias("community")
        ),
        seed,
    )
    target = moved.select(
        "graph_id.graph_id", "gamma_idx", "run", F.col("node").alias("_from"), F.col("community").alias("_to")
    )
    return settled.withColumnRenamed("community", "_from").join(target, [*key, "_from"]).withColumnRenamed("_to", "community")


def modularity(edges: DataFrame, partitions: DataFrame, gammas: Sequence[float]) -> DataFrame:
    """Signed modularity Q of given partitions: rows (graph_id, gamma_idx, run, q)."""
    sided = both_directions(edges)
    nodes = partitions.join(_strengths(sided), ["graph_id", "node"])
    sizes = nodes.groupBy(*PARTITION, "community", "sp", "sn").agg(F.sum("kp").alias("cp"), F.sum("kn").alias("cn"))
    expected = sizes.groupBy(*PARTITION, "sp", "sn").agg(
        F.sum(F.col("cp") * F.col("cp")).alias("ep"), F.sum(F.col("cn") * F.col("cn")).alias("en")
    )
    other = partitions.select(*PARTITION, F.col("node").alias("other"), F.col("community").alias("_oc"))
    inside = (
        sided.join(partitions, ["graph_id", "node"])
        .join(other, [*PARTITION, "other"])
        .groupBy(*PARTITION)
        .agg(*[F.sum(F.when(F.col("community") == F.col("_oc"), F.col(w)).otherwise(0.0)).alias(f"in_{w}") for w in ("wp", "wn")])
    )
    gamma = F.element_at(F.array(*[F.lit(float(g)) for g in gammas]), F.col("gamma_idx") + 1)
    zero = F.lit(0.0)
    plus = F.col("in_wp") - gamma * F.coalesce(F.try_divide(F.col("ep"), F.col("sp")), zero)
    minus = F.col("in_wn") - gamma * F.coalesce(F.try_divide(F.col("en"), F.col("sn")), zero)
    q = F.coalesce(F.try_divide(plus, F.col("sp")), zero) - F.coalesce(F.try_divide(minus, F.col("sp") + F.col("sn")), zero)
    return expected.join(inside, PARTITION).select(*PARTITION, q.alias("q"))


# ---- consensus -------------------------------------------------------------------------


def _node_pairs(partitions: DataFrame, diagonal: bool) -> DataFrame:
    packed = partitions.groupBy(*PARTITION).agg(
        F.array_sort(F.collect_list(F.struct(F.col("node").alias("region"), F.col("community").alias("value")))).alias("vec")
    )
    pairs = unfold_pairs(packed, PARTITION, diagonal)
    return pairs.select(*PARTITION, "i", "j", (F.col("x") == F.col("y")).cast("int").alias("same"))


def agreement(partitions: DataFrame, keys: Sequence[str] = ("graph_id", "gamma_idx"), diagonal: bool = True) -> DataFrame:
    """Number of runs in which two nodes share a community, zeros included: (keys, i, j, agreement), i >= j."""
    return _node_pairs(partitions, diagonal).groupBy(*keys, "i", "j").agg(F.sum("same").alias("agreement"))


def contingency(partitions: DataFrame, keys: Sequence[str] = ("graph_id",), diagonal: bool = True) -> DataFrame:
    """Agreement over all gammas and runs, as a share: (keys, i, j, w)."""
    return _node_pairs(partitions, diagonal).groupBy(*keys, "i", "j").agg(F.avg("same").alias("w"))


def contingency_levels(partitions: DataFrame) -> DataFrame:
    """Contingency per graph and agreement per gamma in one pass (gamma_idx NULL = all gammas)."""
    pairs = _node_pairs(partitions, True)
    return (
        pairs.groupingSets(
            [["graph_id", "i", "j", "gamma_idx"], ["graph_id", "i", "j"]], "graph_id", "i", "j", "gamma_idx"
        )
        .agg(F.sum("same").alias("agreement"), F.avg("same").alias("w"))
    )


def gamma_range(low: float = 0.8, high: float = 1.3, count: int = 10) -> list[float]:
    return [low] if count == 1 else [low + (high - low) * k / (count - 1) for k in range(count)]


def allegiance_communities(
    edges: DataFrame,
    runs: int = 100,
    gamma_count: int = 10,
    final_gamma: float = 1.2,
    seed: int = 0,
    twice: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Consensus partition and contingency of every graph.

    Contingency of the graph, contingency of that contingency, then communities at the final
    gamma. Returns (graph_id, node, community, pos) and (graph_id, i, j, w).
    """
    gammas = gamma_range(count=gamma_count)
    weights = consensus_weights(edges, gammas, runs, seed)
    if twice:
        weights = consensus_weights(weights, gammas, runs, seed + 10)
    weights = cut_lineage(weights)
    final = detect_communities(weights, [final_gamma], 1, seed + 20)
    return with_positions(final.select("graph_id", "node", "community")), weights


def with_positions(partition: DataFrame, keys: Sequence[str] = ("graph_id",)) -> DataFrame:
    """Add the 0-based position of each node when nodes are sorted by community."""
    pos = F.row_number().over(W.partitionBy(*keys).orderBy("community", "node")) - 1
    return partition.withColumn("pos", pos)


def averaged_allegiance(edges: DataFrame, stack: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """Same over a stack of matrices: mean label per node and mean contingency per stack.

    ``stack`` maps graph_id to stack_id.
    """
    partition, weights = allegiance_communities(edges, **kw)
    labels = partition.join(stack, "graph_id").groupBy("stack_id", "node").agg(F.avg("community").alias("community"))
    mean = weights.join(stack, "graph_id").groupBy("stack_id", "i", "j").agg(F.avg("w").alias("w"))
    return labels, mean


def sort_by_modularity(fc: DataFrame, gamma: float = 1.1, seed: int = 0) -> DataFrame:
    """Positions of the regions of every network under its communities at ``gamma``."""
    edges = fc.select(F.col("subject").alias("graph_id"), "i", "j", F.col("fc").alias("w"))
    found = detect_communities(edges, [gamma], 1, seed)
    return with_positions(found.select("graph_id", "node", "community"))


def frame_allegiance(dfc: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """Allegiance of every frame of every stream; graph_id is the (subject, window_size, frame) struct."""
    graph = F.struct("subject", "window_size", "frame").alias("graph_id")
    return allegiance_communities(dfc.select(graph, "i", "j", F.col("fc").alias("w")), **kw)


def temporal_mean(weights: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Mean contingency over windows: (keys, i, j, w)."""
    return weights.groupBy(*keys, "i", "j").agg(F.avg("w").alias("w"))


def temporal_consensus(mean_weights: DataFrame, runs: int = 100, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """Partition of each subject's mean contingency: many runs, their agreement share, its communities."""
    edges = mean_weights.select(F.col("subject").alias("graph_id"), "i", "j", "w")
    shared = cut_lineage(consensus_weights(edges, [gamma], runs, seed))
    final = detect_communities(shared, [gamma], 1, seed + 1)
    return final.select(F.col("graph_id").alias("subject"), "node", "community")


def group_allegiance(weights: DataFrame, members: DataFrame, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """Communities of the mean contingency of each group of subjects: (label, node, community)."""
    mean = (
        weights.join(members.select("label", F.col("subject").alias("graph_id")), "graph_id")
        .groupBy("label", "i", "j")
        .agg(F.avg("w").alias("w"))
    )
    found = detect_communities(mean.withColumnRenamed("label", "graph_id"), [gamma], 1, seed)
    return found.select(F.col("graph_id").alias("label"), "node", "community")


def reorder_labels(partitions: DataFrame, order: DataFrame, keys: Sequence[str] = ("graph_id", "run")) -> DataFrame:
    """Labels listed by the position each window's sort index gives its nodes: (keys, pos, community)."""
    return partitions.join(order, [*keys, "node"]).select(*keys, "pos", "community")


# ---- label alignment -------------------------------------------------------------------


def label_overlap(partition: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes shared by every label and reference label: (keys, label, ref_label, n)."""
    ref = reference.withColumnRenamed("community", "ref_label")
    shared = [c for c in ("graph_id", "gamma_idx", "node") if c in ref.columns]
    return (
        partition.join(ref, shared)
        .groupBy(*keys, F.col("community").alias("label"), "ref_label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def align_labels(overlap: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Greedy one-to-one map label -> ref_label by mutual best overlap: (keys, label, ref_label, n).

    A round accepts every pair that is the best of both its labels, until no pair of two free labels
    is left; the largest open pair of a key is always accepted, so the rounds end. Overlap tables
    hold one row per label pair, so their groups are small.
    """
    keys = list(keys)
    found = None
    open_ = cut_lineage(overlap)
    order = [F.col("n").desc(), F.col("label"), F.col("ref_label")]
    while True:
        ranked = open_.withColumn("_a", F.row_number().over(W.partitionBy(*keys, "label").orderBy(*order))).withColumn(
            "_b", F.row_number().over(W.partitionBy(*keys, "ref_label").orderBy(*order))
        )
        taken = cut_lineage(ranked.where("_a = 1 and _b = 1").drop("_a", "_b"))
        found = taken if found is None else found.unionByName(taken)
        open_ = cut_lineage(
            open_.join(taken.select(*keys, "label"), [*keys, "label"], "left_anti").join(
                taken.select(*keys, "ref_label"), [*keys, "ref_label"], "left_anti"
            )
        )
        if open_.isEmpty():
            return found


def assign_labels(overlap: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one map label -> ref_label of the largest total overlap: (keys, label, ref_label, n).

    The overlap table of a key has at most as many rows as its graph has nodes, so it is packed into one
    row. Labels without an overlapping partner stay unmapped. Of several best maps the one found by adding labels in
    ascending order along shortest paths is taken.
    """
    keys = list(keys)
    cells = F.array_sort(F.collect_list(F.struct(*[F.col(c).cast(k).alias(c) for c, k in (("label", "int"), ("ref_label", "int"), ("n", "long"))])))
    packed = overlap.where("n > 0").groupBy(*keys).agg(cells.alias("_o"))
    return packed.select(*keys, F.explode(_best_cells("_o")).alias("_m")).select(*keys, "_m.*")


def _best_cells(overlaps: str) -> Column:
    """The cells (label, ref_label, n) of the best one-to-one map."""

    def solve(tables: pd.Series) -> pd.Series:
        out = []
        for cells in tables:
            labels, refs = sorted({c["label"] for c in cells}), sorted({c["ref_label"] for c in cells})
            gain = np.zeros((len(labels), len(refs)))
            for c in cells:
                gain[labels.index(c["label"]), refs.index(c["ref_label"])] = c["n"]
            out.append([{"label": labels[a], "ref_label": refs[b], "n": int(gain[a, b])} for a, b in best_assignment(gain)])
        return pd.Series(out)

    kind = T.ArrayType(T.StructType([T.StructField("label", T.IntegerType()), T.StructField("ref_label", T.IntegerType()), T.StructField("n", T.LongType())]))
    return F.pandas_udf(solve, kind)(overlaps)


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total gain, each row and column at most once; pairs without gain are left out.

    Shortest augmenting paths with prices, one row after another; a row may also stay single.
    """
    rows, columns = gain.shape
    # Columns beyond the real ones stand for staying single.
    cost = np.concatenate([-gain, np.zeros((rows, rows))], axis=1)
    wide = columns + rows
    price, reduced, owner = np.zeros(wide), np.zeros(rows), np.full(wide, -1)
    for r in range(rows):
        far, back, seen = np.full(wide, np.inf), np.full(wide, -1), np.zeros(wide, bool)
        row, at, length = r, -1, 0.0
        while True:
            step = length + cost[row] - reduced[row] - price
            closer = ~seen & (step < far)
            far[closer], back[closer] = step[closer], at
            at = int(np.where(seen, np.inf, far).argmin())
            length, seen[at] = far[at], True
            if owner[at] < 0:
                break
            row = owner[at]
        passed = np.flatnonzero(seen & (owner >= 0))
        reduced[owner[passed]] += length - far[passed]
        reduced[r] += length
        price[seen] += far[seen] - length
        while at >= 0:
            before = int(back[at])
            owner[at] = r if before < 0 else owner[before]
            at = before
    return [(int(owner[c]), c) for c in range(columns) if owner[c] >= 0 and gain[owner[c], c] > 0]


def align_across_windows(partitions: DataFrame, keys: Sequence[str] = ("graph_id",)) -> DataFrame:
    """Each window's label goes to the label it overlaps most with, pooled over the other windows.

    Rows (keys, run, label, ref_label, n); ties go to the smaller label.
    """
    keys = list(keys)
    pooled = partitions.groupBy(*keys, "node", F.col("community").alias("ref_label")).agg(
        F.count(F.lit(1)).alias("_all")
    )
    own = F.when(F.col("community") == F.col("ref_label"), F.col("_all") - 1).otherwise(F.col("_all"))
    overlap = (
        partitions.join(pooled, [*keys, "node"])
        .groupBy(*keys, "run", F.col("community").alias("label"), "ref_label")
        .agg(F.sum(own).alias("n"))
    )
    best = F.max(F.struct("n", (-F.col("ref_label")).alias("low")))
    return overlap.groupBy(*keys, "run", "label").agg(best.alias("_b")).select(
        *keys, "run", "label", (-F.col("_b.low")).alias("ref_label"), F.col("_b.n").alias("n")
    )


# ---- comparison of partitions ----------------------------------------------------------


def partition_information(partitions: DataFrame, keys: Sequence[str] = ("graph_id", "gamma_idx"), tile: int = 64) -> DataFrame:
    """Mutual information of every two runs: (keys, run1, run2, mi, nmi), run1 < run2.

    Runs are compared over the nodes they share; two runs without one have no row. The runs of a key are dealt
    into tiles of label vectors, and nothing but tiles and the results is shuffled.
    """
    run = partitions.schema["run"].dataType
    cells = F.explode(_information(*RUN_TILES)).alias("_m")
    found = _run_tiles(partitions, keys, tile).select(*keys, cells)
    return found.select(*keys, F.col("_m.run1").cast(run).alias("run1"), F.col("_m.run2").cast(run).alias("run2"), "_m.mi", "_m.nmi")


RUN_TILES = ("same", "a.run", "a._n", "a._c", "b.run", "b._n", "b._c")


def _run_tiles(partitions: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """Every two tiles of runs, a run being its nodes in order and their labels."""
    cells = F.array_sort(F.collect_list(F.struct("node", "community")))
    runs = partitions.groupBy(*keys, "run").agg(cells.alias("_p"))
    # written once: the number of tiles and both sides of the tile pairs read it
    vectors = cut_lineage(runs.select(*keys, "run", F.col("_p.node").alias("_n"), F.col("_p.community").alias("_c")))
    return tile_pairs(vectors, keys, "run", ["_n", "_c"], tile)


_INFORMED = T.StructType(
    [
        T.StructField("run1", T.LongType()),
        T.StructField("run2", T.LongType()),
        T.StructField("mi", T.DoubleType()),
        T.StructField("nmi", T.DoubleType()),
    ]
)


@F.pandas_udf(T.ArrayType(_INFORMED))
def _information(
    same: pd.Series, ar: pd.Series, an: pd.Series, ac: pd.Series, br: pd.Series, bn: pd.Series, bc: pd.Series
) -> pd.Series:
    return pd.Series([list(_informed(*pair)) for pair in zip(same, ar, an, ac, br, bn, bc)])


@F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())]))
def _information_sum(
    same: pd.Series, ar: pd.Series, an: pd.Series, ac: pd.Series, br: pd.Series, bn: pd.Series, bc: pd.Series
) -> pd.DataFrame:
    nmi = [[cell["nmi"] for cell in _informed(*pair)] for pair in zip(same, ar, an, ac, br, bn, bc)]
    return pd.DataFrame({"n": [len(v) for v in nmi], "total": [float(sum(v)) for v in nmi]})


def _informed(own, runs1, nodes1, labels1, runs2, nodes2, labels2) -> Iterator[dict]:
    """The information of the runs of two tiles, one cell per pair of runs."""
    coded1, coded2 = [_dense(v) for v in labels1], [_dense(v) for v in labels2]
    alone1, alone2 = [_label_entropy(v) for v in coded1], [_label_entropy(v) for v in coded2]
    for p, r1 in enumerate(runs1):
        for q, r2 in enumerate(runs2):
            if own and r1 >= r2:
                continue
            a, b = coded1[p], coded2[q]
            if not np.array_equal(nodes1[p], nodes2[q]):
                _, at1, at2 = np.intersect1d(nodes1[p], nodes2[q], assume_unique=True, return_indices=True)
                a, b = a[at1], b[at2]
            if not len(a):
                continue
            h = alone1[p] + alone2[q]
            mi = max(h - _label_entropy(_dense(a * (b.max() + 1) + b)), 0.0)
            yield {"run1": min(r1, r2), "run2": max(r1, r2), "mi": mi, "nmi": 1.0 if h < 1e-12 else mi / (h / 2)}


def _dense(labels: np.ndarray) -> np.ndarray:
    """Labels numbered from 0."""
    return np.unique(labels, return_inverse=True)[1].astype(np.int64)


def _label_entropy(labels: np.ndarray) -> float:
    n = np.bincount(labels)
    n = n[n > 0].astype(float)
    return float(np.log(n.sum()) - (n * np.log(n)).sum() / n.sum())


def mean_nmi(partitions: DataFrame, tile: int = 64) -> DataFrame:
    """Stability per gamma: mean over all pairs of runs. Tiles send their sums only."""
    keys = ["graph_id", "gamma_idx"]
    sums = _run_tiles(partitions, keys, tile).select(*keys, _information_sum(*RUN_TILES).alias("_s"))
    mean = F.sum("_s.total") / F.sum("_s.n")
    return sums.groupBy(*keys).agg(F.sum("_s.n").alias("_n"), mean.alias("mean_nmi")).where("_n > 0").drop("_n")


def label_correlation(partitions: DataFrame, keys: Sequence[str] = ("graph_id", "gamma_idx")) -> DataFrame:
    """Pearson correlation of the label vectors of every two runs."""
    return correlate_items(partitions, keys, "run", "node", "community", "run1", "run2", "r")


def successive_similarity(weights: DataFrame) -> DataFrame:
    """Spearman correlation of co-assignment between successive windows: (graph_id, run, r)."""
    ranked = weights.withColumn("_r", average_rank_bounded(["graph_id", "run"], "w"))
    nxt = ranked.select("graph_id", (F.col("run") - 1).alias("run"), "i", "j", F.col("_r").alias("_next"))
    return ranked.join(nxt, ["graph_id", "run", "i", "j"]).groupBy("graph_id", "run").agg(safe_corr("_r", "_next").alias("r"))


def window_similarity(weights: DataFrame) -> DataFrame:
    """Spearman correlation of co-assignment between every two windows: (graph_id, run1, run2, r)."""
    ranked = weights.withColumn("_r", average_rank_bounded(["graph_id", "run"], "w"))
    cells = ranked.select("graph_id", "run", F.struct("i", "j").alias("_cell"), "_r")
    return correlate_items(cells, ["graph_id"], "run", "_cell", "_r", "run1", "run2", "r")


def module_counts(partitions: DataFrame) -> DataFrame:
    return partitions.groupBy(*PARTITION).agg(F.countDistinct("community").alias("n_modules"))


def median_labels(partitions: DataFrame, members: DataFrame) -> DataFrame:
    """Median label per node over windows and subjects of each group: (label, node, median_label)."""
    joined = partitions.join(members.select("label", F.col("subject").alias("graph_id")), "graph_id")
    return medians(joined, ["label", "node"], "community", "median_label")


def modularity_by_gamma(q: DataFrame) -> DataFrame:
    return q.groupBy("graph_id", "gamma_idx").agg(F.avg("q").alias("mean_q"), F.stddev_pop("q").alias("sd_q"))
