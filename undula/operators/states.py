"""Brain states, link activation events and dwell times (family H)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from undula.functions.partitioning import cut_lineage
from undula.operators.connectivity import fc_matrix
from undula.operators.kmeans import fit_many
from undula.operators.order_stats import running_totals
from undula.operators.pairing import tile_pairs
from undula.operators.prep import zscore_by_region

BLOCK = 4096
#: Blocks, or stretches of blocks, whose border runs meet in one task; two levels reach 2 ** 52 samples.
FAN = 1 << 20
TREE_LEVELS = 2


# ---- clustering ------------------------------------------------------------------------


def sample_features(signals: DataFrame) -> DataFrame:
    """Z-scored sample vectors: (subject, t, features array<double>); a constant region contributes 0."""
    scaled = zscore_by_region(signals)
    packed = F.array_sort(F.collect_list(F.struct("region", F.coalesce("value", F.lit(0.0)).alias("value"))))
    return scaled.groupBy("subject", "t").agg(packed.alias("_p")).select("subject", "t", F.col("_p.value").alias("features"))


def fit_states(features: DataFrame, k: int = 4, seed: int = 42, max_iter: int = 100, restarts: int = 100) -> np.ndarray:
    """The centres (k, regions) of the cheapest of several restarts, all fitted in the same passes."""
    found = fit_many(features, [k] * restarts, [seed + r for r in range(restarts)], max_iter)
    return min(found, key=lambda f: f[0])[1]


def assign_states(centres: np.ndarray, features: DataFrame) -> DataFrame:
    """(subject, t, cluster): the nearest centre of each sample, the first of equally near ones."""
    return features.select("subject", "t", _nearest(centres)("features").cluster.alias("cluster"))


def assignment_cost(centres: np.ndarray, features: DataFrame) -> DataFrame:
    """(cluster, n, inertia): samples of each centre and the sum of their squared distances."""
    rows = features.select(_nearest(centres)("features").alias("_n")).select("_n.*")
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("inertia"))


def _nearest(centres: np.ndarray):
    @F.pandas_udf("cluster int, distance double")
    def near(features: pd.Series) -> pd.DataFrame:
        x = np.vstack(features) if len(features) else np.zeros((0, centres.shape[1]))
        # differences, not products: exact zeros for samples that are centres
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
        own = d.argmin(axis=1)
        return pd.DataFrame({"cluster": own.astype(np.int32), "distance": d[np.arange(len(x)), own]})

    return near.asNondeterministic()


def elbow_curve(features: DataFrame, ks: Sequence[int] = range(2, 10), seed: int = 42, max_iter: int = 100, restarts: int = 100) -> DataFrame:
    """Least cost per number of clusters: (k, inertia). All clusters and restarts share each pass."""
    trials = [(k, seed + r) for k in ks for r in range(restarts)]
    found = fit_many(features, [k for k, _ in trials], [s for _, s in trials], max_iter)
    least: dict[int, float] = {}
    for (k, _), (cost, _) in zip(trials, found):
        least[k] = min(cost, least.get(k, cost))
    return features.sparkSession.createDataFrame(sorted(least.items()), "k int, inertia double")


#: Least and most samples of one tile of the all-pairs distances of a silhouette; between them there are ``SILHOUETTE_TILES``.
SILHOUETTE_TILE = (2048, 1 << 16)
SILHOUETTE_TILES = 32
#: Sides of the distances held at once.
SILHOUETTE_ROWS, SILHOUETTE_COLUMNS = 256, 512
#: Squared distances up to this share of the largest squares are worked out by differences.
NEAR = 1e-5


def silhouette_samples(labelled: DataFrame, tile: int | None = None) -> DataFrame:
    """Euclidean silhouette of every sample: (subject, t, cluster, silhouette) from (subject, t, cluster, features).

    A sample alone in its cluster has 0.
    """
    labelled = cut_lineage(labelled.select("subject", "t", "cluster", "features"))
    scored = _distinct_silhouettes(labelled, tile).select("cluster", "features", "silhouette")
    return labelled.join(scored, ["cluster", "features"]).select("subject", "t", "cluster", "silhouette")


def _distinct_silhouettes(labelled: DataFrame, tile: int | None) -> DataFrame:
    """(cluster, features, n, silhouette) per distinct sample of a cluster, ``n`` the number of its copies.

    Copies are one item with a weight. Every two tiles of items meet once; a task adds up the true distances
    from each item to each cluster of the other tile, so that no pair leaves it.
    """
    counted = labelled.groupBy("cluster", "features").agg(F.count(F.lit(1)).alias("n"))
    items = cut_lineage(counted.withColumn("_item", F.monotonically_increasing_id()))
    sizes = items.groupBy("cluster").agg(F.sum("n").alias("_size"))
    if tile is None:
        least, most = SILHOUETTE_TILE
        tile = min(most, max(least, items.count() // SILHOUETTE_TILES))
    tiles = tile_pairs(items, [], "_item", ["cluster", "features", "n"], tile)
    totals = tiles.mapInArrow(_distance_sums, "_item long, _own int, cluster int, _total double")
    totals = totals.groupBy("_item", "_own", "cluster").agg(F.sum("_total").alias("_total"))
    mine = F.col("cluster") == F.col("_own")
    scored = totals.join(F.broadcast(sizes), "cluster").groupBy("_item").agg(
        F.max(F.when(mine, F.try_divide("_total", F.col("_size") - 1))).alias("_a"),
        F.max(F.when(mine, F.col("_size"))).alias("_n"),
        F.min(F.when(~mine, F.col("_total") / F.col("_size"))).alias("_b"),
    )
    score = F.when(F.col("_n") > 1, F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))).otherwise(0.0)
    scored = scored.select("_item", F.when(F.col("_b").isNotNull(), score).alias("silhouette"))
    return items.join(scored, "_item").select("cluster", "features", "n", "silhouette")


def mean_silhouette(labelled: DataFrame, tile: int | None = None) -> DataFrame:
    """One row (n, silhouette) of (subject, t, cluster, features); null with fewer than two clusters."""
    scored = _distinct_silhouettes(labelled, tile)
    there = F.sum(F.when(F.col("silhouette").isNotNull(), F.col("n")))
    mean = F.try_divide(F.sum(F.col("silhouette") * F.col("n")), there)
    return scored.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), mean.alias("silhouette"))


def silhouette(centres: np.ndarray, features: DataFrame) -> float:
    """Mean Euclidean silhouette of the samples under their nearest centres."""
    labelled = features.select("subject", "t", "features", _nearest(centres)("features").cluster.alias("cluster"))
    return mean_silhouette(cut_lineage(labelled)).first()["silhouette"]


def _distance_sums(batches):
    """For each item of two tiles the weighed sum of its distances to the items of each cluster of the other tile."""
    for batch in batches:
        same = batch.column("same").to_pylist()
        for k in range(batch.num_rows):
            yield from _sums_to_clusters(_tile_arrays(batch.column("a")[k].values), _tile_arrays(batch.column("b")[k].values), same[k])


def _tile_arrays(tile):
    x = tile.field("features").flatten().to_numpy(zero_copy_only=False).reshape(len(tile), -1)
    item, cluster, n = (tile.field(c).to_numpy(zero_copy_only=False) for c in ("_item", "cluster", "n"))
    return item, cluster, n, x


def _weights(tile) -> tuple[np.ndarray, np.ndarray]:
    names, own = np.unique(tile[1], return_inverse=True)
    weights = np.zeros((len(own), len(names)))
    weights[np.arange(len(own)), own] = tile[2]
    return names, weights


def _sums_to_clusters(p, q, same: bool):
    """A distance counts for both its items; a tile beside itself has each distance twice already."""
    (p_names, p_weights), (q_names, q_weights) = _weights(p), _weights(q)
    middle = p[3].mean(axis=0)
    x, y = p[3] - middle, q[3] - middle
    p_sums, q_sums = np.zeros((len(x), len(q_names))), np.zeros((len(y), len(p_names)))
    columns = [slice(at, at + SILHOUETTE_COLUMNS) for at in range(0, len(y), SILHOUETTE_COLUMNS)]
    left, right = np.column_stack([-2.0 * x, (x * x).sum(axis=1), np.ones(len(x))]), np.column_stack([y, np.ones(len(y)), (y * y).sum(axis=1)])
    near = NEAR * (left[:, -2].max() + right[:, -1].max())
    factors = [right[own].T.copy() for own in columns]
    for lo in range(0, len(x), SILHOUETTE_ROWS):
        rows = slice(lo, lo + SILHOUETTE_ROWS)
        for own, factor in zip(columns, factors):
            square = left[rows] @ factor
            if square.min() <= near:
                # close items by differences: products would lose digits, and equal ones are at distance 0 exactly
                i, j = np.nonzero(square <= near)
                square[i, j] = ((x[rows][i] - y[own][j]) ** 2).sum(axis=1)
            np.sqrt(square, out=square)
            p_sums[rows] += square @ q_weights[own]
            if not same:
                q_sums[own] += square.T @ p_weights[rows]
    for tile, names, sums in ((p, q_names, p_sums),) if same else ((p, q_names, p_sums), (q, p_names, q_sums)):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(tile[0], len(names))),
                pa.array(np.repeat(tile[1], len(names)).astype(np.int32)),
                pa.array(np.tile(names, len(sums)).astype(np.int32)),
                pa.array(sums.ravel()),
            ],
            names=["_item", "_own", "cluster", "_total"],
        )


# ---- state networks --------------------------------------------------------------------


def state_fc(signals: DataFrame, states: DataFrame, n_states: int) -> DataFrame:
    """Network of each state over all subjects' samples; an empty state is all zeros."""
    tagged = signals.join(states, ["subject", "t"])
    # samples of all subjects meet in one state, so the sample key keeps the subject
    sample = F.struct("subject", "t").alias("t")
    found = fc_matrix(tagged.select("cluster", sample, "region", "value"), keys=["cluster"])
    regions = signals.select("region").distinct()
    grid = (
        regions.select(F.col("region").alias("i"))
        .where("i > 0")
        .select("i", F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("j"))
        .select(F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))).alias("cluster"), "i", "j")
    )
    return grid.join(found, ["cluster", "i", "j"], "left").select("cluster", "i", "j", F.coalesce("fc", F.lit(0.0)).alias("fc"))


def global_efficiency(edges: DataFrame, n_nodes: int) -> DataFrame:
    """Mean inverse shortest path per graph, a link of weight w having length 1/w: (graph_id, efficiency).

    Distances double their reach per round (min over a middle node), so ceil(log2(nodes)) rounds suffice.
    """
    length = F.when(F.col("w") > 0, 1 / F.col("w"))
    ends = F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b"))))
    reach = (
        edges.where("i <> j").select("graph_id", ends.alias("e"), length.alias("d")).where("d is not null")
        .select("graph_id", "e.a", "e.b", "d")
    )
    graphs = edges.select("graph_id").distinct()
    for _ in range(max(1, (max(n_nodes, 2) - 1).bit_length())):
        step = cut_lineage(reach)
        left = step.select("graph_id", "a", F.col("b").alias("m"), F.col("d").alias("d1"))
        right = step.select("graph_id", F.col("a").alias("m"), "b", F.col("d").alias("d2"))
        longer = left.join(right, ["graph_id", "m"]).where("a <> b").select("graph_id", "a", "b", (F.col("d1") + F.col("d2")).alias("d"))
        reach = step.unionByName(longer).groupBy("graph_id", "a", "b").agg(F.min("d").alias("d"))
    total = reach.groupBy("graph_id").agg(F.sum(1 / F.col("d")).alias("_s"))
    share = F.coalesce("_s", F.lit(0.0)) / (n_nodes * (n_nodes - 1))
    return graphs.join(total, "graph_id", "left").select("graph_id", share.alias("efficiency"))


def link_sequence(states: DataFrame, networks: DataFrame) -> DataFrame:
    """Each sample's state mapped to the state's links: (subject, t, i, j, fc)."""
    return states.join(networks, "cluster").select("subject", "t", "i", "j", "fc")


def link_activation(sequence: DataFrame, share: float = 0.01) -> DataFrame:
    """1 where a link exceeds a share of its own maximum in that subject."""
    top = sequence.groupBy("subject", "i", "j").agg((F.max("fc") * share).alias("_cut"))
    return sequence.join(top, ["subject", "i", "j"]).select(
        "subject", "t", "i", "j", (F.col("fc") > F.col("_cut")).cast("int").alias("active")
    )


# ---- runs ------------------------------------------------------------------------------


def runs(df: DataFrame, keys: Sequence[str], order: str, label: str, block: int = BLOCK) -> DataFrame:
    """Run-length encoding of a gap-free series: (keys, label, start, length).

    The series is cut into blocks, each encoded by itself, so a long one is spread over many tasks.
    Only the first and last run of a block are compared with those of other blocks, in a tree: first
    within stretches of ``FAN`` blocks, then what touches the ends of those among themselves. No task
    gets more than two rows of each of ``FAN`` blocks.
    """
    keys = list(keys)
    at = F.col(order)
    blocked = df.select(*keys, at.cast("long").alias("_t"), label, F.floor(at / block).alias("_b"))
    inside = W.partitionBy(*keys, "_b").orderBy("_t")
    previous = F.lag(label).over(inside)
    opens = (F.lag("_t").over(inside).isNull() | ~previous.eqNullSafe(F.col(label))).cast("int")
    pieces = (
        blocked.withColumn("_open", opens)
        .withColumn("_run", F.sum("_open").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "_b", "_run", label)
        .agg(F.min("_t").alias("start"), (F.max("_t") + 1).alias("_end"))
        .select(*keys, label, "start", "_end")
    )
    # written once: inner runs and the tree of border runs both read it
    open_, width, done = cut_lineage(pieces), block, []
    for _ in range(TREE_LEVELS):
        edge = (F.pmod("start", F.lit(width)) == 0) | (F.pmod("_end", F.lit(width)) == 0)
        done.append(open_.where(~edge))
        width *= FAN
        open_ = _joined_runs(open_.where(edge), keys, label, width)
    for part in done:
        open_ = open_.unionByName(part)
    return open_.select(*keys, label, "start", (F.col("_end") - F.col("start")).alias("length"))


def _joined_runs(pieces: DataFrame, keys: list[str], label: str, width: int) -> DataFrame:
    """Neighbouring runs of the same label within stretches of ``width`` samples as one."""
    stretch = pieces.withColumn("_s", F.floor(F.col("start") / F.lit(width)))
    across = W.partitionBy(*keys, "_s").orderBy("start")
    continues = (F.lag("_end").over(across) == F.col("start")) & F.lag(label).over(across).eqNullSafe(F.col(label))
    return (
        stretch.withColumn("_new", (~F.coalesce(continues, F.lit(False))).cast("int"))
        .withColumn("_group", F.sum("_new").over(across.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "_s", "_group", label)
        .agg(F.min("start").alias("start"), F.max("_end").alias("_end"))
        .select(*keys, label, "start", "_end")
    )


def activation_events(active: DataFrame, keys: Sequence[str] = ("subject", "i", "j")) -> DataFrame:
    """Runs of 1: (keys, onset, offset, duration), the offset exclusive."""
    found = runs(active, keys, "t", "active").where("active = 1")
    return found.select(
        *keys, F.col("start").alias("onset"), (F.col("start") + F.col("length")).alias("offset"), F.col("length").alias("duration")
    )


def nested_events(events: DataFrame) -> DataFrame:
    """Events of every subject and link as one ordered array of structs."""
    packed = F.array_sort(F.collect_list(F.struct("onset", "offset", "duration")))
    return events.groupBy("subject", "i", "j").agg(packed.alias("events"))


def link_dynamics(events: DataFrame) -> DataFrame:
    """Burst count and durations by link over all subjects."""
    return events.groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("duration").alias("mean_duration"), F.max("duration").alias("max_duration")
    )


def dwell_times(states: DataFrame, concat: bool = False) -> DataFrame:
    """Runs of equal state per subject: (subject, cluster, start, length).

    ``concat`` joins the subjects end to end in subject order and returns (cluster, start, length).
    """
    if not concat:
        return runs(states, ["subject"], "t", "cluster")
    lengths = states.groupBy("subject").agg((F.max("t") + 1).cast("long").alias("n"))
    offsets = running_totals(lengths, [], "subject", ["n"]).select("subject", "before_n")
    joined = states.join(offsets, "subject").select((F.col("before_n") + F.col("t")).alias("t"), "cluster")
    return runs(joined, [], "t", "cluster")


def dwell_by_state(dwell: DataFrame) -> DataFrame:
    """Number, mean and longest dwell per state."""
    return dwell.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"), F.max("length").alias("max_length"), F.sum("length").alias("total")
    )
