"""Communities of many small graphs: the trials of a graph are worked off together in one task.

A graph of regions has as many nodes as a recording has channels. Its matrix is packed into one
row, as samples and partitions are elsewhere, and dealt out once per gamma and block of runs. A task
stacks the units of equal node count and moves the same position of every trial's node order at
once, so numpy sees all trials of all graphs in a batch and no shuffle is needed between rounds.

With the modularity matrix b (link weight less its expectation, positive and negative links weighed
by their own totals) the gain of joining a community is the sum of b over its members. Nodes move
one after another in a hashed order to their best community, an empty one included, so modularity
rises with each move and the rounds end; then communities become the nodes, with the sums of b
between them, until a level changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from undula.functions.partitioning import spread
from undula.operators import tabled_detection

#: Cells of stacked matrices held at once in a task.
CELLS = 1 << 19
#: Runs of a graph and gamma in one unit of work.
RUN_BLOCK = 100
#: Matrices up to this size are packed; their rows stay below 8 MB.
PACKED_NODES = 512
#: A level that still moves after so many sweeps is reported as an error.
SWEEPS_LIMIT = 10_000
EPSILON = 1e-12
#: Graphs up to this size take all their gammas along.
TOGETHER_NODES = 32
#: A partition of so many nodes, beside its owner, is one 64-bit number.
CODED_NODES = 12


def modularity_matrix(w: np.ndarray, gamma: float) -> np.ndarray:
    """Signed modularity matrix of a symmetric matrix without diagonal; its sum within communities is Q."""
    plus, minus = np.maximum(w, 0.0), np.maximum(-w, 0.0)
    kp, kn = plus.sum(axis=1), minus.sum(axis=1)
    sp, sn = kp.sum(), kn.sum()
    b = np.zeros_like(w)
    if sp > 0:
        b += (plus - gamma * np.outer(kp, kp) / sp) / sp
    if sp + sn > 0 and sn > 0:
        b -= (minus - gamma * np.outer(kn, kn) / sn) / (sp + sn)
    return b


def _hash(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit hash of each number."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _orders(keys: np.ndarray, level: int, sweep: int, n: int) -> np.ndarray:
    """A permutation of the nodes per trial."""
    salt = _hash(keys ^ _hash(np.array(level << 20 | sweep, np.uint64)))
    return np.argsort(_hash(salt[:, None] ^ _hash(np.arange(n, dtype=np.uint64))), axis=1)


def _moves(b: np.ndarray, owner: np.ndarray, keys: np.ndarray, level: int) -> np.ndarray:
    """Community of each node of each trial once no node gains by moving; trials share the matrices ``b`` of their owners.

    Arrays are (nodes, trials). Whether a node still wants to move depends on the partition only, so it is asked once
    for all trials of an owner that hold the same one, and only trials that will move get another sweep.
    """
    trials, n = len(owner), b.shape[1]
    flat, nodes = b.ravel(), np.arange(n)[:, None]
    label = np.repeat(nodes, trials, axis=1)
    going = np.arange(trials)
    for sweep in range(SWEEPS_LIMIT):
        order = _orders(keys[going], level, sweep, n)
        size, at, first = len(going), np.arange(len(going)), owner[going] * n
        # the place of a node's community in the scores
        own = label[:, going] * size + at
        for p in range(n):
            v = order[:, p]
            row = flat.take((first + v) * n + nodes)
            score = np.bincount(own.ravel(), row.ravel(), n * size)
            best, top = _first_largest(score.reshape(n, size))
            goes = np.flatnonzero(top - score[own[v, at]] > EPSILON)
            own[v[goes], goes] = best[goes] * size + goes
        label[:, going] = own // size
        going = going[_wanting(b, owner[going], label[:, going])]
        if not len(going):
            return label.T
    raise RuntimeError(f"communities are still moving after {SWEEPS_LIMIT} sweeps")


def _first_largest(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per column the first place of the largest value, and that value."""
    if len(score) > 16:
        best = score.argmax(axis=0)
        return best, score[best, np.arange(score.shape[1])]
    top, best = score[0].copy(), np.zeros(score.shape[1], np.int64)
    for c in range(1, len(score)):
        higher = score[c] > top
        np.copyto(best, c, where=higher)
        np.maximum(top, score[c], out=top)
    return best, top


def _distinct(owner: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a trial of each distinct partition of an owner, which of them each trial holds, labels by the first node of a community).

    Graphs of more than ``CODED_NODES`` nodes have few equal partitions; each of their trials stands for itself.
    """
    n, trials = label.shape
    at = np.arange(trials)
    first = np.empty((n, trials), np.int64)
    for v in range(n - 1, -1, -1):
        first[label[v], at] = v
    named = first[label, at]
    if n > CODED_NODES:
        return at, at, named
    code = owner.copy()
    for v in range(n):
        code = code * n + named[v]
    _, one, which = np.unique(code, return_index=True, return_inverse=True)
    return one, which.ravel(), named


def _wanting(b: np.ndarray, owner: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Whether a trial has a node that gains by moving."""
    one, which, named = _distinct(owner, label)
    named = named[:, one].T
    score = b[owner[one]] @ np.eye(len(label))[named]
    own = np.take_along_axis(score, named[:, :, None], axis=2)[:, :, 0]
    return (score.max(axis=2) - own > EPSILON).any(axis=1)[which]


def _without_diagonal(b: np.ndarray) -> np.ndarray:
    out = b.copy()
    out[:, np.arange(b.shape[1]), np.arange(b.shape[1])] = 0.0
    return out


def communities(b: np.ndarray, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """(trials, nodes) communities from 1 on, numbered by their first node; a trial moves on the matrix ``b[owner]``."""
    trials, n = len(owner), b.shape[1]
    home = np.tile(np.arange(n), (trials, 1))
    alive, level = np.arange(trials), 0
    while len(alive):
        label = _moves(_without_diagonal(b), owner, keys[alive], level)
        # Communities become the nodes, named by the first of theirs. Where none of them gains by joining another one, nothing more will change.
        one, which, named = _distinct(owner, label.T)
        label = named.T
        home[alive] = np.take_along_axis(label, home[alive], axis=1)
        members = np.eye(n)[named[:, one].T]
        merged = _without_diagonal(np.swapaxes(members, 1, 2) @ b[owner[one]] @ members)
        on = np.flatnonzero((merged > EPSILON).any(axis=(1, 2))[which])
        alive, label = alive[on], label[on]
        if len(on):
            members = np.eye(n)[label]
            b = np.swapaxes(members, 1, 2) @ b[owner[on]] @ members
            owner = np.arange(len(on))
        level += 1
    # Communities in the order of their first node.
    first = np.full((trials, n), n)
    np.minimum.at(first, (np.arange(trials)[:, None], home), np.arange(n)[None, :])
    rank = np.argsort(np.argsort(first, axis=1, kind="stable"), axis=1) + 1
    return np.take_along_axis(rank, home, axis=1)


def _units(edges: DataFrame, gammas: Sequence[float], runs: int) -> DataFrame:
    """graph_id, nodes, links, gammas, first_run, n_runs: the units of work, dealt evenly.

    A graph of up to ``TOGETHER_NODES`` nodes takes all its gammas along, a larger one is dealt out gamma by gamma.
    """
    link = F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.col("w").alias("w"))
    packed = edges.where("i <> j").groupBy("graph_id").agg(F.collect_list(link).alias("links"))
    nodes = F.array_sort(F.array_distinct(F.concat(F.col("links.i"), F.col("links.j"))))
    each = [F.struct(F.lit(g).alias("gamma_idx"), F.lit(float(gamma)).alias("gamma")) for g, gamma in enumerate(gammas)]

    def trials(groups):
        return F.array(*[
            F.struct(F.array(*group).alias("gammas"), F.lit(at).alias("first_run"), F.lit(min(RUN_BLOCK, runs - at)).alias("n_runs"))
            for group in groups for at in range(0, runs, RUN_BLOCK)
        ])

    dealt = F.when(F.size("nodes") <= TOGETHER_NODES, trials([each])).otherwise(trials([[g] for g in each]))
    units = packed.withColumn("nodes", nodes).withColumn("unit", F.explode(dealt)).select("graph_id", "nodes", "links", "unit.*")
    return spread(units.withColumn("_g", F.get("gammas", F.lit(0))["gamma_idx"]), F.xxhash64("graph_id"), "_g", "first_run").drop("_g")


def _matrix(nodes: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    n = len(nodes)
    out = np.zeros((n, n))
    a, b = np.searchsorted(nodes, i), np.searchsorted(nodes, j)
    np.add.at(out, (a, b), w)
    return out + out.T


def _solved(batch: pa.RecordBatch, seed: int):
    """(rows of the batch, their (gamma_idx, run) per trial, labels (rows, trials, nodes)) of units alike in nodes, gammas and runs."""
    nodes = [np.asarray(x) for x in batch.column("nodes").to_pylist()]
    gammas = batch.column("gammas").to_pylist()
    first, runs = batch.column("first_run").to_numpy(), batch.column("n_runs").to_numpy()
    alike: dict[tuple, list[int]] = {}
    for k, v in enumerate(nodes):
        alike.setdefault((len(v), tuple(g["gamma_idx"] for g in gammas[k]), int(first[k]), int(runs[k])), []).append(k)
    for (n, indices, at, count), rows in alike.items():
        gamma_idx, run = np.repeat(indices, count), np.tile(np.arange(at, at + count), len(indices))
        keys = _hash(
            _hash(run.astype(np.uint64)) ^ _hash(gamma_idx.astype(np.uint64) + np.uint64(1 << 32)) ^ _hash(np.array(seed & (1 << 63) - 1, np.uint64))
        )
        step = max(1, CELLS // max(1, len(run) * n * n))
        for lo in range(0, len(rows), step):
            own = rows[lo : lo + step]
            yield own, gamma_idx, run, _labels(batch, own, nodes, gammas[own[0]], count, keys, n)


def _labels(batch, own, nodes, gammas, count: int, keys: np.ndarray, n: int) -> np.ndarray:
    links, single = batch.column("links"), []
    for k in own:
        flat = links[k].values
        w = _matrix(nodes[k], *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "w")))
        single += [modularity_matrix(w, g["gamma"]) for g in gammas]
    single = np.stack(single)
    if n <= tabled_detection.TABLED_NODES:
        return _tabled(single, len(gammas), count, keys).reshape(len(own), -1, n)
    owner, keys = np.repeat(np.arange(len(single)), count), np.tile(keys, len(own))
    # A unit alone may exceed the bound; its trials are then worked off in pieces.
    step = max(1, CELLS // max(1, n * n))
    labels = np.concatenate([communities(single, owner[a : a + step], keys[a : a + step]) for a in range(0, len(owner), step)])
    return labels.reshape(len(own), -1, n)


def _tabled(single: np.ndarray, gammas: int, count: int, keys: np.ndarray) -> np.ndarray:
    """(trials, nodes) communities by tables; ``single`` are the matrices of graphs, gamma by gamma."""
    n, found, kept = single.shape[1], [], keys.tobytes()
    step = max(1, tabled_detection.MATRICES // gammas) * gammas
    for lo in range(0, len(single), step):
        b = single[lo : lo + step]
        owner = np.repeat(np.arange(len(b)), count)
        which = np.tile(np.arange(len(keys)), len(b) // gammas)
        found.append(tabled_detection.communities(b, owner, which, lambda level, sweep: _kept_orders(kept, level, sweep, n), EPSILON))
    return tabled_detection.partitions_of(n).ranks[np.concatenate(found)]


@lru_cache(maxsize=256)
def _kept_orders(keys: bytes, level: int, sweep: int, n: int) -> np.ndarray:
    """(nodes, trials): the orders, which all graphs share."""
    return np.ascontiguousarray(_orders(np.frombuffer(keys, np.uint64), level, sweep, n).T)


def _run(edges: DataFrame, gammas: Sequence[float], runs: int, seed: int, out, columns: list[tuple[str, T.DataType, pa.DataType]]) -> DataFrame:
    """``out(rows, gamma_idx, run, labels)`` names the row of each result and its columns."""
    units = _units(edges, gammas, runs)
    schema = T.StructType([units.schema["graph_id"], units.schema["nodes"], *[T.StructField(c, t) for c, t, _ in columns]])

    def solve(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for found in _solved(part, seed):
                    own, made = out(*found)
                    own = pa.array(own)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c).take(own) for c in ("graph_id", "nodes")] + [pa.array(v, t) for v, (_, _, t) in zip(made, columns)],
                        names=["graph_id", "nodes", *[c for c, _, _ in columns]],
                    )

    return units.mapInArrow(solve, schema)


def partitions(edges: DataFrame, gammas: Sequence[float], runs: int, seed: int) -> DataFrame:
    """(graph_id, gamma_idx, run, node, community)"""

    def listed(rows, gamma_idx, run, labels):
        made = [np.tile(gamma_idx, len(rows)), np.tile(run, len(rows)), list(labels.reshape(-1, labels.shape[2]).astype(np.int32))]
        return np.repeat(rows, len(run)), made

    found = _run(
        edges, gammas, runs, seed, listed,
        [("gamma_idx", T.IntegerType(), pa.int32()), ("run", T.IntegerType(), pa.int32()), ("labels", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))],
    )
    return found.select("graph_id", "gamma_idx", "run", F.explode(F.arrays_zip("nodes", "labels")).alias("_n")).select(
        "graph_id", "gamma_idx", "run", F.col("_n.nodes").alias("node"), F.col("_n.labels").alias("community")
    )


def co_assignment(edges: DataFrame, gammas: Sequence[float], runs: int, seed: int) -> DataFrame:
    """(graph_id, i, j, w), i > j: share of all trials in which two nodes are together; trials are added up in the task."""

    def counts(rows, gamma_idx, run, labels):
        i, j = np.tril_indices(labels.shape[2], -1)
        small = labels.astype(np.int16)
        step = max(1, CELLS // max(1, len(rows) * len(i)))
        together = np.zeros((len(rows), len(i)), np.int64)
        for at in range(0, len(run), step):
            piece = small[:, at : at + step]
            together += (piece[:, :, i] == piece[:, :, j]).sum(axis=1)
        return np.asarray(rows), [list(together), np.full(len(rows), len(run))]

    found = _run(
        edges, gammas, runs, seed, counts,
        [("together", T.ArrayType(T.LongType()), pa.list_(pa.int64())), ("trials", T.LongType(), pa.int64())],
    )
    cells = found.select("graph_id", "nodes", "trials", F.posexplode("together").alias("_k", "_same"))
    # Row-major place k of the lower triangle belongs to row i with i (i - 1) / 2 <= k.
    i = F.floor((F.sqrt(8.0 * F.col("_k") + 1.0) + 1.0) / 2.0).cast("int")
    rows = cells.withColumn("_i", i).withColumn("_j", (F.col("_k") - F.col("_i") * (F.col("_i") - 1) / 2).cast("int"))
    named = rows.select("graph_id", F.get("nodes", "_i").alias("i"), F.get("nodes", "_j").alias("j"), "_same", "trials")
    return named.groupBy("graph_id", "i", "j").agg((F.sum("_same") / F.sum("trials")).alias("w"))
