"""Packed community detection: optimum of small graphs, quality against the search in rounds, counts."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import community as com, packed_detection as packed


def graphs(seed, count, n):
    rng = np.random.default_rng(seed)
    rows, matrices = [], {}
    for g in range(count):
        w = np.round(rng.uniform(-1, 1, (n, n)), 3)
        w = np.tril(w, -1) + np.tril(w, -1).T
        matrices[f"g{g}"] = w
        rows += [(f"g{g}", i, j, float(w[i, j])) for i in range(n) for j in range(i)]
    return rows, matrices


def edges_df(spark, rows):
    return spark.createDataFrame(rows, "graph_id string, i int, j int, w double")


def set_partitions(n):
    def grow(labels):
        if len(labels) == n:
            yield labels
            return
        for c in range(max(labels, default=-1) + 2):
            yield from grow([*labels, c])

    return grow([])


def q(b, labels):
    labels = np.asarray(labels)
    return float((b * (labels[:, None] == labels[None, :])).sum())


def qualities(spark, edges, found, gammas):
    return {(r.graph_id, r.gamma_idx, r.run): r.q for r in com.modularity(edges, found, gammas).collect()}


def test_best_run_is_the_optimum_of_small_graphs(spark):
    rows, matrices = graphs(1, 6, 6)
    edges, gammas = edges_df(spark, rows), [0.8, 1.3]
    got = qualities(spark, edges, com.detect_communities(edges, gammas, 30, seed=3), gammas)
    for (g, w), k in itertools.product(matrices.items(), range(2)):
        b = packed.modularity_matrix(w, gammas[k])
        top = max(q(b, p) for p in set_partitions(6))
        runs = [v for (gg, kk, _), v in got.items() if (gg, kk) == (g, k)]
        assert len(runs) == 30 and max(runs) == pytest.approx(top, abs=1e-9)


def test_no_single_move_is_better(spark):
    rows, matrices = graphs(2, 4, 12)
    found = com.detect_communities(edges_df(spark, rows), [1.0], 5, seed=1).collect()
    for g, w in matrices.items():
        b = packed.modularity_matrix(w, 1.0)
        for run in range(5):
            label = np.array([r.community for r in sorted((r for r in found if (r.graph_id, r.run) == (g, run)), key=lambda r: r.node)])
            assert len(label) == 12 and set(label) == set(range(1, label.max() + 1))
            now = q(b, label)
            for a, c in itertools.combinations(range(1, label.max() + 1), 2):
                assert q(b, np.where(label == a, c, label)) <= now + 1e-9


def test_quality_is_not_below_the_search_in_rounds(spark):
    rows, _ = graphs(3, 3, 9)
    edges = edges_df(spark, rows)
    new = qualities(spark, edges, com.detect_communities(edges, [1.0], 8, seed=2), [1.0])
    old = qualities(spark, edges, com.detect_in_rounds(edges, [1.0], 8, seed=2), [1.0])
    for g in ("g0", "g1", "g2"):
        a, b = ([v for (gg, _, _), v in x.items() if gg == g] for x in (new, old))
        assert max(a) >= max(b) - 1e-12 and np.mean(a) >= np.mean(b) - 0.02


def test_reruns_agree_and_runs_differ(spark):
    rows, _ = graphs(4, 2, 10)
    one = sorted(com.detect_communities(edges_df(spark, rows).repartition(5), [1.0], 12, seed=5).collect())
    two = sorted(com.detect_communities(edges_df(spark, rows[::-1]), [1.0], 12, seed=5).collect())
    assert one == two and len({tuple(r.community for r in one if (r.graph_id, r.run) == ("g0", k)) for k in range(12)}) > 1


def test_shares_equal_contingency_of_the_partitions(spark, monkeypatch):
    rows, _ = graphs(5, 3, 7)
    edges, gammas = edges_df(spark, rows), [0.9, 1.1]
    for block in (100, 3):
        monkeypatch.setattr(packed, "RUN_BLOCK", block)
        want = com.contingency(com.detect_communities(edges, gammas, 7, seed=4), diagonal=False)
        got = com.consensus_weights(edges, gammas, 7, seed=4)
        key = lambda df: {(r.graph_id, r.i, r.j): r.w for r in df.collect()}
        a, b = key(got), key(want)
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_small_pieces_change_nothing(spark, monkeypatch):
    rows, _ = graphs(6, 3, 8)
    edges = edges_df(spark, rows)
    want = sorted(com.detect_communities(edges, [1.0], 6, seed=1).collect())
    monkeypatch.setattr(packed, "CELLS", 100)
    assert sorted(com.detect_communities(edges, [1.0], 6, seed=1).collect()) == want


def test_larger_graphs_move_in_rounds(spark, monkeypatch):
    rows, _ = graphs(7, 1, 4)
    big = [("big", i, j, 1.0 if (i < 5) == (j < 5) else -0.2) for i in range(10) for j in range(i)]
    monkeypatch.setattr(packed, "PACKED_NODES", 6)
    edges = edges_df(spark, rows + big)
    found = com.detect_communities(edges, [1.0], 2, seed=1).where("graph_id = 'big'").collect()
    for run in range(2):
        label = {r.node: r.community for r in found if r.run == run}
        assert len({label[n] for n in range(5)}) == 1 and len(set(label.values())) == 2
    shares = {(r.graph_id, r.i, r.j): r.w for r in com.consensus_weights(edges, [1.0], 2, seed=1).collect()}
    assert shares["big", 1, 0] == 1.0 and shares["big", 9, 0] == 0.0 and ("g0", 3, 2) in shares


def test_any_graph_key_and_odd_links(spark):
    edges = edges_df(spark, [("a", 1, 0, 0.0), ("b", 2, 2, 5.0), ("b", 7, 3, -1.0), ("c", 5, 4, 2.0)])
    keyed = edges.select(F.struct(F.col("graph_id").alias("name"), F.lit(3).alias("frame")).alias("graph_id"), "i", "j", "w")
    got = {(r.graph_id.name, r.node): r.community for r in com.detect_communities(keyed, [1.0], 1).collect()}
    assert got == {("a", 0): 1, ("a", 1): 2, ("b", 3): 1, ("b", 7): 2, ("c", 4): 1, ("c", 5): 1}
    assert com.detect_communities(edges.limit(0), [1.0], 2).count() == 0


def test_trials_that_hold_one_partition_are_asked_once(monkeypatch):
    """Sweeps end as soon as no node wants to move, and equal partitions of a graph are looked at once."""
    rng = np.random.default_rng(1)
    w = np.kron(np.eye(2), np.ones((4, 4))) - 0.5 + rng.uniform(0, 0.01, (8, 8))
    w = (w + w.T) / 2
    np.fill_diagonal(w, 0.0)
    b = packed.modularity_matrix(w, 1.0)
    asked, orders = [], []
    distinct, order = packed._distinct, packed._orders
    monkeypatch.setattr(packed, "_distinct", lambda *a: asked.append(len((found := distinct(*a))[0])) or found)
    monkeypatch.setattr(packed, "_orders", lambda keys, *a: orders.append(len(keys)) or order(keys, *a))
    label = packed.communities(b[None], np.zeros(500, np.int64), np.arange(500, dtype=np.uint64))
    assert (label == [1, 1, 1, 1, 2, 2, 2, 2]).all()
    assert max(asked) < 50 and sum(orders) < 1000


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_tables_give_the_partitions_of_the_moves(n, monkeypatch):
    """Small graphs look up what the search node by node works out, gamma by gamma and level by level."""
    from undula.operators import tabled_detection as tabled

    rng = np.random.default_rng(n)
    w = [rng.uniform(-1, 1, (n, n)) for _ in range(5)]
    single = np.stack([packed.modularity_matrix(np.tril(x, -1) + np.tril(x, -1).T, g) for x in w for g in (0.8, 1.1, 1.3)])
    keys = packed._hash(np.arange(3 * 40, dtype=np.uint64))
    owner, each = np.repeat(np.arange(15), 40), np.tile(keys, 5)
    want = packed.communities(single, owner, each)
    for matrices in (1, 80):
        monkeypatch.setattr(tabled, "MATRICES", matrices)
        assert (packed._tabled(single, 3, 40, keys) == want).all()
