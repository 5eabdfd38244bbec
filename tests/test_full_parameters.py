"""Registered queries take every frame and the operators' own runs; the work itself is recorded, not done."""

import inspect

import pytest
from pyspark.sql import functions as F

from undula.operators import community as com, pooling as pool, states as st
from undula.plans import all_queries
from undula.plans.network_queries import stream

SF_DIR = "/root/testdata/sf0.001"
CONSENSUS = [(10, 100), (10, 100), (1, 1)]


@pytest.mark.parametrize(
    "name, windows, calls",
    [
        ("g1_detect_communities", None, [(10, 100)]),
        ("g5_allegiance_communities", None, CONSENSUS),
        ("g6_averaged_allegiance", 24, CONSENSUS),
        ("g8_frame_allegiance", 36, CONSENSUS),
        ("g10_temporal_consensus", None, [(1, 100), (1, 1)]),
    ],
)
def test_detection_is_whole(spark, monkeypatch, name, windows, calls):
    seen, graphs = [], []

    def alone(edges, gammas, runs, seed=0):
        seen.append((len(gammas), runs))
        graphs.append(edges.select("graph_id").distinct())
        nodes = edges.select("graph_id", F.explode(F.array("i", "j")).alias("node")).distinct()
        return nodes.select("graph_id", F.lit(0).alias("gamma_idx"), F.lit(0).alias("run"), "node", F.lit(1).alias("community"))

    def shares(edges, gammas, runs, seed=0):
        return com.contingency(alone(edges, gammas, runs, seed), diagonal=False)

    monkeypatch.setattr(com, "detect_communities", alone)
    monkeypatch.setattr(com, "consensus_weights", shares)
    all_queries()[name](spark, SF_DIR)
    assert seen == calls
    if windows:
        frames = stream(spark, SF_DIR, windows=windows, lag=1).select("subject", "frame").distinct().count()
        assert graphs[0].count() == frames


@pytest.mark.parametrize(
    "name, ks", [("h1_kmeans_states", [4]), ("h2_elbow_curve", list(range(2, 10))), ("h3_silhouette", [4])]
)
def test_states_are_fitted_to_the_end(spark, monkeypatch, name, ks):
    seen, fit = [], st.fit_many

    def once(features, ks, seeds, max_iter):
        seen.extend((k, ks.count(k), max_iter) for k in sorted(set(ks)))
        assert len(set(zip(ks, seeds))) == len(ks)
        few = [ks.index(k) for k in sorted(set(ks))]
        return [f for f in fit(features, [ks[i] for i in few], [seeds[i] for i in few], 1) for _ in range(len(ks) // len(few))]

    monkeypatch.setattr(st, "fit_many", once)
    found = all_queries()[name](spark, SF_DIR)
    assert seen == [(k, 100, 100) for k in ks]
    if name == "h2_elbow_curve":
        assert sorted(r["k"] for r in found.collect()) == ks


def test_band_takes_all_replicas(spark, monkeypatch):
    seen, band = [], pool.bootstrap_ci

    def record(*args, **kw):
        given = inspect.signature(band).bind(*args, **kw)
        given.apply_defaults()
        seen.append(given.arguments["replicas"])
        return band(*args, **kw)

    monkeypatch.setattr(pool, "bootstrap_ci", record)
    all_queries()["d18_bootstrap_quantile_band"](spark, SF_DIR)
    assert seen == [1000]
