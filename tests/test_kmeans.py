"""Batched k-means, assignment and the Euclidean silhouette against plain numpy."""

import numpy as np
import pytest
from helpers import signals_df
from pyspark.sql import functions as F

from undula.operators import kmeans as km, states as st


def features_df(spark, x, partitions=3):
    rows = [(k // 50, k % 50, [float(v) for v in p]) for k, p in enumerate(x)]
    return spark.createDataFrame(rows, "subject long, t int, features array<double>").repartition(partitions)


def blobs(seed=4, n=60):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, 0.7, (n, 3)) for c in (-6, 0, 6)])


def lloyd(x, centres, steps):
    for _ in range(steps):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres, ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_batch_equals_single_fits(spark):
    features = features_df(spark, blobs())
    ks, seeds = [2, 3, 5, 3], [1, 1, 2, 9]
    together = km.fit_many(features, ks, seeds)
    for k, seed, (cost, centres) in zip(ks, seeds, together):
        (alone, same), = km.fit_many(features, [k], [seed])
        assert cost == pytest.approx(alone, rel=1e-9) and np.allclose(centres, same)


def test_steps_equal_plain_ones(spark):
    x = blobs(7)
    features = features_df(spark, x)
    data = features.select(F.xxhash64("subject", "t").alias("key"), "features")
    begin = km.starts(data, len(x), [4, 2], [3, 3])
    for f, (cost, centres) in enumerate(km.fit_many(features, [4, 2], [3, 3])):
        own = begin.points[begin.first[f] : begin.first[f] + begin.sizes[f]]
        want, least = lloyd(x, own, 100)
        assert np.allclose(centres, want, atol=1e-3) and cost == pytest.approx(least, rel=1e-6)


def test_restarts_find_the_blobs(spark):
    x = blobs(5)
    centres = st.fit_states(features_df(spark, x), 3, restarts=8)
    assert sorted(np.round(centres.mean(axis=1) / 6).tolist()) == [-1, 0, 1]
    curve = {r["k"]: r["inertia"] for r in st.elbow_curve(features_df(spark, x), [2, 3, 4], restarts=8).collect()}
    assert curve[2] > curve[3] > curve[4] and curve[3] == pytest.approx(lloyd(x, centres, 5)[1], rel=1e-6)


def test_reruns_and_partitions_agree(spark):
    a, b = (km.fit_many(features_df(spark, blobs(2), n), [3], [5])[0] for n in (2, 7))
    assert a[0] == pytest.approx(b[0], rel=1e-9)


def test_few_distinct_samples(spark):
    features = features_df(spark, np.array([[1.0, 1.0]] * 6 + [[2.0, 2.0]] * 6))
    (cost, centres), = km.fit_many(features, [5], [0])
    assert cost == pytest.approx(0) and len(centres) <= 5
    with pytest.raises(ValueError):
        km.fit_many(features.limit(0), [2], [0])


def test_many_fits_share_their_jobs(spark):
    seen, summed = [], km.summed

    def count(*args):
        seen.append(1)
        return summed(*args)

    features = features_df(spark, blobs(3))
    km.summed = count
    try:
        km.fit_many(features, [2, 3, 4] * 20, list(range(60)))
    finally:
        km.summed = summed
    assert len(seen) < 60


def plain_silhouette(x, own):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for k in range(len(x)):
        mine = own == own[k]
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = d[k, mine].sum() / (mine.sum() - 1)
        b = min(d[k, own == c].mean() for c in set(own) - {own[k]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.array(out)


@pytest.mark.parametrize("tile", [7, 1000])
def test_silhouette_equals_plain(spark, tile):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (90, 4))
    x[:10] = x[0]
    own = rng.integers(0, 4, 90)
    own[5] = 9
    labelled = features_df(spark, x).join(spark.createDataFrame([(k // 50, k % 50, int(c)) for k, c in enumerate(own)], "subject long, t int, cluster int"), ["subject", "t"])
    got = {50 * r["subject"] + r["t"]: r["silhouette"] for r in st.silhouette_samples(labelled, tile).collect()}
    assert [got[k] for k in range(90)] == pytest.approx(plain_silhouette(x, own).tolist(), abs=1e-12)
    mean = st.mean_silhouette(labelled).first()
    assert mean["n"] == 90 and mean["silhouette"] == pytest.approx(plain_silhouette(x, own).mean())


def test_one_cluster_has_no_silhouette(spark):
    labelled = features_df(spark, blobs(1, 5)).withColumn("cluster", F.lit(0))
    assert st.mean_silhouette(labelled).first()["silhouette"] is None


def test_constant_region_is_zero(spark):
    x = np.column_stack([np.arange(6.0), np.full(6, 3.0)])
    rows = st.sample_features(signals_df(spark, {0: x})).collect()
    assert all(r["features"][1] == 0 for r in rows)


def test_a_batch_from_which_nothing_is_drawn(spark):
    """Far more batches than draws: most of them add no candidate."""
    from pyspark.sql import functions as F

    from undula.operators.kmeans import fit_many

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        far = F.floor(F.col("id") / 2000) * 10.0
        rows = spark.range(4000).select(F.col("id").alias("t"), F.array(far, F.col("id") % 7 / 100.0).alias("features"))
        found = fit_many(rows, [2, 2], [1, 2])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(sorted(round(c) for c in centres[:, 0]) == [0, 10] for _, centres in found)


def test_silhouette_of_copies(spark):
    """Copies of a sample are one item with a weight, in any number of tiles."""
    from undula.operators import states as st

    rng = np.random.default_rng(4)
    x = np.repeat(np.round(rng.normal(size=(20, 3)), 1), 5, axis=0)
    own = np.repeat(rng.integers(0, 3, 20), 5)
    own[::7] = 1
    rows = [(k, 0, int(own[k]), [float(v) for v in x[k]]) for k in range(len(x))]
    labelled = spark.createDataFrame(rows, "subject long, t int, cluster int, features array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for k in range(len(x)):
        a = d[k, own == own[k]].sum() / ((own == own[k]).sum() - 1)
        b = min(d[k, own == c].mean() for c in set(own) if c != own[k])
        want.append((b - a) / max(a, b) if max(a, b) else 0.0)
    for tile in (4, 4096):
        got = {r.subject: r.silhouette for r in st.silhouette_samples(labelled, tile).collect()}
        assert [got[k] for k in range(len(x))] == pytest.approx(want, abs=1e-9)
        mean = st.mean_silhouette(labelled, tile).first()
        assert (mean.n, mean.silhouette) == (100, pytest.approx(float(np.mean(want))))
    assert st._distinct_silhouettes(labelled, 8).count() == len({(c, tuple(v)) for c, v in zip(own.tolist(), x.tolist())})


def test_a_pass_over_packed_samples(spark):
    """Samples are packed once; a pass counts each sample once per fit, also beside equal centres."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    sets = [x[:4], x[[7, 7, 9]], x[10:14], x[20:22]]
    data = km.blocks(features_df(spark, x).select(F.xxhash64("subject", "t").alias("key"), "features"))
    assert data.count() <= data.rdd.getNumPartitions() and data.agg(F.sum("n")).first()[0] == 300
    counts, sums, cost = km.cluster_sums(data, km.Centres(range(4), sets))
    at = 0
    for f, own in enumerate(sets):
        d = ((x[:, None] - own[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        for c in range(len(own)):
            assert counts[at + c] == (near == c).sum() and np.allclose(sums[at + c], x[near == c].sum(axis=0))
        assert cost[f] == pytest.approx(d.min(axis=1).sum()) == km.least_sums(data, km.Centres(range(4), sets))[f]
        at += len(own)


def test_each_distance_is_worked_out_once(monkeypatch):
    """Two tiles share their distances, and copies in both are at distance 0."""
    from undula.operators import states as st

    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 5)) + 1e3
    x[650:] = x[:50]
    own = rng.integers(0, 3, 700)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    tiles = [(np.arange(a, b), own[a:b], np.ones(b - a), x[a:b]) for a, b in ((0, 400), (400, 700))]
    roots, root = [], np.sqrt
    monkeypatch.setattr(np, "sqrt", lambda v, **kw: roots.append(v.size) or root(v, **kw))
    got = {}
    for batch in st._sums_to_clusters(*tiles, False):
        for r in batch.to_pylist():
            got[r["_item"], r["cluster"]] = r["_total"]
    assert sum(roots) == 400 * 300
    for k in range(700):
        other = slice(400, 700) if k < 400 else slice(0, 400)
        assert [got[k, c] for c in range(3)] == pytest.approx([d[k, other][own[other] == c].sum() for c in range(3)], rel=1e-12)
