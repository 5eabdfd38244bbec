import numpy as np
import pytest
from helpers import signals_df, stream_df, values
from pyspark.sql import functions as F

from undula.operators import community as com, manifold as man, meta, prep, states as st


# ---- motifs


def test_four_regions_have_twelve_trimers(spark):
    links = meta.link_index(spark.createDataFrame([(r,) for r in range(4)], "region int"))
    assert links.count() == 6 and meta.meta_links(links).count() == 15
    found = meta.trimers(links)
    assert found.count() == 12
    assert {r.root: r["count"] for r in found.groupBy("root").count().collect()} == {k: 3 for k in range(4)}
    index = meta.nplet_index(meta.meta_links(links), found)
    assert index.where("nplet = 0").count() == 3
    assert meta.nplet_mask(index, links).where("nplet is null").count() == 6


def test_meta_connectivity_with_chunks_and_tiles(spark):
    rng = np.random.default_rng(0)
    links = rng.normal(size=(10, 50))
    links[4] = 1.0
    got = values(meta.meta_connectivity(stream_df(spark, links), tile=3, chunk=16), ["pair_a", "pair_b"], "mc")
    assert len(got) == 45
    for (a, b), v in got.items():
        want = 0.0 if 4 in (a, b) else np.corrcoef(links[a], links[b])[0, 1]
        assert a > b and v == pytest.approx(want, abs=1e-9)


# ---- states


def test_events_and_dwell_cross_block_borders(spark):
    active = spark.createDataFrame([(0, t, v) for t, v in enumerate([0, 1, 1, 0, 1])], "subject long, t int, active int")
    for block in (1, 2, 3, 100):
        found = st.runs(active, ["subject"], "t", "active", block).where("active = 1").collect()
        assert sorted((r.start, r.length) for r in found) == [(1, 2), (4, 1)]
    events = st.activation_events(active, ["subject"]).collect()
    assert sorted((e.onset, e.offset, e.duration) for e in events) == [(1, 3, 2), (4, 5, 1)]

    labels = spark.createDataFrame([(s, t, v) for s in (0, 1) for t, v in enumerate("aaba")], "subject long, t int, cluster string")
    dwell = st.dwell_times(labels).where("subject = 1").collect()
    assert sorted((r.start, r.cluster, r.length) for r in dwell) == [(0, "a", 2), (2, "b", 1), (3, "a", 1)]
    joined = st.dwell_times(labels, concat=True).collect()
    assert sorted((r.start, r.cluster, r.length) for r in joined) == [(0, "a", 2), (2, "b", 1), (3, "a", 3), (6, "b", 1), (7, "a", 1)]


def test_runs_of_random_labels(spark):
    rng = np.random.default_rng(3)
    series = rng.choice([0, 0, 0, 1], size=300)
    df = spark.createDataFrame([(t, int(v)) for t, v in enumerate(series)], "t int, x int")
    want, start = [], 0
    for t in range(1, 301):
        if t == 300 or series[t] != series[start]:
            want.append((start, int(series[start]), t - start))
            start = t
    assert sorted((r.start, r.x, r.length) for r in st.runs(df, [], "t", "x", 7).collect()) == want


def test_global_efficiency_of_a_chain(spark):
    edges = spark.createDataFrame([("g", 1, 0, 1.0), ("g", 2, 1, 0.5), ("g", 3, 2, 1.0), ("e", 1, 0, 0.0)], "graph_id string, i int, j int, w double")
    got = values(st.global_efficiency(edges, 4), ["graph_id"], "efficiency")
    d = {(0, 1): 1, (0, 2): 3, (0, 3): 4, (1, 2): 2, (1, 3): 3, (2, 3): 1}
    assert got[("g",)] == pytest.approx(2 * sum(1 / v for v in d.values()) / 12) and got[("e",)] == 0


def test_kmeans_separates_two_blobs(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(-5, 1, (40, 3)), rng.normal(5, 1, (40, 3))])
    features = st.sample_features(signals_df(spark, {0: x}))
    model = st.fit_states(features, 2, restarts=2, max_iter=10)
    got = {r.t: r.cluster for r in st.assign_states(model, features).collect()}
    assert len({got[t] for t in range(40)}) == 1 and got[0] != got[79]
    assert st.silhouette(model, features) > 0.8


# ---- communities


@pytest.fixture(scope="module")
def two_cliques(spark):
    edges = [(i, j, 1.0 if (i < 4) == (j < 4) else -0.2) for i in range(8) for j in range(i)]
    return spark.createDataFrame([("g", *e) for e in edges], "graph_id string, i int, j int, w double")


def test_detection_finds_cliques(spark, two_cliques):
    found = com.detect_communities(two_cliques, [1.0, 1.2], runs=2, seed=1)
    for _, rows in {k: [r for r in found.collect() if (r.gamma_idx, r.run) == k] for k in ((0, 0), (1, 1))}.items():
        label = {r.node: r.community for r in rows}
        assert len(label) == 8
        assert len({label[n] for n in range(4)}) == 1 and len({label[n] for n in range(4, 8)}) == 1
        assert label[0] != label[7]
    same = com.detect_communities(two_cliques, [1.0, 1.2], runs=2, seed=1)
    assert sorted(found.collect()) == sorted(same.collect())


def test_allegiance_and_modularity(spark, two_cliques):
    partition, weights = com.allegiance_communities(two_cliques, runs=2, gamma_count=2, twice=False)
    label = {r.node: r.community for r in partition.collect()}
    assert label[0] == label[3] != label[4] == label[7]
    assert {r.w for r in weights.collect()} <= {0.0, 0.25, 0.5, 0.75, 1.0}

    whole = spark.createDataFrame([("g", 0, 0, n, 1) for n in range(8)], "graph_id string, gamma_idx int, run int, node int, community int")
    q = com.modularity(two_cliques, whole, [1.0]).first().q
    assert q == pytest.approx(0.0, abs=1e-12)
    split = whole.withColumn("community", (F.col("node") < 4).cast("int"))
    best = com.modularity(two_cliques, split, [1.0]).first().q
    w = np.array([[0.0 if i == j else (1.0 if (i < 4) == (j < 4) else -0.2) for j in range(8)] for i in range(8)])
    wp, wn = np.maximum(w, 0), np.maximum(-w, 0)
    delta = np.equal.outer(np.arange(8) < 4, np.arange(8) < 4)
    kp, kn = wp.sum(0), wn.sum(0)
    sp, sn = kp.sum(), kn.sum()
    want = ((wp - np.outer(kp, kp) / sp) * delta).sum() / sp - ((wn - np.outer(kn, kn) / sn) * delta).sum() / (sp + sn)
    assert best == pytest.approx(want)


def test_information_of_identical_partitions(spark):
    rows = [("g", 0, run, n, n % 3 + run) for run in range(3) for n in range(9)]
    parts = spark.createDataFrame(rows, "graph_id string, gamma_idx int, run int, node int, community int")
    assert com.mean_nmi(parts).first().mean_nmi == pytest.approx(1.0)
    got = values(com.agreement(parts), ["i", "j"], "agreement")
    assert all(got[k, k] == 3 for k in range(9)) and got[3, 0] == 3 and got[1, 0] == 0


def test_greedy_alignment_is_one_to_one(spark):
    rows = [(0, a, b, n) for a, b, n in ((1, 1, 5), (1, 2, 4), (2, 1, 4), (2, 2, 1), (3, 2, 3))]
    overlap = spark.createDataFrame(rows, "run int, label int, ref_label int, n int")
    got = {r.label: r.ref_label for r in com.align_labels(overlap, ["run"]).collect()}
    assert got == {1: 1, 3: 2}


# ---- manifold


def log_distances(x, t):
    others = np.delete(np.arange(len(x)), t)
    return -np.log(np.sqrt(((x[others] - x[t]) ** 2).sum(1)) + np.finfo(float).eps)


@pytest.mark.parametrize("tile, step", [(16, 1), (1024, 1), (5, 3)])
def test_fluidity_and_dimension_by_brute_force(spark, tile, step):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(70, 3)).cumsum(axis=0)
    signals = signals_df(spark, {0: x})
    over = man.exceedances(signals, 0.9, tile, step)
    samples = man.every(signals, step).select("subject", "t").distinct()
    theta = values(man.fluidity(over, samples, 0.9), ["t"], "theta")
    dim = values(man.local_dimension(over, samples), ["t"], "dimension")
    tail = values(man.local_dimension(over, samples, "l_moments"), ["t"], "dimension")
    assert set(theta) == {(t,) for t in range(0, 70, step)}
    for t in range(0, 70, step):
        y = log_distances(x[::step], t // step)
        u = np.quantile(y, 0.9)
        gaps = np.diff(np.where(y > u)[0])
        s, n, c = (0.1 * (gaps - 1)).sum(), len(gaps), (gaps > 1).sum()
        want = None if s == 0 else (s + n + c - np.sqrt((s + n + c) ** 2 - 8 * c * s)) / (2 * s)
        assert theta[(t,)] == (None if want is None else pytest.approx(want, abs=1e-9))
        excess = np.sort(y[y > u])[:-1] - u
        assert dim[(t,)] == pytest.approx(1 / (excess.mean() + np.finfo(float).eps), rel=1e-9)
        m = len(excess)
        if m < 2:
            assert tail[(t,)] is None
            continue
        l1, l2 = excess.mean(), np.mean([abs(a - b) for i, a in enumerate(excess) for b in excess[:i]]) / 2
        assert tail[(t,)] == pytest.approx(1 / (l1 * (l1 / l2 - 1) + np.finfo(float).eps), rel=1e-6)


@pytest.mark.parametrize("quantile, tile", [(0.0, 8), (0.5, 8), (0.98, 8), (1.0, 8), (0.5, 1024)])
def test_thresholds_with_ties_and_crowded_distances(spark, quantile, tile):
    rng = np.random.default_rng(9)
    cubes = {0: rng.integers(0, 2, (40, 2)).astype(float), 1: np.zeros((30, 2)), 2: 1e4 + 1e-3 * rng.normal(size=(40, 2)), 3: np.ones((1, 2)), 4: np.ones((2, 2))}
    rows = man.sample_rows(signals_df(spark, cubes))
    got = values(man.thresholds(rows, quantile, tile), ["subject", "t"], "u")
    assert set(got) == {(s, t) for s, x in cubes.items() if s != 3 for t in range(len(x))}
    for (s, t), u in got.items():
        assert u == pytest.approx(np.quantile(log_distances(cubes[s], t), quantile), rel=1e-12)


def test_no_sample_sends_its_ties(spark):
    """Equal samples: the last range holds all values, but one row of a sample leaves a tile."""
    bounds = {"lo": F.lit(36.0), "hi": F.lit(37.0), "need": F.lit(40)}
    rows = man.sample_rows(signals_df(spark, {0: np.zeros((64, 2))})).withColumns(bounds)
    sent = man._by_tile(rows, list(bounds), man._values, ["t", "y", "c"], 1024)
    assert (sent.count(), sent.agg(F.sum("c")).first()[0]) == (64, 64 * 63)


def test_step_and_scale_are_checked(spark):
    signals = signals_df(spark, {0: np.ones((4, 2))})
    with pytest.raises(ValueError):
        man.exceedances(signals, step=0)
    with pytest.raises(ValueError):
        man.local_dimension(man.exceedances(signals), signals, "other")


# ---- runs in tiles


@pytest.mark.parametrize("tile", [3, 64])
def test_information_of_runs_by_brute_force(spark, tile):
    rng = np.random.default_rng(3)
    labels = {r: dict(enumerate(rng.integers(1, 5, 30).tolist())) for r in range(11)}
    labels[4] = {n: 1 for n in range(30)}
    labels[5] = {n: 2 for n in range(30)}
    labels[6] = {n: c for n, c in labels[6].items() if n % 3}
    labels[7] = {n: 1 for n in range(100, 110)}
    rows = [(0, 0, r, n, c) for r, row in labels.items() for n, c in row.items()]
    parts = spark.createDataFrame(rows, "graph_id long, gamma_idx int, run int, node int, community int")

    def entropy(seq):
        p = np.unique(seq, axis=0, return_counts=True)[1] / len(seq)
        return float(-(p * np.log(p)).sum())

    want = {}
    for a in labels:
        for b in labels:
            shared = sorted(set(labels[a]) & set(labels[b]))
            if a < b and shared:
                h = entropy(list(labels[a].values())) + entropy(list(labels[b].values()))
                mi = max(h - entropy([(labels[a][n], labels[b][n]) for n in shared]), 0)
                want[a, b] = (mi, 1.0 if h < 1e-12 else 2 * mi / h)
    got = {(r.run1, r.run2): (r.mi, r.nmi) for r in com.partition_information(parts, tile=tile).collect()}
    assert set(got) == set(want)
    for pair, both in want.items():
        assert got[pair] == pytest.approx(both, abs=1e-9)
    mean = com.mean_nmi(parts, tile).collect()
    assert len(mean) == 1 and mean[0].mean_nmi == pytest.approx(np.mean([v[1] for v in want.values()]), abs=1e-9)
    assert com.mean_nmi(parts.where("run = 0")).count() == 0


def test_meta_links_do_not_depend_on_tiles(spark):
    links = meta.link_index(spark.range(7).select(F.col("id").cast("int").alias("region")))
    found = [sorted(tuple(r) for r in meta.meta_links(links, tile=tile).collect()) for tile in (4, 512)]
    assert found[0] == found[1] and len(set(found[0])) == 21 * 20 // 2
    assert all(r[0] > r[1] and r[0] == r[2] * (r[2] - 1) // 2 + r[3] for r in found[0])


# ---- preparation


def test_length_policies_and_padding(spark):
    ragged = signals_df(spark, {0: np.ones((5, 2)), 1: np.ones((3, 2)), 2: np.ones((8, 2))})
    assert {r.subject for r in prep.apply_length_policy(ragged, "exclude_shortest").collect()} == {0, 2}
    assert prep.apply_length_policy(ragged, "truncate").count() == 18
    padded = prep.zero_pad(ragged, 8)
    assert padded.count() == 48 and padded.agg(F.sum("value")).first()[0] == 32
    with pytest.raises(ValueError):
        prep.apply_length_policy(ragged, "other")


def test_phenotypes_and_empty_groups(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.1, 0.5), (3, 0.5, 0.1), (4, 0.1, 0.1), (5, None, 0.5)], "subject long, OiP_2M double, OiP_4M double")
    got = values(prep.classify_phenotypes(df), ["subject"], "Phenotype_OiP")
    assert [got[(k,)] for k in range(1, 6)] == ["good", "learners", "impaired", "bad", None]
    with pytest.raises(ValueError):
        prep.classify_phenotypes(df, "RO24h")
    cohort = spark.createDataFrame([(1, "wt", "veh", "2m")], "subject long, genotype string, treatment string, session string")
    groups = prep.combination_groups(cohort, "genotype", "treatment", ["wt", "dKI"], ["veh"])
    assert {(r.label, r.subject) for r in groups.collect()} == {("wt_veh 2m", 1), ("wt_veh 4m", None), ("dKI_veh 2m", None), ("dKI_veh 4m", None)}


def test_series_names(spark):
    names = spark.createDataFrame([("tc_Coimagine_m12_3_44_seeds.mat",), ("other.mat",), ("x_lot3_0123_s",)], "name string")
    keys = prep.extract_keys(names, "name", prep.series_key("name")).collect()
    assert [r.key for r in keys] == ["m12_3"]
    assert [r.key for r in prep.extract_keys(names, "name", prep.lot_number("name")).collect()] == [123]


def test_alignment_is_validated(spark):
    signals = signals_df(spark, {1: np.ones((5, 2)), 2: np.ones((5, 2))})
    good = spark.createDataFrame([(1, 5), (2, 5)], "subject long, n int")
    prep.validate_alignment(signals, good, "n")
    with pytest.raises(ValueError):
        prep.validate_alignment(signals, good.where("subject = 1"))
    with pytest.raises(ValueError):
        prep.validate_alignment(signals, good.withColumn("n", F.lit(6)), "n")


# ---- adaptive cells, run trees, assignment, frame checks


def test_crowded_values_are_cut_into_cells(spark, monkeypatch):
    from undula.operators import order_stats as ost

    monkeypatch.setattr(ost, "CELL_BUDGET", 100)
    rng = np.random.default_rng(2)
    near = 5.0 + rng.uniform(0, 1e-6, 4000)
    nested = 9.0 + rng.uniform(0, 1e-9, 2000)
    values_ = [("a", float(v)) for v in near] + [("b", float(v)) for v in [*nested, 9.01, -3.0, 0.0]] + [("c", 1.0)] * 500
    df = spark.createDataFrame(values_, "k string, v double")
    cells = ost.in_cells(ost.value_counts(df, ["k"], "v"), ["k"], "v")
    assert cells.groupBy("k", *ost.CELL).count().agg(F.max("count")).first()[0] <= 3 * 100
    ranks = ost.average_rank(df, ["k"], "v", "rank").collect()
    for key in "abc":
        own = sorted(v for k, v in values_ if k == key)
        first, count = {}, {}
        for n, v in enumerate(own):
            first.setdefault(v, n)
            count[v] = count.get(v, 0) + 1
        assert all(r["rank"] == first[r["v"]] + (count[r["v"]] + 1) / 2 for r in ranks if r["k"] == key)
    got = {(r.k, r.level_idx): r["quantile"] for r in ost.quantiles(df, ["k"], "v", [0.1, 0.5, 0.99]).collect()}
    for key in "abc":
        own = [v for k, v in values_ if k == key]
        assert [got[key, n] for n in range(3)] == pytest.approx(np.quantile(own, [0.1, 0.5, 0.99]).tolist(), abs=1e-14)


def test_run_tree_equals_plain_runs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.integers(0, 3, 90), rng.integers(1, 60, 90))
    want, begin = [], 0
    for t in range(1, len(x) + 1):
        if t == len(x) or x[t] != x[t - 1]:
            want.append((begin, int(x[begin]), t - begin))
            begin = t
    df = spark.createDataFrame([(t, int(v)) for t, v in enumerate(x)], "t int, x int")
    for block, fan, levels in ((7, 4, 6), (5, 3, 8), (4096, 1 << 20, 2), (7, 1 << 20, 2)):
        monkeypatch.setattr(st, "FAN", fan)
        monkeypatch.setattr(st, "TREE_LEVELS", levels)
        assert sorted((r.start, r.x, r.length) for r in st.runs(df, [], "t", "x", block).collect()) == want
    plan = st.runs(df, [], "t", "x")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_best_assignment_equals_brute_force(spark):
    import itertools

    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = rng.integers(1, 7, 2)
        gain = np.where(rng.uniform(size=(a, b)) < 0.6, rng.integers(1, 9, (a, b)), 0).astype(float)
        pairs = com.best_assignment(gain)
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
        wide = np.concatenate([gain, np.zeros((a, a))], axis=1)
        best = max(sum(wide[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(a + b), int(a))) if a + b <= 8 else None
        if best is not None:
            assert sum(gain[r, c] for r, c in pairs) == best
    rows = [(0, a, b, n) for a, b, n in ((1, 1, 5), (1, 2, 4), (2, 1, 4), (2, 2, 1), (3, 2, 3))]
    overlap = spark.createDataFrame(rows, "run int, label int, ref_label int, n int")
    got = {r.label: r.ref_label for r in com.assign_labels(overlap, ["run"]).collect()}
    assert got in ({1: 1, 3: 2}, {1: 2, 2: 1}) and com.assign_labels(overlap.limit(0), ["run"]).count() == 0


def test_too_few_frames_fail_when_read(spark):
    from helpers import stream_df

    from undula.operators import speed as spd

    stream = stream_df(spark, np.random.default_rng(1).normal(size=(3, 20)))
    assert spd.dfc_speed(stream, 19).count() == 0
    for step in (20, 300):
        with pytest.raises(Exception, match="must be less than number of frames"):
            spd.dfc_speed(stream, step).collect()
        assert spd.dfc_speed(stream, step, check_frames=False).count() == 0


def test_lot_numbers_of_more_than_four_digits(spark):
    names = spark.createDataFrame([("batch_lot3_0042_a",), ("batch_lot3_12345_a",), ("batch_lot3_00427_x",), ("other",)], "name string")
    from undula.operators import prep

    got = {r.name: r.key for r in prep.extract_keys(names, "name", prep.lot_number("name")).collect()}
    assert got == {"batch_lot3_0042_a": 42, "batch_lot3_12345_a": 12345, "batch_lot3_00427_x": 427}


def test_lot_numbers_equal_sql_beyond_9999(spark, tmp_path):
    import oracle
    from undula.plans import all_oracles, all_queries

    spark.range(9990, 10020).selectExpr("id AS s_suppkey").coalesce(1).toPandas().to_parquet(tmp_path / "supplier.parquet")
    got = oracle.spark_table(all_queries()["a3_lot_numbers"](spark, str(tmp_path)))
    assert oracle.difference(got, oracle.sql_table(oracle.connect(str(tmp_path)), all_oracles()["a3_lot_numbers"])) is None


def test_theil_sen_of_copied_points(spark, monkeypatch):
    """Slopes count as often as their points occur, while only distinct points are paired."""
    from undula.operators import stats

    rng = np.random.default_rng(6)
    points = np.round(rng.normal(size=(25, 2)), 1)
    x, y = np.repeat(points, rng.integers(1, 30, 25), axis=0).T
    rows = spark.createDataFrame([(k, "g", float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "subject long, k string, x double, y double")
    seen, paired = [], stats.tile_pairs
    monkeypatch.setattr(stats, "tile_pairs", lambda items, *a: seen.append(items.count()) or paired(items, *a))
    got = stats.theil_sen(rows, "x", "y", ["k"], tile=6).first()
    dx, dy = x[None] - x[:, None], y[None] - y[:, None]
    slope = np.median(dy[dx > 0] / dx[dx > 0])
    assert got.slope == pytest.approx(slope) and got.intercept == pytest.approx(np.median(y) - slope * np.median(x))
    assert seen == [len({tuple(p) for p in points.tolist()})]


def test_pairs_of_tiles_leave_in_pieces(spark):
    """No task turns a whole batch of tile pairs into products at once."""
    from undula.operators.pairing import correlate_items

    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 6))
    x[7] = 1.0
    rows = spark.createDataFrame([(k, a, float(x[k, a])) for k in range(150) for a in range(6)], "m long, a int, v double")
    out = correlate_items(rows, [], "m", "a", "v", "p", "q", "r", tile=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    got = {(r.p, r.q): r.r for r in out.collect()}
    assert len(got) == 150 * 149 // 2 and all(p < q for p, q in got)
    for p, q in ((0, 1), (3, 149), (60, 61), (7, 20)):
        assert got[p, q] == pytest.approx(0.0 if 7 in (p, q) else np.corrcoef(x[p], x[q])[0, 1])


def test_meta_connectivity_of_series_equals_that_of_the_stream(spark):
    from undula.operators import connectivity as con, meta

    rng = np.random.default_rng(3)
    signals = signals_df(spark, {1: rng.normal(size=(600, 4)), 2: rng.normal(size=(50, 4))})
    key = ["subject", "pair_a", "pair_b"]
    want = values(meta.meta_connectivity(con.dfc_stream(signals, 12)), key, "mc")
    got = values(meta.meta_connectivity_of_series(con.link_series(signals, [12])), key, "mc")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_tiles_of_matrices_grow_with_their_number(spark, monkeypatch):
    """All pairs of many items travel in a bounded number of tiles, so each item goes to few of them."""
    from undula.operators import pairing, stats

    rows = spark.range(700).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"))
    rows = rows.withColumn("w", F.rand(1))
    sizes, tiled = [], pairing.tile_pairs
    monkeypatch.setattr(pairing, "TILES", 4)
    monkeypatch.setattr(pairing, "tile_pairs", lambda *a: sizes.append(a[-1]) or tiled(*a))
    assert stats.matrix_correlation(rows, "g", ["c"], "w").count() == 700 * 699 // 2
    assert sizes == [175]
