import numpy as np
import pytest
from helpers import signals_df, stream_df, values

from undula.operators import connectivity as con, speed as spd


def ranks(v):
    order = np.argsort(v, kind="stable")
    out = np.empty(len(v))
    out[order] = np.arange(1, len(v) + 1)
    for u in np.unique(v):
        out[v == u] = out[v == u].mean()
    return out


def similarity(a, b, method):
    if method == "spearman":
        a, b = ranks(a), ranks(b)
    if method != "cosine":
        a, b = a - a.mean(), b - b.mean()
    norm = np.sqrt((a @ a) * (b @ b))
    return a @ b / norm if norm > 0 else 0.0


@pytest.fixture(scope="module")
def links():
    rng = np.random.default_rng(42)
    return 0.1 * rng.normal(size=(45, 100)) + np.sin(np.linspace(0, 4 * np.pi, 100))


@pytest.mark.parametrize("method", ["pearson", "spearman", "cosine"])
@pytest.mark.parametrize("step", [1, 5, 10])
def test_unified_speed(spark, links, method, step):
    got = values(spd.dfc_speed(stream_df(spark, links), step, method), ["frame1", "frame2"], "speed")
    assert len(got) == 100 - step - 1
    for (a, b), v in got.items():
        assert b == a + step
        assert v == pytest.approx(np.clip(1 - similarity(links[:, a], links[:, b], method), -1, 2), abs=1e-9)


def test_classic_count_and_full_matrix(spark, links):
    stream = stream_df(spark, links)
    assert spd.dfc_speed(stream, 2, count="classic").count() == 98
    got = values(spd.dfc_speed(stream, 2, count="classic", matrix="full"), ["frame1"], "speed")
    whole = [np.concatenate([links[:, f], links[:, f], np.ones(10)]) for f in range(100)]
    assert got[(7,)] == pytest.approx(1 - similarity(whole[7], whole[9], "pearson"), abs=1e-9)


def test_long_stream_crosses_block_borders(spark):
    rng = np.random.default_rng(5)
    links = rng.normal(size=(3, 900))
    got = values(spd.dfc_speed(stream_df(spark, links), 40), ["frame1"], "speed")
    assert len(got) == 859
    for f in (0, 250, 255, 256, 319, 320, 640, 858):
        assert got[(f,)] == pytest.approx(1 - similarity(links[:, f], links[:, f + 40], "pearson"), abs=1e-9)


def test_identical_and_constant_frames(spark):
    same = np.tile(np.arange(6.0)[:, None], (1, 10))
    for method in ("pearson", "spearman", "cosine"):
        assert all(abs(r.speed) < 1e-12 for r in spd.dfc_speed(stream_df(spark, same), 3, method).collect())
    flat = np.ones((6, 10))
    assert all(r.speed == 1 for r in spd.dfc_speed(stream_df(spark, flat), 3).collect())
    assert all(r.speed == 1 for r in spd.dfc_speed(stream_df(spark, np.zeros((6, 10))), 3, "cosine").collect())


def test_tau_split_shares_the_frame_range(spark, links):
    taus = [0, 2, 3]
    stream = stream_df(spark, links)
    got = spd.split_speed(stream, [10], taus, "window")
    pairs = {(r.tau, r.frame1, r.frame2) for r in got.collect()}
    n = 100 - (10 + 3 + 10) - 1
    assert pairs == {(t, f, f + 20 + t) for t in taus for f in range(n)}
    listed = {(r.tau, r.frame1, r.frame2) for r in spd.partner_frames(stream, [10], taus).collect()}
    assert listed == pairs


def test_oversampled_medians(spark):
    rng = np.random.default_rng(6)
    signals = signals_df(spark, {s: rng.normal(size=(60, 4)) for s in range(2)})
    dfc = con.dfc_stream(signals, [6, 8])
    rows = spd.oversampled_speed(dfc, [6, 8], tau=2)
    got = values(spd.oversampled_medians(dfc, [6, 8], tau=2), ["subject", "window_size", "tau"], "median_speed")
    assert len(got) == 2 * 2 * 5
    pool = {}
    for r in rows.collect():
        pool.setdefault((r.subject, r.window_size, r.tau), []).append(r.speed)
    for key, v in pool.items():
        assert len(v) == (60 - key[1] + 1) - key[1] - 2
        assert got[key] == pytest.approx(np.median(v))


def test_errors(spark, links):
    stream = stream_df(spark, links)
    for call in (
        lambda: spd.dfc_speed(stream, 0),
        lambda: spd.dfc_speed(stream, -1),
        lambda: spd.dfc_speed(stream, 1, "invalid"),
        lambda: spd.dfc_speed(stream, 200, check_frames=True),
        lambda: spd.oversampled_speed(stream, [10], tau=10),
    ):
        with pytest.raises(ValueError):
            call()


def test_speeds_of_signals_equal_those_of_their_streams(spark):
    rng = np.random.default_rng(8)
    signals = signals_df(spark, {1: rng.normal(size=(700, 4)), 2: np.round(rng.normal(size=(90, 4))), 3: np.zeros((60, 4))})
    gappy = signals.where("not (subject = 2 and t = 40) and not (subject = 1 and t = 300 and region = 2)")
    for rows in (signals, gappy.where("subject <> 1")):
        for method in ("pearson", "cosine"):
            long = spd.oversampled_speed(con.dfc_stream(rows, [6, 15], 1), [6, 15], 2, method=method)
            key = ["subject", "window_size", "tau", "frame1", "frame2"]
            want = values(long, key, "speed")
            got = values(spd.speed_rows(spd.signal_speeds(rows, [6, 15], 2, method=method)), key, "speed")
            assert got.keys() == want.keys() and len(got) > 300
            assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_sweep_shuffles_samples_not_streams(spark):
    from undula.plans import all_queries

    for name in ("c9_speed_sweep", "d3_pool_by_flat_index", "c8_oversampled_medians"):
        plan = all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "frame#" not in "".join(line for line in plan.splitlines() if "Exchange" in line), name


def test_medians_of_lists(spark, monkeypatch):
    from undula.operators import order_stats

    rng = np.random.default_rng(2)
    lists = [(k % 5, [float(v) for v in np.round(rng.normal(size=rng.integers(0, 40)), 1)]) for k in range(40)]
    df = spark.createDataFrame(lists, "k int, v array<double>")
    want = {(k,): float(np.median(np.concatenate([v for g, v in lists if g == k]))) for k in range(5)}
    for budget in (1 << 18, 150, 1):
        monkeypatch.setattr(order_stats, "LIST_BUDGET", budget)
        assert values(order_stats.medians_of_lists(df, ["k"], "v", "m"), ["k"], "m") == pytest.approx(want)
