"""Window scores from running sums against windows worked out one by one."""

import numpy as np
import pytest
from helpers import signals_df

from undula.operators import connectivity as con, sliding


def plain(x, size, i, j, method):
    out = []
    for a in range(len(x) - size + 1):
        p, q = x[a : a + size, i], x[a : a + size, j]
        if method == "plv":
            out.append(abs(np.where((p < 0) == (q < 0), 1.0, -1.0).mean()))
        else:
            constant = p.min() == p.max() or q.min() == q.max()
            out.append(0.0 if constant else float(np.corrcoef(p, q)[0, 1]))
    return out


def series(n=700, regions=4, seed=3):
    """Steps, constant stretches, a far offset with a tiny spread, zeros."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (700, 4))
    x[100:160, 0] = 7.0
    x[200:260, 1] = 1e6 + rng.normal(0, 1e-3, 60)
    x[300:340, 2] = 0.0
    x[:, 3] = np.round(np.abs(x[:, 3]) * 3) * 1e4
    return x[:n, :regions]


@pytest.mark.parametrize("method", ["pearson", "plv"])
def test_windows_equal_plain_ones(spark, method):
    x = series()
    got = {}
    for r in con.dfc_stream(signals_df(spark, {5: x}), [5, 9, 40], 1, method=method).collect():
        got[r.window_size, r.i, r.j, r.frame] = r.fc
    assert len(got) == sum(700 - w + 1 for w in (5, 9, 40)) * 6
    for w in (5, 9, 40):
        for i in range(4):
            for j in range(i):
                want = plain(x, w, i, j, method)
                assert [got[w, i, j, f] for f in range(len(want))] == pytest.approx(want, abs=1e-6 if method == "pearson" and 1 in (i, j) else 1e-9)


def test_constant_windows_are_zero_exactly(spark):
    x = series()
    rows = con.dfc_stream(signals_df(spark, {0: x}), 20, 1).where("j = 0 and frame between 100 and 140").collect()
    assert len(rows) == 41 * 3 and all(r.fc == 0.0 for r in rows)


def test_all_samples_in_one_piece_or_many(spark, monkeypatch):
    signals = signals_df(spark, {1: series(300), 2: series(90, seed=8)})
    want = sorted(con.dfc_stream(signals, [6, 30], 1, layout="3D").collect())
    monkeypatch.setattr(sliding, "ROWS", 50)
    assert sorted(con.dfc_stream(signals, [6, 30], 1, layout="3D").collect()) == want


def test_gaps_and_nulls(spark):
    x = series(60, 3)
    rows = [(0, t, r, None if (t, r) == (30, 1) else float(x[t, r])) for t in range(60) for r in range(3) if t != 45]
    signals = spark.createDataFrame(rows, "subject long, t int, region int, value double")
    got = {(r.i, r.j, r.frame): r.fc for r in con.dfc_stream(signals, 10, 1).collect()}
    frames = {f for _, _, f in got}
    assert frames == set(range(36)) | set(range(46, 51))
    keep = [t for t in range(25, 35) if t != 30]
    p, q = x[keep, 1], x[25:35, 0]
    cov = ((p - p.mean()) * (x[keep, 0] - x[keep, 0].mean())).sum() / (len(keep) - 1)
    assert got[1, 0, 25] == pytest.approx(cov / p.std(ddof=1) / q.std(ddof=1))


def test_lag_and_empty(spark):
    signals = signals_df(spark, {0: series(50, 2)})
    frames = sorted(r.frame for r in con.dfc_stream(signals, 12, 2).collect())
    assert frames == list(range(20))
    assert con.dfc_stream(signals.limit(0), 12, 1).count() == 0


def test_series_of_links_hold_the_scores_of_the_stream(spark):
    signals = signals_df(spark, {1: series(600), 2: series(90, seed=8), 4: series(20, 2)})
    want = {}
    for r in sorted(con.dfc_stream(signals, [6, 30], 1).collect(), key=lambda r: r.frame):
        want.setdefault((r.subject, r.window_size, r.i, r.j), []).append(r.fc)
    got = {}
    for r in con.link_series(signals, [6, 30]).collect():
        got.setdefault((r.subject, r.window_size, r.i, r.j), []).extend(r.fc)
    assert got.keys() == want.keys()
    assert all(sorted(got[k]) == pytest.approx(sorted(want[k]), abs=1e-12) for k in want)
