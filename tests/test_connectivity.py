import numpy as np
import pytest
from helpers import signals_df, values
from pyspark.sql import functions as F

from undula.operators import connectivity as con


@pytest.fixture(scope="module")
def long_series():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 4)).cumsum(axis=0)
    x[:, 3] = 2.5  # constant channel
    return x


def test_gaps_give_the_same_frames_in_both_plans(spark, long_series):
    """A window that misses a sample is no window, whether samples overlap much or little."""
    signals = signals_df(spark, {1: long_series[:200]}).where("t not in (40, 41, 90)")
    sliding = con._sliding(signals, [12], 1, ["subject"], "pearson", False)
    stepped = con._stepped(signals, 12, 1, ["subject"], "pearson", False)
    a, b = (values(df, ["frame", "i", "j"], "fc") for df in (sliding, stepped))
    assert a.keys() == b.keys() and len({k for k, *_ in a}) == 189 - 13 - 12
    assert all(a[k] == pytest.approx(b[k], abs=1e-7) for k in a)


def test_fc_matches_numpy_and_constant_channel_is_zero(spark, long_series):
    got = values(con.fc_matrix(signals_df(spark, {0: long_series})), ["i", "j"], "fc")
    want = np.corrcoef(long_series[:, :3].T)
    for (i, j), r in got.items():
        assert r == pytest.approx(0.0 if i == 3 else want[i, j], abs=1e-9)
    assert len(got) == 6


def test_full_layout_has_zero_diagonal_and_is_symmetric(spark, long_series):
    full = con.fc_matrix(signals_df(spark, {0: long_series}), layout="full")
    got = values(full, ["i", "j"], "fc")
    assert len(got) == 16 and all(got[k, k] == 0 for k in range(4))
    assert con.is_symmetric(full, ["subject"]).first().symmetric


@pytest.mark.parametrize("window,lag", [(30, 1), (30, 4), (20, 20), (12, 5)])
def test_sliding_windows_cross_block_borders(spark, long_series, window, lag):
    got = values(con.dfc_stream(signals_df(spark, {5: long_series}), window, lag), ["frame", "i", "j"], "fc")
    frames = (len(long_series) - window) // lag + 1
    assert len(got) == frames * 6
    for k in range(0, frames, 7):
        part = long_series[k * lag : k * lag + window, :3]
        want = np.corrcoef(part.T)
        assert got[k, 2, 1] == pytest.approx(want[2, 1], abs=1e-8)
        assert got[k, 3, 0] == 0


def test_several_windows_equal_single_windows(spark, long_series):
    signals = signals_df(spark, {0: long_series[:80]})
    both = con.dfc_stream(signals, [10, 16])
    for size in (10, 16):
        one = values(con.dfc_stream(signals, size), ["frame", "pair_id"], "fc")
        same = values(both.where(F.col("window_size") == size), ["frame", "pair_id"], "fc")
        assert one == pytest.approx(same)


def test_phase_locking_of_signs(spark):
    rng = np.random.default_rng(2)
    x = rng.choice([-1.0, 1.0], size=(50, 3))
    got = values(con.fc_matrix(signals_df(spark, {0: x}), method="plv"), ["i", "j"], "fc")
    for (i, j), v in got.items():
        assert v == pytest.approx(abs(np.mean(x[:, i] * x[:, j]))) and 0 <= v <= 1


def test_three_dimensional_stream_has_unit_diagonal(spark, long_series):
    got = values(con.dfc_stream(signals_df(spark, {0: long_series[:40]}), 10, 10, layout="3D"), ["frame", "i", "j"], "fc")
    assert len(got) == 4 * 16
    assert got[0, 1, 1] == pytest.approx(1.0) and got[0, 3, 3] == 0
    assert got[2, 0, 1] == got[2, 1, 0]


def test_fcd_matches_numpy_with_small_tiles(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    dfc = con.dfc_stream(signals_df(spark, {0: x}), 10, 2)
    links = np.zeros((10, 26))
    for (f, p), v in values(dfc, ["frame", "pair_id"], "fc").items():
        links[p, f] = v
    want = np.corrcoef(links.T)
    got = values(con.fcd(dfc, tile=4), ["f1", "f2"], "r")
    assert len(got) == 26 * 25 // 2
    assert all(r == pytest.approx(want[a, b], abs=1e-9) for (a, b), r in got.items())


def test_pack_and_unpack_round_trip(spark):
    rng = np.random.default_rng(4)
    dfc = con.dfc_stream(signals_df(spark, {0: rng.normal(size=(30, 5))}), 10, 10)
    back = values(con.unpack_links(con.pack_links(dfc, ["frame"]), ["frame"]), ["frame", "i", "j"], "fc")
    for (f, i, j), v in values(dfc, ["frame", "i", "j"], "fc").items():
        assert back[f, i, j] == back[f, j, i] == v
    assert all(back[f, k, k] == 1 for f in range(3) for k in range(5))


def test_bad_arguments(spark, long_series):
    signals = signals_df(spark, {0: long_series[:20]})
    for call in (
        lambda: con.fc_matrix(signals, method="other"),
        lambda: con.fc_matrix(signals, layout="other"),
        lambda: con.dfc_stream(signals, 1),
        lambda: con.dfc_stream(signals, 10, layout="4D"),
    ):
        with pytest.raises(ValueError):
            call()
