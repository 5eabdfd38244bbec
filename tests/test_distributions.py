import numpy as np
import pytest
from helpers import values
from pyspark.sql import functions as F

from undula.functions.tails import beta_lower, gamma_upper
from undula.operators import order_stats as osx, pooling as pool, stats


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", float(v)) for v in np.round(rng.normal(size=900), 2)]
    rows += [("hot", 0.0)] * 450 + [("cold", float(v)) for v in rng.exponential(size=40)] + [("one", -3.5)]
    rows += [("cold", None), ("cold", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    groups = {g: np.array([v for k, v in rows if k == g and v is not None and v == v]) for g in ("hot", "cold", "one")}
    return df, groups


def test_quantiles_match_numpy(sample):
    df, groups = sample
    levels = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    got = values(osx.quantiles(df, ["g"], "v", levels), ["g", "level_idx"], "quantile")
    for g, v in groups.items():
        for k, level in enumerate(levels):
            assert got[g, k] == pytest.approx(np.quantile(v, level), abs=1e-12)
    whole = np.concatenate(list(groups.values()))
    assert osx.medians(df, [], "v", "m").first().m == pytest.approx(np.median(whole))


def test_ranks_and_row_numbers(spark, sample):
    df, groups = sample
    small = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "x double")
    assert sorted(r.r for r in osx.average_rank(small, [], "x", "r").collect()) == [1, 2.5, 2.5, 4]
    cdf = pool.empirical_cdf(df, ["g"], "v").where("g = 'hot'").collect()
    steps = sorted(r.cdf for r in cdf)
    assert steps[-1] == 1 and len(steps) == 1350 and np.allclose(np.diff(steps), 1 / 1350)


def test_mann_whitney_and_kruskal_by_brute_force(sample):
    df, groups = sample
    got = {(r.g1, r.g2): r for r in stats.mann_whitney(df, "g", "v").collect()}
    for (a, b), r in got.items():
        x, y = groups[a], groups[b]
        wins = (x[:, None] > y[None, :]).sum() + 0.5 * (x[:, None] == y[None, :]).sum()
        assert r.u == pytest.approx(wins) and (r.n1, r.n2) == (len(x), len(y)) and 0 <= r.p <= 1
    pooled = np.concatenate([groups[g] for g in groups])
    tie = {v: (pooled < v).sum() + ((pooled == v).sum() + 1) / 2 for v in np.unique(pooled)}
    n = len(pooled)
    h = 12 / (n * (n + 1)) * sum(sum(tie[v] for v in x) ** 2 / len(x) for x in groups.values()) - 3 * (n + 1)
    counts = np.array([(pooled == v).sum() for v in np.unique(pooled)], dtype=float)
    h /= 1 - (counts**3 - counts).sum() / (n**3 - n)
    row = stats.kruskal_wallis(df, "g", "v").first()
    assert row.h == pytest.approx(h) and row.k == 3 and row.n == n


def test_tails_known_values():
    assert gamma_upper(1.0, 3.0) == pytest.approx(np.exp(-3.0))
    assert gamma_upper(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert gamma_upper(2.5, 11.070497693516351 / 2) == pytest.approx(0.05, abs=1e-9)
    # two-sided t tail at the 97.5 % point for 10 degrees of freedom
    t = 2.2281388519649385
    assert beta_lower(5, 0.5, 10 / (10 + t * t)) == pytest.approx(0.05, abs=1e-9)


def test_multiple_comparisons(spark):
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.2,)], "p double")
    out = stats.bonferroni(stats.benjamini_hochberg(p)).withColumn("s", stats.stars("p"))
    got = {r.p: (round(r.p_fdr, 4), round(r.p_bonferroni, 4), r.s) for r in out.collect()}
    assert got == {0.01: (0.04, 0.04, "*"), 0.03: (0.0533, 0.12, "*"), 0.04: (0.0533, 0.16, "*"), 0.2: (0.2, 0.8, "ns")}


@pytest.mark.parametrize("tile", [4, 512])
def test_theil_sen_by_brute_force(spark, tile):
    rng = np.random.default_rng(8)
    rows = []
    for g, n in (("a", 31), ("b", 12)):
        x = np.round(rng.normal(size=n), 1)
        y = np.round(3 * x + rng.normal(size=n), 1)
        rows += [(g, k, float(x[k]), float(y[k])) for k in range(n)]
    got = {r.g: r for r in stats.theil_sen(spark.createDataFrame(rows, "g string, subject long, x double, y double"), "x", "y", ["g"], tile=tile).collect()}
    for g in "ab":
        x = np.array([r[2] for r in rows if r[0] == g])
        y = np.array([r[3] for r in rows if r[0] == g])
        i, j = np.triu_indices(len(x), 1)
        keep = x[i] != x[j]
        slope = np.median((y[j] - y[i])[keep] / (x[j] - x[i])[keep])
        assert got[g].slope == pytest.approx(slope, abs=1e-12)
        assert got[g].intercept == pytest.approx(np.median(y) - slope * np.median(x))


def test_spearman_needs_three_rows(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 5.0), ("b", 2.0, 6.0), ("b", 3.0, 9.0), ("b", 4.0, None)]
    got = {r.g: r for r in stats.spearman(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    assert got["a"].rho is None and got["b"].rho == pytest.approx(1.0) and got["b"].n == 3


def test_bootstrap_band_is_seeded_and_matches_plain_resampling(spark):
    rng = np.random.default_rng(9)
    data = np.round(rng.normal(size=400), 2)
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    levels = [0.1, 0.5, 0.9]
    rows = lambda seed: values(pool.bootstrap_ci(df, [], "v", levels, 800, seed), ["level_idx"], "low")
    assert rows(1) == rows(1) != rows(2)
    plain = np.quantile([np.quantile(rng.choice(data, 400), levels) for _ in range(800)], [0.025, 0.975], axis=0)
    for r in pool.bootstrap_ci(df, [], "v", levels, 800, 1).collect():
        assert r.low == pytest.approx(plain[0][r.level_idx], abs=0.06)
        assert r.high == pytest.approx(plain[1][r.level_idx], abs=0.06)


def test_align_lengths_drops_uncommon(spark):
    df = spark.createDataFrame([(s, "short", float(k)) for s, n in ((1, 3), (2, 2), (3, 2), (4, 3)) for k in range(n)], "subject long, pool string, speed double")
    assert {r.subject for r in pool.align_lengths(df, "drop").collect()} == {1, 4}
    assert pool.align_lengths(df, "pad").count() == 10
    with pytest.raises(ValueError):
        pool.align_lengths(df, "other")


def test_histogram_closes_the_last_edge(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 0.5), ("b", 1.2), ("a", 2.0)], "g string, x double")
    rows = pool.normalized_histograms(df, ["g"], "x", 10, 0.0, 1.0).where(F.col("n") > 0).collect()
    assert {(r.g, r.bin) for r in rows} == {("a", 0), ("a", 9), ("b", 5)}


def test_bootstrap_positions_do_not_multiply_the_values(spark):
    """Values and positions meet by a sort; no value row carries the positions of its cell."""
    from undula.operators.order_stats import order_statistics
    from undula.operators.pooling import bootstrap_ci
    from pyspark.sql import functions as F

    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") % 1000 / 7.0).alias("x"))
    spots = F.array(*[F.struct(F.lit(p).alias("tag"), F.lit(p).cast("long").alias("pos")) for p in (0, 1, 2, 749, 1499)])
    picked = {(r.k, r.tag): r.x for r in order_statistics(rows, ["k"], "x", spots, many=True).collect()}
    for k in (0, 1):
        want = sorted(i % 1000 / 7.0 for i in range(3000) if i % 2 == k)
        assert {p: picked[k, p] for p in (0, 1, 2, 749, 1499)} == {p: want[p] for p in (0, 1, 2, 749, 1499)}
    plan = bootstrap_ci(rows, ["k"], "x", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "_hits" not in plan


def test_slopes_are_counted_without_pairs():
    """Inversions between orders of two tiles are their slopes in a range, weighed; equal x have none."""
    from undula.operators.pairing import _Points

    rng = np.random.default_rng(5)
    for m, n, own in ((40, 25, False), (33, 33, True), (1, 1, False), (1, 1, True)):
        x1, y1, x2, y2 = (np.round(rng.normal(size=k), 1) for k in (m, m, n, n))
        w1, w2 = rng.integers(1, 5, m), rng.integers(1, 5, n)
        if own:
            x2, y2, w2 = x1, y1, w1
        dx, dy, w = x2 - x1[:, None], y2 - y1[:, None], np.multiply.outer(w1, w2)
        keep = (dx != 0) & (np.triu(np.ones(dx.shape, bool), 1) if own else True)
        slope, w = dy[keep] / dx[keep], w[keep]
        both = _Points(own, x1, y1, w1, x2, y2, w2)
        for lo, hi in ((-2.0, 2.0), (-2.0, 0.3), (0.3, 2.0), (-0.4, 0.7), (0.7, 0.71)):
            within = (np.arctan(slope) >= lo) & (np.arctan(slope) < hi)
            assert both.flips(both.order(lo), both.order(hi)) == w[within].sum()
            found = [(s, k) for a, b in both.flipped(both.order(lo), both.order(hi)) for s, k in zip(a, b)]
            assert sorted(found) == sorted(zip(slope[within], w[within]))


def test_theil_sen_of_many_points_forms_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=3000)
    y = 0.4 * x + rng.normal(size=3000)
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "subject long, x double, y double")
    monkeypatch.setattr(stats, "SLOPES_INSIDE", 1000)
    got = stats.theil_sen(rows, "x", "y", tile=700).first()
    i, j = np.triu_indices(3000, 1)
    slope = np.median((y[j] - y[i]) / (x[j] - x[i]))
    assert got.slope == pytest.approx(slope, rel=1e-13) and got.intercept == pytest.approx(np.median(y) - slope * np.median(x))
