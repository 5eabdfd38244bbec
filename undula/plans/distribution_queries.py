"""Queries for pooling and distributions (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from undula.functions.similarity import rounded
from undula.operators import pooling as pool, speed as spd
from undula.operators.order_stats import quantiles
from undula.plans import fragments as q
from undula.plans.catalog import query
from undula.plans.network_queries import BASE, COMMUNITY_PAIRS, REGION_COMMUNITY, region_community
from undula.operators import connectivity as con
from undula.sources import tables as src

WINDOWS = [6, 9, 12]
TAUS = [0, 1]


def packed_speeds(spark, sf_dir):
    return spd.signal_speeds(src.signals(spark, sf_dir), WINDOWS, tau=1, min_tau_zero=True)


def speeds(spark, sf_dir):
    return spd.speed_rows(packed_speeds(spark, sf_dir))


def speeds_sql(source: dict[int, str] | None = None, name: str = "speed") -> list[str]:
    parts = []
    for w in WINDOWS:
        src_name = (source or {}).get(w, f"d{w}")
        parts.append(q.speed([(t, w + t) for t in TAUS], str(w + 1), source=src_name, name=f"{name}{w}"))
    return [*parts, q.union_all(name, *[f"{name}{w}" for w in WINDOWS])]


SPEEDS = (*BASE, *[q.dfc(w, name=f"d{w}") for w in WINDOWS], *speeds_sql())
POOLED = "pooled AS (SELECT *, CASE window_size WHEN 6 THEN 'short' WHEN 9 THEN 'mid' ELSE 'long' END AS pool FROM speed)"
HALVES = "pooled AS (SELECT *, CASE window_size WHEN 6 THEN 'short' ELSE 'long' END AS pool FROM speed)"
MEMBERS = "members AS (SELECT subject, genotype AS label FROM cohort)"
GROUPED = (*SPEEDS, q.COHORT, MEMBERS, "grouped AS (SELECT pooled.*, label FROM pooled JOIN members USING (subject))")


def grouped_ctes(pooling=POOLED):
    return q.ctes(*SPEEDS, pooling, q.COHORT, MEMBERS, "grouped AS (SELECT pooled.*, label FROM pooled JOIN members USING (subject))")


def members(spark, sf_dir):
    return src.cohort(spark, sf_dir).select("subject", F.col("genotype").alias("label"))


def pooled(spark, sf_dir):
    return pool.pool_by_limits(speeds(spark, sf_dir), WINDOWS, (1, 2))


def grouped(spark, sf_dir):
    return pool.by_population(pooled(spark, sf_dir), members(spark, sf_dir))


def summed(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("speed"), 5).alias("mean_speed"))


SUMMED = f"count(*) AS n, {q.rnd('avg(speed)', 5)} AS mean_speed"


@query("d1_pool_by_limits", q.ctes(*SPEEDS, POOLED) + f"SELECT subject, pool, {SUMMED} FROM pooled GROUP BY subject, pool")
def pool_by_limits(spark, sf_dir):
    return summed(pooled(spark, sf_dir), "subject", "pool")


PRICES_POOLED = """op AS (SELECT subject, value, CASE WHEN t < 24 THEN 'short' WHEN t < 48 THEN 'mid' ELSE 'long' END AS pool FROM obs),
len AS (SELECT pool, subject, count(*) AS n FROM op GROUP BY ALL),
tally AS (SELECT pool, n, count(*) AS c, min(subject) AS f FROM len GROUP BY ALL),
modal AS (SELECT pool, n FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY c DESC, f) AS rn FROM tally) WHERE rn = 1)"""


@query(
    "d2_drop_uncommon_lengths",
    q.ctes(q.OBSERVED, PRICES_POOLED)
    + f"""SELECT pool, subject, count(*) AS n, {q.rnd('sum(value)', 2)} AS total
FROM op JOIN len l USING (pool, subject) JOIN modal m ON m.pool = op.pool AND m.n = l.n GROUP BY pool, subject"""
    .replace("SELECT pool, subject", "SELECT op.pool, op.subject").replace("GROUP BY pool, subject", "GROUP BY op.pool, op.subject"),
)
def drop_uncommon_lengths(spark, sf_dir):
    which = F.when(F.col("t") < 24, "short").when(F.col("t") < 48, "mid").otherwise("long")
    kept = pool.align_lengths(src.shipped_prices(spark, sf_dir).withColumn("pool", which), "drop")
    return kept.groupBy("pool", "subject").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 2).alias("total"))


FLAT_WINDOWS, FLAT_TAUS = list(range(4, 25)), [0, 1, 2]
FLAT = (
    *BASE,
    *[q.dfc(w, name=f"d{w}") for w in FLAT_WINDOWS],
    *[q.speed([(t, w + t) for t in FLAT_TAUS], str(w + 2), source=f"d{w}", name=f"s{w}") for w in FLAT_WINDOWS],
    q.union_all("speed", *[f"s{w}" for w in FLAT_WINDOWS]),
    q.COHORT,
)


@query(
    "d3_pool_by_flat_index",
    q.ctes(*FLAT)
    + f"""SELECT pool, flat_index, {SUMMED} FROM (
 SELECT *, CASE WHEN flat_index <= 9 THEN 'short' WHEN flat_index <= 30 THEN 'mid' ELSE 'long' END AS pool
 FROM (SELECT s.*, (window_size - 4) * 3 + tau AS flat_index FROM speed s JOIN cohort c USING (subject) WHERE treatment = 'treated') WHERE flat_index <= 60)
GROUP BY pool, flat_index""",
)
def pool_by_flat_index(spark, sf_dir):
    treated = src.cohort(spark, sf_dir).where("treatment = 'treated'").select("subject")
    signals = src.signals(spark, sf_dir).join(treated, "subject")
    speeds_ = spd.speed_rows(spd.signal_speeds(signals, FLAT_WINDOWS, tau=2, min_tau_zero=True))
    return summed(pool.pool_by_flat_index(speeds_, FLAT_WINDOWS, FLAT_TAUS), "pool", "flat_index")


@query("d4_population_pooling", grouped_ctes() + f"SELECT label, pool, {SUMMED} FROM grouped GROUP BY label, pool")
def population_pooling(spark, sf_dir):
    return summed(grouped(spark, sf_dir), "label", "pool")


@query(
    "d5_two_timescale_pooling",
    q.ctes(*SPEEDS, HALVES)
    + f"SELECT subject, pool, {SUMMED} FROM (SELECT * FROM pooled UNION ALL SELECT * REPLACE ('all' AS pool) FROM pooled) GROUP BY subject, pool",
)
def two_timescale_pooling(spark, sf_dir):
    return summed(pool.pool_by_halves(speeds(spark, sf_dir), WINDOWS, with_all=True), "subject", "pool")


COMMUNITY_SPEEDS = (
    *BASE,
    REGION_COMMUNITY,
    COMMUNITY_PAIRS,
    *[q.dfc(w, name=f"c{w}", pairs="cpr") for w in WINDOWS],
    *[f"{n}{w} AS (SELECT * FROM c{w} WHERE i % 2 = {k})" for k, n in enumerate("eo") for w in WINDOWS],
    *speeds_sql({w: f"e{w}" for w in WINDOWS}, "se"),
    *speeds_sql({w: f"o{w}" for w in WINDOWS}, "so"),
    "speed AS (SELECT 0 AS community, * FROM se UNION ALL SELECT 1, * FROM so)",
)


@query(
    "d6_community_speed_pools",
    q.ctes(*COMMUNITY_SPEEDS, HALVES, q.COHORT, MEMBERS)
    + f"""SELECT community, label, pool, {SUMMED}
FROM (SELECT * FROM pooled UNION ALL SELECT * REPLACE ('all' AS pool) FROM pooled) JOIN members USING (subject) GROUP BY community, label, pool""",
)
def community_speed_pools(spark, sf_dir):
    signals = src.signals(spark, sf_dir)
    dfc = con.community_dfc(signals, region_community(signals), WINDOWS, 1)
    by_community = spd.oversampled_speed(dfc, WINDOWS, 1, True, keys=("subject", "community"))
    halves = pool.pool_by_halves(by_community, WINDOWS, with_all=True)
    return summed(pool.by_population(halves, members(spark, sf_dir)), "community", "label", "pool")


@query("d7_subject_median_speed", q.ctes(*SPEEDS) + f"SELECT subject, {q.rnd('median(speed)', 5)} AS median_speed FROM speed GROUP BY subject")
def subject_median_speed(spark, sf_dir):
    return pool.subject_medians(packed_speeds(spark, sf_dir)).withColumn("median_speed", rounded("median_speed", 5))


PRICES = "prices AS (SELECT l_returnflag AS label, CASE WHEN l_quantity <= 25 THEN 'short' ELSE 'long' END AS pool, l_extendedprice AS x FROM lineitem)"


def prices(spark, sf_dir):
    which = F.when(F.col("l_quantity") <= 25, "short").otherwise("long")
    return src.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), which.alias("pool"), F.col("l_extendedprice").alias("x"))


@query(
    "d8_normalized_histograms",
    q.ctes(
        PRICES,
        "f AS (SELECT label, CAST(least(floor((x - 0) / 400.0), 249) AS INTEGER) AS bin, count(*) AS n FROM prices WHERE x >= 0 AND x <= 100000 GROUP BY ALL)",
        "g AS (SELECT label, unnest(range(250)) AS bin FROM (SELECT DISTINCT label FROM prices))",
        "c AS (SELECT g.label, g.bin, coalesce(f.n, 0) AS n FROM g LEFT JOIN f ON f.label = g.label AND f.bin = g.bin)",
    )
    + f"SELECT label, bin, {q.rnd('(bin + 0.5) * 400.0', 4)} AS center, n, {q.rnd('n / (SELECT max(n) FROM c)::DOUBLE', 6)} AS normalized FROM c",
)
def normalized_histograms(spark, sf_dir):
    out = pool.normalized_histograms(prices(spark, sf_dir), ["label"], "x", 250, 0.0, 100000.0)
    return out.withColumn("center", rounded("center", 4)).withColumn("normalized", rounded("normalized", 6))


@query(
    "d9_density_histogram",
    q.ctes(
        PRICES,
        "e AS (SELECT label, min(x) AS lo, max(x) AS hi, count(*) AS n FROM prices GROUP BY label)",
        "f AS (SELECT label, CAST(least(floor((x - lo) / ((hi - lo) / 150)), 149) AS INTEGER) AS bin, count(*) AS c FROM prices JOIN e USING (label) GROUP BY ALL)",
        "g AS (SELECT *, unnest(range(150)) AS bin FROM e)",
    )
    + f"SELECT g.label, g.bin, {q.rnd('coalesce(c, 0) / (n * ((hi - lo) / 150)) * 1000000', 5)} AS density FROM g LEFT JOIN f ON f.label = g.label AND f.bin = g.bin",
)
def density_histogram(spark, sf_dir):
    out = pool.density_histogram(prices(spark, sf_dir), ["label"], "x", 150)
    return out.withColumn("density", rounded(F.col("density") * 1000000, 5))


@query(
    "d10_empirical_cdf",
    q.ctes(PRICES)
    + f"""SELECT label, pool, x, {q.rnd('row_number() OVER (PARTITION BY label, pool ORDER BY x) / (count(*) OVER (PARTITION BY label, pool))::DOUBLE', 8)} AS cdf FROM prices""",
)
def empirical_cdf(spark, sf_dir):
    return pool.empirical_cdf(prices(spark, sf_dir), ["label", "pool"], "x").withColumn("cdf", rounded("cdf", 8))


PERCENTS = pool.level_grid(0.01, 0.99, 99)
LEVELS_SQL = "[" + ", ".join(repr(v) for v in PERCENTS) + "]"


def quantile_sql(source, keys, levels, value):
    lit = "[" + ", ".join(repr(v) for v in levels) + "]"
    return f"""qt AS (SELECT {keys}, unnest(range({len(levels)})) AS level_idx, unnest({lit}) AS level, unnest(quantile_cont({value}, {lit})) AS quantile FROM {source} GROUP BY {keys})"""


def price_quantiles(spark, sf_dir):
    return quantiles(prices(spark, sf_dir), ["label", "pool"], "x", PERCENTS)


@query(
    "d11_group_quantiles",
    q.ctes(PRICES, quantile_sql("prices", "label, pool", PERCENTS, "x")) + f"SELECT label, pool, level_idx, {q.rnd('level')} AS level, {q.rnd('quantile', 4)} AS quantile FROM qt",
)
def group_quantiles(spark, sf_dir):
    return price_quantiles(spark, sf_dir).withColumn("quantile", rounded("quantile", 4)).withColumn("level", rounded("level"))


@query(
    "d11_speed_quantiles",
    grouped_ctes().rstrip() + ",\n" + quantile_sql("grouped", "label, pool", PERCENTS, "speed") + f" SELECT label, pool, level_idx, {q.rnd('quantile', 4)} AS quantile FROM qt",
)
def speed_quantiles(spark, sf_dir):
    out = quantiles(grouped(spark, sf_dir), ["label", "pool"], "speed", PERCENTS)
    return out.select("label", "pool", "level_idx", rounded("quantile", 4).alias("quantile"))


@query(
    "d12_quantile_difference",
    q.ctes(PRICES, quantile_sql("prices", "label, pool", PERCENTS, "x"))
    + f"""SELECT * FROM (SELECT label, pool, level_idx, {q.rnd('quantile - lag(quantile) OVER (PARTITION BY pool, level_idx ORDER BY label)', 4)} AS diff FROM qt) WHERE diff IS NOT NULL""",
)
def quantile_difference(spark, sf_dir):
    out = pool.quantile_difference(price_quantiles(spark, sf_dir))
    return out.select("label", "pool", "level_idx", rounded("diff", 4).alias("diff"))


@query(
    "d13_quantile_slope_difference",
    q.ctes(
        PRICES,
        quantile_sql("prices", "label, pool", PERCENTS, "x"),
        "sl AS (SELECT *, quantile - lag(quantile) OVER (PARTITION BY pool, label ORDER BY level_idx) AS slope FROM qt)",
    )
    + f"""SELECT * FROM (SELECT label, pool, level_idx, {q.rnd('slope - lag(slope) OVER (PARTITION BY pool, level_idx ORDER BY label)', 4)} AS slope_diff FROM sl WHERE slope IS NOT NULL) WHERE slope_diff IS NOT NULL""",
)
def quantile_slope_difference(spark, sf_dir):
    out = pool.quantile_slope_difference(price_quantiles(spark, sf_dir))
    return out.select("label", "pool", "level_idx", rounded("slope_diff", 4).alias("slope_diff"))


POINTS = pool.level_grid(0.0, 1.0, 1000)


@query(
    "d14_quantile_pairs",
    q.ctes(PRICES, quantile_sql("prices", "label", POINTS, "x"))
    + f"""SELECT a.level_idx, a.label AS g1, b.label AS g2, {q.rnd('a.quantile', 4)} AS q1, {q.rnd('b.quantile', 4)} AS q2, {q.rnd('b.quantile - a.quantile', 4)} AS diff
FROM qt a JOIN qt b ON a.level_idx = b.level_idx AND a.label < b.label""",
)
def quantile_pairs(spark, sf_dir):
    out = pool.quantile_pairs(quantiles(prices(spark, sf_dir), ["label"], "x", POINTS)).drop("side")
    for c in ("q1", "q2", "diff"):
        out = out.withColumn(c, rounded(c, 4))
    return out


TWENTIETHS = pool.level_grid(0.05, 0.95, 19)


@query(
    "d15_quantile_matrix",
    grouped_ctes().rstrip() + ",\n" + quantile_sql("(SELECT * FROM grouped WHERE speed > 0)", "label, window_size", TWENTIETHS, "speed")
    + f" SELECT label, window_size, level_idx, {q.rnd('ln(quantile)', 4)} AS quantile FROM qt",
)
def quantile_matrix(spark, sf_dir):
    out = pool.quantile_matrix(grouped(spark, sf_dir), TWENTIETHS, positive_only=True, log=True)
    return out.select("label", "window_size", "level_idx", rounded("quantile", 4).alias("quantile"))


@query(
    "d16_quantile_matrix_difference",
    grouped_ctes().rstrip() + ",\n" + quantile_sql("grouped", "label, window_size", TWENTIETHS, "speed")
    + f""" SELECT a.window_size, a.level_idx, a.label AS g1, b.label AS g2, {q.rnd('b.quantile - a.quantile', 4)} AS diff
FROM qt a JOIN qt b ON a.level_idx = b.level_idx AND a.window_size = b.window_size AND a.label < b.label""",
)
def quantile_matrix_difference(spark, sf_dir):
    table = pool.quantile_matrix(grouped(spark, sf_dir), TWENTIETHS)
    out = pool.quantile_pairs(table, keys=("window_size",))
    return out.select("window_size", "level_idx", "g1", "g2", rounded("diff", 4).alias("diff"))


@query(
    "d17_median_iqr_by_window",
    grouped_ctes()
    + f"""SELECT label, window_size, {q.rnd('quantile_cont(speed, 0.05)', 4)} AS q05, {q.rnd('quantile_cont(speed, 0.25)', 4)} AS q25, {q.rnd('quantile_cont(speed, 0.5)', 4)} AS q50,
 {q.rnd('quantile_cont(speed, 0.75)', 4)} AS q75, {q.rnd('quantile_cont(speed, 0.95)', 4)} AS q95 FROM grouped GROUP BY label, window_size""",
)
def median_iqr_by_window(spark, sf_dir):
    rows = quantiles(grouped(spark, sf_dir), ["label", "window_size"], "speed", [0.05, 0.25, 0.5, 0.75, 0.95])
    names = ("q05", "q25", "q50", "q75", "q95")
    return rows.groupBy("label", "window_size").agg(
        *[rounded(F.max(F.when(F.col("level_idx") == k, F.col("quantile"))), 4).alias(n) for k, n in enumerate(names)]
    )


@query("d18_bootstrap_quantile_band")
def bootstrap_quantile_band(spark, sf_dir):
    return pool.bootstrap_ci(prices(spark, sf_dir), ["label", "pool"], "x", PERCENTS, seed=42)
