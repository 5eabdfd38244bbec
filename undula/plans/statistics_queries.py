"""Queries for group statistics (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from undula.functions.similarity import rounded
from undula.operators import community as com, pooling as pool, stats
from undula.plans import fragments as q
from undula.plans.catalog import query
from undula.plans.distribution_queries import SPEEDS, WINDOWS, packed_speeds, prices, PRICES, HALVES
from undula.sources import tables as src

MWU_SQL = """
p AS (SELECT a.label AS g1, b.label AS g2 FROM (SELECT DISTINCT label FROM prices) a, (SELECT DISTINCT label FROM prices) b WHERE a.label < b.label),
r AS (SELECT g1, g2, label, x, rank() OVER (PARTITION BY g1, g2 ORDER BY x) + (count(*) OVER (PARTITION BY g1, g2, x) - 1) / 2.0 AS rk
      FROM p JOIN prices ON label = g1 OR label = g2),
tie AS (SELECT g1, g2, sum(c * c * c - c) AS ties FROM (SELECT g1, g2, x, count(*)::DOUBLE AS c FROM r GROUP BY ALL) GROUP BY ALL),
u AS (SELECT g1, g2, count(*) FILTER (label = g1) AS n1, count(*) FILTER (label = g2) AS n2,
        sum(rk) FILTER (label = g1) - (count(*) FILTER (label = g1))::DOUBLE * (count(*) FILTER (label = g1) + 1) / 2 AS u FROM r GROUP BY ALL)
SELECT u.g1, u.g2, n1, n2, u, round((abs(u - n1::DOUBLE * n2 / 2) - 0.5) /
  sqrt(n1::DOUBLE * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))), 5) + 0.0 AS z
FROM u JOIN tie ON u.g1 = tie.g1 AND u.g2 = tie.g2"""


@query("e1_mann_whitney", q.ctes(PRICES + "," + MWU_SQL.split("\nSELECT u.g1")[0]) + "SELECT u.g1" + MWU_SQL.split("\nSELECT u.g1")[1])
def mann_whitney(spark, sf_dir):
    return stats.mann_whitney(prices(spark, sf_dir), "label", "x", p_values=False).withColumn("z", rounded("z", 5))


MWU_BY_POOL = f"""p AS (SELECT a.pool, a.label AS g1, b.label AS g2 FROM (SELECT DISTINCT pool, label FROM prices) a JOIN (SELECT DISTINCT pool, label FROM prices) b ON a.pool = b.pool AND a.label < b.label),
r AS (SELECT p.pool, g1, g2, label, x, rank() OVER (PARTITION BY p.pool, g1, g2 ORDER BY x) + (count(*) OVER (PARTITION BY p.pool, g1, g2, x) - 1) / 2.0 AS rk
      FROM p JOIN prices s ON s.pool = p.pool AND (label = g1 OR label = g2)),
tie AS (SELECT pool, g1, g2, sum(c * c * c - c) AS ties FROM (SELECT pool, g1, g2, x, count(*)::DOUBLE AS c FROM r GROUP BY ALL) GROUP BY ALL),
u AS (SELECT pool, g1, g2, count(*) FILTER (label = g1) AS n1, count(*) FILTER (label = g2) AS n2,
        sum(rk) FILTER (label = g1) - (count(*) FILTER (label = g1))::DOUBLE * (count(*) FILTER (label = g1) + 1) / 2 AS u FROM r GROUP BY ALL),
zz AS (SELECT u.*, (abs(u - n1::DOUBLE * n2 / 2) - 0.5) / sqrt(n1::DOUBLE * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS z FROM u JOIN tie USING (pool, g1, g2)),
pv AS (SELECT *, {q.normal_p('z')} AS p FROM zz),
k AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY p) AS k, count(*) OVER (PARTITION BY pool) AS m FROM pv),
adj AS (SELECT *, least(1.0, min(p * m / k) OVER (PARTITION BY pool ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS p_fdr, least(1.0, p * m) AS p_bonferroni FROM k)"""


@query(
    "e1_mann_whitney_p_values",
    q.ctes(PRICES, MWU_BY_POOL)
    + f"""SELECT pool, g1, g2, n1, n2, u, {q.rnd('z', 5)} AS z, {q.rnd('p')} AS p, {q.rnd('p_fdr')} AS p_fdr, {q.rnd('p_bonferroni')} AS p_bonferroni,
 CASE WHEN p_fdr < 0.001 THEN '***' WHEN p_fdr < 0.01 THEN '**' WHEN p_fdr < 0.05 THEN '*' ELSE 'ns' END AS stars FROM adj""",
)
def mann_whitney_p_values(spark, sf_dir):
    tests = stats.mann_whitney(prices(spark, sf_dir), "label", "x", keys=["pool"])
    adjusted = stats.bonferroni(stats.benjamini_hochberg(tests, keys=["pool"]), keys=["pool"])
    out = adjusted.withColumn("stars", stats.stars("p_fdr")).withColumn("z", rounded("z", 5))
    for c in ("p", "p_fdr", "p_bonferroni"):
        out = out.withColumn(c, rounded(c))
    return out


KW_SQL = """
r AS (SELECT pool, label, x, rank() OVER (PARTITION BY pool ORDER BY x) + (count(*) OVER (PARTITION BY pool, x) - 1) / 2.0 AS rk FROM prices),
tie AS (SELECT pool, sum(c * c * c - c) AS ties FROM (SELECT pool, x, count(*)::DOUBLE AS c FROM r GROUP BY ALL) GROUP BY ALL),
g AS (SELECT pool, label, sum(rk) AS s, count(*)::DOUBLE AS n FROM r GROUP BY ALL)"""


@query(
    "e2_kruskal_wallis",
    q.ctes(PRICES + "," + KW_SQL)
    + """SELECT pool, CAST(sum(n) AS BIGINT) AS n, count(*) AS k, round((12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) /
  (1 - any_value(ties) / (sum(n) * sum(n) * sum(n) - sum(n))), 4) + 0.0 AS h FROM g JOIN tie USING (pool) GROUP BY pool""",
)
def kruskal_wallis(spark, sf_dir):
    return stats.kruskal_wallis(prices(spark, sf_dir), "label", "x", ["pool"], p_values=False).withColumn("h", rounded("h", 4))


@query(
    "e2_kruskal_wallis_p_value",
    q.ctes(
        PRICES + "," + KW_SQL,
        """hh AS (SELECT pool, sum(n)::BIGINT AS n, count(*) AS k, (12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) /
  (1 - any_value(ties) / (sum(n) * sum(n) * sum(n) - sum(n))) AS h FROM g JOIN tie USING (pool) GROUP BY pool)""",
    )
    + f"SELECT pool, n, k, {q.rnd('h', 4)} AS h, {q.rnd(q.chi2_p('h', '(k - 1)'), 5)} AS p FROM hh",
)
def kruskal_wallis_p_value(spark, sf_dir):
    out = stats.kruskal_wallis(prices(spark, sf_dir), "label", "x", ["pool"])
    return out.withColumn("h", rounded("h", 4)).withColumn("p", rounded("p", 5))


TESTS = """tests AS (SELECT c_nationkey AS test, c_mktsegment AS family, round(avg(CASE WHEN c_acctbal < -500 THEN 1.0 ELSE 0.0 END), 6) AS p FROM customer GROUP BY ALL)"""


def tests(spark, sf_dir):
    share = F.avg(F.when(F.col("c_acctbal") < -500, 1.0).otherwise(0.0))
    customer = src.table(spark, sf_dir, "customer")
    return customer.groupBy(F.col("c_nationkey").alias("test"), F.col("c_mktsegment").alias("family")).agg(F.round(share, 6).alias("p"))


@query(
    "e3_benjamini_hochberg",
    q.ctes(TESTS, "r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS k, count(*) OVER (PARTITION BY family) AS m FROM tests)")
    + f"""SELECT test, family, p, {q.rnd('least(1.0, min(p * m / k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING))', 6)} AS p_fdr FROM r""",
)
def benjamini_hochberg(spark, sf_dir):
    return stats.benjamini_hochberg(tests(spark, sf_dir), keys=["family"]).withColumn("p_fdr", rounded("p_fdr"))


@query("e4_bonferroni", q.ctes(TESTS) + f"SELECT test, family, p, {q.rnd('least(1.0, p * count(*) OVER (PARTITION BY family))')} AS p_bonferroni FROM tests")
def bonferroni(spark, sf_dir):
    return stats.bonferroni(tests(spark, sf_dir), keys=["family"]).withColumn("p_bonferroni", rounded("p_bonferroni"))


@query(
    "e5_significance_stars",
    q.ctes(TESTS) + "SELECT test, family, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM tests",
)
def significance_stars(spark, sf_dir):
    return tests(spark, sf_dir).select("test", "family", stats.stars("p").alias("stars"))


SUBJECTS = "sm AS (SELECT subject, genotype, score, median(speed) AS ms FROM speed JOIN cohort USING (subject) GROUP BY ALL)"
BY_WINDOW = "sw AS (SELECT subject, genotype, window_size, score, median(speed) AS ms FROM speed JOIN cohort USING (subject) GROUP BY ALL)"


def spearman_sql(source, keys):
    cols = ", ".join(keys)
    part = f"PARTITION BY {cols}" if keys else ""
    comma = ", " if keys else ""
    group = f"GROUP BY {cols}" if keys else ""
    return f"""r AS (SELECT {cols}{comma}rank() OVER ({part} ORDER BY ms) + (count(*) OVER (PARTITION BY {cols}{comma}ms) - 1) / 2.0 AS rx,
  rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {cols}{comma}score) - 1) / 2.0 AS ry FROM {source})
SELECT {cols}{comma}count(*) AS n, {q.rnd(f"CASE WHEN count(*) > 2 THEN {q.corr('rx', 'ry')} END", 5)} AS rho FROM r {group}"""


def subject_scores(spark, sf_dir, keys=("subject",)):
    med = pool.subject_medians(packed_speeds(spark, sf_dir), keys)
    return med.join(src.cohort(spark, sf_dir).select("subject", "genotype", "score"), "subject")


@query("e6_spearman_overall", q.ctes(*SPEEDS, q.COHORT, SUBJECTS).rstrip() + ",\n" + spearman_sql("sm", []))
def spearman_overall(spark, sf_dir):
    return stats.spearman(subject_scores(spark, sf_dir), "median_speed", "score", p_values=False).withColumn("rho", rounded("rho", 5))


@query("e6_spearman_by_group", q.ctes(*SPEEDS, q.COHORT, SUBJECTS).rstrip() + ",\n" + spearman_sql("sm", ["genotype"]))
def spearman_by_group(spark, sf_dir):
    out = stats.spearman(subject_scores(spark, sf_dir), "median_speed", "score", ["genotype"], p_values=False)
    return out.withColumn("rho", rounded("rho", 5))


@query("e7_spearman_by_group_and_window", q.ctes(*SPEEDS, q.COHORT, BY_WINDOW).rstrip() + ",\n" + spearman_sql("sw", ["genotype", "window_size"]))
def spearman_by_group_and_window(spark, sf_dir):
    scores = subject_scores(spark, sf_dir, ("subject", "window_size"))
    out = stats.spearman(scores, "median_speed", "score", ["genotype", "window_size"], p_values=False)
    return out.withColumn("rho", rounded("rho", 5))


def spearman_p_sql(source, keys):
    cols = ", ".join(keys)
    head, rho = spearman_sql(source, keys).split("SELECT " + cols + ", count(*)")
    plain = f"CASE WHEN count(*) > 2 THEN {q.corr('rx', 'ry')} END"
    return (
        head.rstrip() + f",\nrr AS (SELECT {cols}, count(*) AS n, {plain} AS rho FROM r GROUP BY {cols}),\npp AS (SELECT *, {q.correlation_p('rho', 'n')} AS p FROM rr)\n"
        + f"SELECT {cols}, n, {q.rnd('rho', 5)} AS rho, {q.rnd('p', 4)} AS p, p < 0.05 AS significant FROM pp"
    )


def with_p(df):
    return df.withColumn("rho", rounded("rho", 5)).withColumn("p", rounded("p", 4))


@query("e6_spearman_p_values", q.ctes(*SPEEDS, q.COHORT, SUBJECTS).rstrip() + ",\n" + spearman_p_sql("sm", ["genotype"]))
def spearman_by_group_p_values(spark, sf_dir):
    return with_p(stats.spearman(subject_scores(spark, sf_dir), "median_speed", "score", ["genotype"]))


@query("e7_spearman_p_values", q.ctes(*SPEEDS, q.COHORT, BY_WINDOW).rstrip() + ",\n" + spearman_p_sql("sw", ["genotype", "window_size"]))
def spearman_p_values(spark, sf_dir):
    scores = subject_scores(spark, sf_dir, ("subject", "window_size"))
    return with_p(stats.spearman(scores, "median_speed", "score", ["genotype", "window_size"]))


THEIL = """tb AS (SELECT c_custkey AS subject, n_regionkey AS label, c_acctbal AS y, n AS x
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT o_custkey, avg(o_totalprice) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


def balances(spark, sf_dir):
    spent = src.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("x"))
    nation = src.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("label"))
    return (
        src.table(spark, sf_dir, "customer")
        .join(spent, "c_custkey")
        .join(nation, "c_nationkey")
        .select(F.col("c_custkey").alias("subject"), "label", "x", F.col("c_acctbal").alias("y"))
    )


@query(
    "e8_theil_sen",
    q.ctes(
        THEIL,
        "s AS (SELECT a.label, median((b.y - a.y) / (b.x - a.x)) AS slope FROM tb a JOIN tb b ON a.label = b.label AND b.x > a.x GROUP BY a.label)",
        "m AS (SELECT label, median(x) AS mx, median(y) AS my FROM tb GROUP BY label)",
    )
    + f"SELECT label, {q.rnd('slope', 7)} AS slope, {q.rnd('my - slope * mx', 3)} AS intercept FROM s JOIN m USING (label)",
)
def theil_sen(spark, sf_dir):
    out = stats.theil_sen(balances(spark, sf_dir), "x", "y", ["label"])
    return out.withColumn("slope", rounded("slope", 7)).withColumn("intercept", rounded("intercept", 3))


@query(
    "e9_ols_by_group_and_pool",
    q.ctes(
        *SPEEDS,
        q.COHORT,
        HALVES,
        "sp AS (SELECT genotype, pool, subject, score, median(speed) AS ms FROM pooled JOIN cohort USING (subject) GROUP BY ALL)",
    )
    + f"""SELECT genotype, pool, count(*) AS n, {q.rnd('CASE WHEN count(*) > 3 THEN regr_slope(score, ms) END', 3)} AS coef,
 {q.rnd('CASE WHEN count(*) > 3 THEN regr_intercept(score, ms) END', 3)} AS intercept FROM sp GROUP BY genotype, pool""",
)
def ols_by_group_and_pool(spark, sf_dir):
    return regression(spark, sf_dir, False).drop("t")


def regression(spark, sf_dir, p_values):
    halves = pool.pool_by_halves(packed_speeds(spark, sf_dir), WINDOWS)
    med = pool.subject_medians(halves, ("subject", "pool"))
    scored = med.join(src.cohort(spark, sf_dir).select("subject", "genotype", "score"), "subject")
    out = stats.ols(scored, "median_speed", "score", ["genotype", "pool"], p_values)
    return out.withColumn("coef", rounded("coef", 3)).withColumn("intercept", rounded("intercept", 3))


@query(
    "e9_ols_p_values",
    q.ctes(
        *SPEEDS,
        q.COHORT,
        HALVES,
        "sp AS (SELECT genotype, pool, subject, score, median(speed) AS ms FROM pooled JOIN cohort USING (subject) GROUP BY ALL)",
        "rg AS (SELECT genotype, pool, count(*) AS n, regr_slope(score, ms) AS coef, regr_intercept(score, ms) AS intercept, corr(score, ms) AS r FROM sp GROUP BY genotype, pool)",
    )
    + f"""SELECT genotype, pool, n, {q.rnd('CASE WHEN n > 3 THEN coef END', 3)} AS coef, {q.rnd('CASE WHEN n > 3 THEN intercept END', 3)} AS intercept,
 CASE WHEN n > 3 THEN {q.rnd('r * sqrt(n - 2) / sqrt(1 - r * r)', 4)} END AS t, CASE WHEN n > 3 THEN {q.rnd(q.correlation_p('r', 'n'), 4)} END AS p FROM rg""",
)
def ols_p_values(spark, sf_dir):
    return regression(spark, sf_dir, True).withColumn("t", rounded("t", 4)).withColumn("p", rounded("p", 4))


ALLEGIANCE = """pp AS (SELECT a.graph_id, a.node AS i, b.node AS j, avg(CASE WHEN a.community = b.community THEN 1.0 ELSE 0.0 END) AS w
 FROM parts a JOIN parts b ON a.graph_id = b.graph_id AND a.gamma_idx = b.gamma_idx AND a.run = b.run AND a.node > b.node GROUP BY ALL)"""


def matrix_correlation_sql(rank):
    value = "rank() OVER (PARTITION BY graph_id ORDER BY w) + (count(*) OVER (PARTITION BY graph_id, w) - 1) / 2.0" if rank else "w"
    return (
        q.ctes(q.SIGNALS, q.PARTITIONS, ALLEGIANCE, f"v AS (SELECT graph_id, i, j, {value} AS v FROM pp)")
        + f"SELECT a.graph_id AS g1, b.graph_id AS g2, {q.rnd(q.corr('a.v', 'b.v'), 5)} AS r FROM v a JOIN v b ON a.i = b.i AND a.j = b.j AND a.graph_id < b.graph_id GROUP BY ALL"
    )


def allegiance(spark, sf_dir):
    return com.contingency(src.price_band_partitions(src.signals(spark, sf_dir)), diagonal=False)


@query("e10_matrix_correlation_pearson", matrix_correlation_sql(False))
def matrix_correlation_pearson(spark, sf_dir):
    return stats.matrix_correlation(allegiance(spark, sf_dir), "graph_id", ["i", "j"], "w").withColumn("r", rounded("r", 5))


@query("e10_matrix_correlation_spearman", matrix_correlation_sql(True))
def matrix_correlation_spearman(spark, sf_dir):
    out = stats.matrix_correlation(allegiance(spark, sf_dir), "graph_id", ["i", "j"], "w", "spearman")
    return out.withColumn("r", rounded("r", 5))
