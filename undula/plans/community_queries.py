"""Queries for communities, consensus and partition comparison (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from undula.functions.similarity import rounded
from undula.operators import community as com, connectivity as con
from undula.plans import fragments as q
from undula.plans.catalog import query
from undula.plans.network_queries import BASE, stream
from undula.sources import tables as src

GAMMAS = [0.8, 1.3]
PARTS = (q.SIGNALS, q.PARTITIONS)
SAME = """same AS (SELECT a.graph_id, a.gamma_idx, a.run, a.node AS i, b.node AS j, CAST(a.community = b.community AS INTEGER) AS same
  FROM parts a JOIN parts b ON a.graph_id = b.graph_id AND a.gamma_idx = b.gamma_idx AND a.run = b.run AND a.node >= b.node)"""
FRAME_W = "fw AS (SELECT graph_id, run, i, j, avg(same) AS w FROM same WHERE i > j GROUP BY ALL)"


def partitions(spark, sf_dir):
    return src.price_band_partitions(src.signals(spark, sf_dir))


def edges(spark, sf_dir):
    fc = con.fc_matrix(src.signals(spark, sf_dir))
    return fc.select(F.col("subject").alias("graph_id"), "i", "j", F.col("fc").alias("w"))


def frame_weights(spark, sf_dir):
    return com.contingency(partitions(spark, sf_dir), ["graph_id", "run"], diagonal=False)


def members(spark, sf_dir):
    return src.cohort(spark, sf_dir).select("subject", F.col("genotype").alias("label"))


# ---- detection: randomised, so checked by properties, not by SQL ------------------------


@query("g1_detect_communities")
def detect_communities(spark, sf_dir):
    return com.detect_communities(edges(spark, sf_dir), com.gamma_range(), runs=100, seed=7)


@query("g5_allegiance_communities")
def allegiance_communities(spark, sf_dir):
    found, _ = com.allegiance_communities(edges(spark, sf_dir), seed=7)
    return found


@query("g6_averaged_allegiance")
def averaged_allegiance(spark, sf_dir):
    dfc = stream(spark, sf_dir, windows=24)
    graph = F.concat_ws("_", "subject", "frame")
    stack = dfc.select(graph.alias("graph_id"), F.col("subject").alias("stack_id")).distinct()
    graphs = dfc.select(graph.alias("graph_id"), "i", "j", F.col("fc").alias("w"))
    labels, _ = com.averaged_allegiance(graphs, stack, seed=7)
    return labels


@query("g7_sort_by_modularity")
def sort_by_modularity(spark, sf_dir):
    return com.sort_by_modularity(con.fc_matrix(src.signals(spark, sf_dir)), seed=7)


@query("g8_frame_allegiance")
def frame_allegiance(spark, sf_dir):
    found, _ = com.frame_allegiance(stream(spark, sf_dir, windows=36), seed=7)
    return found.select("graph_id.subject", "graph_id.window_size", "graph_id.frame", "node", "community", "pos")


@query("g10_temporal_consensus")
def temporal_consensus(spark, sf_dir):
    mean = com.temporal_mean(frame_weights(spark, sf_dir), ["graph_id"]).withColumnRenamed("graph_id", "subject")
    return com.temporal_consensus(mean, seed=7)


@query("g22_group_allegiance")
def group_allegiance(spark, sf_dir):
    weights = com.contingency(partitions(spark, sf_dir), diagonal=False)
    return com.group_allegiance(weights, members(spark, sf_dir), seed=7)


# ---- exact given a partition -----------------------------------------------------------

MODULARITY = f"""e AS (SELECT subject AS graph_id, i, j, greatest(fc, 0) AS wp, greatest(-fc, 0) AS wn FROM fc
  UNION ALL SELECT subject, j, i, greatest(fc, 0), greatest(-fc, 0) FROM fc),
k AS (SELECT graph_id, i AS node, sum(wp) AS kp, sum(wn) AS kn FROM e GROUP BY ALL),
s AS (SELECT graph_id, sum(kp) AS sp, sum(kn) AS sn FROM k GROUP BY graph_id),
ins AS (SELECT p.graph_id, p.gamma_idx, p.run, sum(CASE WHEN p.community = o.community THEN wp ELSE 0 END) AS ip, sum(CASE WHEN p.community = o.community THEN wn ELSE 0 END) AS im
  FROM e JOIN parts p ON e.graph_id = p.graph_id AND e.i = p.node JOIN parts o ON o.graph_id = p.graph_id AND o.gamma_idx = p.gamma_idx AND o.run = p.run AND e.j = o.node GROUP BY ALL),
c AS (SELECT graph_id, gamma_idx, run, community, sum(kp) AS cp, sum(kn) AS cn FROM parts JOIN k USING (graph_id, node) GROUP BY ALL),
ex AS (SELECT graph_id, gamma_idx, run, sum(cp * cp) AS ep, sum(cn * cn) AS en FROM c GROUP BY ALL),
qm AS (SELECT graph_id, gamma_idx, run, coalesce((ip - g * coalesce(ep / nullif(sp, 0), 0)) / nullif(sp, 0), 0) - coalesce((im - g * coalesce(en / nullif(sn, 0), 0)) / nullif(sp + sn, 0), 0) AS q
  FROM (SELECT *, CASE gamma_idx WHEN 0 THEN {GAMMAS[0]}::DOUBLE ELSE {GAMMAS[1]}::DOUBLE END AS g FROM ins) JOIN ex USING (graph_id, gamma_idx, run) JOIN s USING (graph_id))"""
Q_ALL = (*BASE, q.FC, q.PARTITIONS, MODULARITY)


def modularities(spark, sf_dir):
    return com.modularity(edges(spark, sf_dir), partitions(spark, sf_dir), GAMMAS)


@query("g2_signed_modularity", q.ctes(*Q_ALL) + f"SELECT graph_id, gamma_idx, run, {q.rnd('q')} AS q FROM qm")
def signed_modularity(spark, sf_dir):
    return modularities(spark, sf_dir).withColumn("q", rounded("q"))


@query("g3_agreement", q.ctes(*PARTS, SAME) + "SELECT graph_id, gamma_idx, i, j, CAST(sum(same) AS BIGINT) AS agreement FROM same GROUP BY ALL")
def agreement(spark, sf_dir):
    return com.agreement(partitions(spark, sf_dir))


@query(
    "g4_contingency_levels",
    q.ctes(*PARTS, SAME)
    + f"SELECT graph_id, i, j, gamma_idx, CAST(sum(same) AS BIGINT) AS agreement, {q.rnd('avg(same)')} AS w FROM same GROUP BY GROUPING SETS ((graph_id, i, j, gamma_idx), (graph_id, i, j))",
)
def contingency_levels(spark, sf_dir):
    return com.contingency_levels(partitions(spark, sf_dir)).withColumn("w", rounded("w"))


@query("g9_temporal_mean", q.ctes(*PARTS, SAME, FRAME_W) + f"SELECT graph_id, i, j, {q.rnd('avg(w)')} AS w FROM fw GROUP BY ALL")
def temporal_mean(spark, sf_dir):
    return com.temporal_mean(frame_weights(spark, sf_dir), ["graph_id"]).withColumn("w", rounded("w"))


WINDOW = ["graph_id", "gamma_idx", "run"]


@query(
    "g11_reorder_labels",
    q.ctes(*PARTS)
    + "SELECT graph_id, gamma_idx, run, row_number() OVER (PARTITION BY graph_id, gamma_idx, run ORDER BY community, node) - 1 AS pos, community FROM parts",
)
def reorder_labels(spark, sf_dir):
    parts = partitions(spark, sf_dir)
    order = com.with_positions(parts, WINDOW).select(*WINDOW, "node", "pos")
    return com.reorder_labels(parts, order, WINDOW)


OVERLAP = """ov AS (SELECT p.graph_id, p.gamma_idx, p.run, p.community AS label, r.community AS ref_label, count(*) AS n
  FROM parts p JOIN parts r ON p.graph_id = r.graph_id AND p.gamma_idx = r.gamma_idx AND p.node = r.node AND r.run = 0 WHERE p.run > 0 GROUP BY ALL)"""


def overlap(spark, sf_dir):
    parts = partitions(spark, sf_dir)
    reference = parts.where("run = 0").select("graph_id", "gamma_idx", "node", "community")
    return com.label_overlap(parts.where("run > 0"), reference, WINDOW)


@query("g12_label_overlap", q.ctes(*PARTS, OVERLAP) + "SELECT * FROM ov")
def label_overlap(spark, sf_dir):
    return overlap(spark, sf_dir)


# Pair after pair in order of overlap, each taken if both its labels are free; the recursion ends with the last pair.
GREEDY = """ord AS (SELECT *, row_number() OVER (PARTITION BY graph_id, gamma_idx, run ORDER BY n DESC, label, ref_label) AS k FROM ov),
g AS (SELECT graph_id, gamma_idx, run, label, ref_label, n, k, TRUE AS taken, [label] AS ls, [ref_label] AS rs FROM ord WHERE k = 1
  UNION ALL SELECT graph_id, gamma_idx, run, label, ref_label, n, k, free, CASE WHEN free THEN list_append(ls, label) ELSE ls END, CASE WHEN free THEN list_append(rs, ref_label) ELSE rs END
  FROM (SELECT o.*, ls, rs, NOT list_contains(ls, o.label) AND NOT list_contains(rs, o.ref_label) AS free
        FROM g JOIN ord o ON o.graph_id = g.graph_id AND o.gamma_idx = g.gamma_idx AND o.run = g.run AND o.k = g.k + 1))"""


@query(
    "g12_align_to_reference",
    q.ctes(*PARTS, OVERLAP, GREEDY).replace("WITH", "WITH RECURSIVE", 1) + "SELECT graph_id, gamma_idx, run, label, ref_label, n FROM g WHERE taken",
)
def align_to_reference(spark, sf_dir):
    return com.align_labels(overlap(spark, sf_dir), WINDOW)


# Every one-to-one map, label after label, each with one of its free partners or with none.
OPTIMAL = """lab AS (SELECT graph_id, gamma_idx, run, label, row_number() OVER (PARTITION BY graph_id, gamma_idx, run ORDER BY label) AS k FROM (SELECT DISTINCT graph_id, gamma_idx, run, label FROM ov)),
opt AS (SELECT graph_id, gamma_idx, run, n AS pn, ref_label, k FROM ov JOIN lab USING (graph_id, gamma_idx, run, label)
  UNION ALL SELECT graph_id, gamma_idx, run, 0, NULL, k FROM lab),
m AS (SELECT graph_id, gamma_idx, run, 0::BIGINT AS k, 0::BIGINT AS total, []::INTEGER[] AS used FROM (SELECT DISTINCT graph_id, gamma_idx, run FROM ov)
  UNION ALL SELECT m.graph_id, m.gamma_idx, m.run, o.k, total + pn, CASE WHEN ref_label IS NULL THEN used ELSE list_append(used, ref_label) END
  FROM m JOIN opt o ON o.graph_id = m.graph_id AND o.gamma_idx = m.gamma_idx AND o.run = m.run AND o.k = m.k + 1 WHERE ref_label IS NULL OR NOT list_contains(used, ref_label))"""


@query(
    "g12_optimal_alignment",
    q.ctes(*PARTS, OVERLAP, OPTIMAL).replace("WITH", "WITH RECURSIVE", 1)
    + "SELECT graph_id, gamma_idx, run, CAST(max(total) AS BIGINT) AS n FROM m GROUP BY ALL",
)
def optimal_alignment(spark, sf_dir):
    """The total overlap of the best map; the map itself need not be the only best one."""
    return com.assign_labels(overlap(spark, sf_dir), WINDOW).groupBy(*WINDOW).agg(F.sum("n").alias("n"))


@query(
    "g13_align_across_windows",
    q.ctes(
        *PARTS,
        "pool AS (SELECT graph_id, gamma_idx, node, community AS ref_label, count(*) AS c FROM parts GROUP BY ALL)",
        """ov AS (SELECT p.graph_id, p.gamma_idx, p.run, p.community AS label, o.ref_label, CAST(sum(CASE WHEN p.community = o.ref_label THEN c - 1 ELSE c END) AS BIGINT) AS n
  FROM parts p JOIN pool o USING (graph_id, gamma_idx, node) GROUP BY ALL)""",
    )
    + """SELECT graph_id, gamma_idx, run, label, ref_label, n FROM (
  SELECT *, row_number() OVER (PARTITION BY graph_id, gamma_idx, run, label ORDER BY n DESC, ref_label) AS rn FROM ov) WHERE rn = 1""",
)
def align_across_windows(spark, sf_dir):
    return com.align_across_windows(partitions(spark, sf_dir), ["graph_id", "gamma_idx"])


INFORMATION = """joint AS (SELECT a.graph_id, a.gamma_idx, a.run AS run1, b.run AS run2, a.community AS c1, b.community AS c2, count(*)::DOUBLE AS n
  FROM parts a JOIN parts b ON a.graph_id = b.graph_id AND a.gamma_idx = b.gamma_idx AND a.node = b.node AND a.run < b.run GROUP BY ALL),
hj AS (SELECT graph_id, gamma_idx, run1, run2, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h12 FROM joint GROUP BY ALL),
h AS (SELECT graph_id, gamma_idx, run, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT graph_id, gamma_idx, run, community, count(*)::DOUBLE AS n FROM parts GROUP BY ALL) GROUP BY ALL),
info AS (SELECT graph_id, gamma_idx, run1, run2, greatest(a.h + b.h - h12, 0) AS mi,
    CASE WHEN a.h + b.h < 1e-12 THEN 1 ELSE greatest(a.h + b.h - h12, 0) / ((a.h + b.h) / 2) END AS nmi
  FROM hj JOIN h a USING (graph_id, gamma_idx) JOIN h b USING (graph_id, gamma_idx) WHERE a.run = run1 AND b.run = run2)"""


@query("g14_mean_nmi", q.ctes(*PARTS, INFORMATION) + f"SELECT graph_id, gamma_idx, {q.rnd('avg(nmi)')} AS mean_nmi FROM info GROUP BY ALL")
def mean_nmi(spark, sf_dir):
    return com.mean_nmi(partitions(spark, sf_dir)).withColumn("mean_nmi", rounded("mean_nmi"))


@query("g15_mutual_information", q.ctes(*PARTS, INFORMATION) + f"SELECT graph_id, gamma_idx, run1, run2, {q.rnd('mi')} AS mi FROM info")
def mutual_information(spark, sf_dir):
    return com.partition_information(partitions(spark, sf_dir)).drop("nmi").withColumn("mi", rounded("mi"))


@query(
    "g16_label_correlation",
    q.ctes(*PARTS)
    + f"""SELECT a.graph_id, a.gamma_idx, a.run AS run1, b.run AS run2, {q.rnd(q.corr('a.community', 'b.community'), 5)} AS r
FROM parts a JOIN parts b ON a.graph_id = b.graph_id AND a.gamma_idx = b.gamma_idx AND a.node = b.node AND a.run < b.run GROUP BY ALL""",
)
def label_correlation(spark, sf_dir):
    return com.label_correlation(partitions(spark, sf_dir)).withColumn("r", rounded("r", 5))


RANKED = f"rk AS (SELECT *, {q.average_rank('graph_id, run', 'w')} AS rk FROM fw)"


@query(
    "g17_successive_similarity",
    q.ctes(*PARTS, SAME, FRAME_W, RANKED)
    + f"SELECT a.graph_id, a.run, {q.rnd(q.corr('a.rk', 'b.rk'), 5)} AS r FROM rk a JOIN rk b ON a.graph_id = b.graph_id AND a.i = b.i AND a.j = b.j AND b.run = a.run + 1 GROUP BY ALL",
)
def successive_similarity(spark, sf_dir):
    return com.successive_similarity(frame_weights(spark, sf_dir)).withColumn("r", rounded("r", 5))


@query(
    "g18_window_similarity",
    q.ctes(*PARTS, SAME, FRAME_W, RANKED)
    + f"SELECT a.graph_id, a.run AS run1, b.run AS run2, {q.rnd(q.corr('a.rk', 'b.rk'), 5)} AS r FROM rk a JOIN rk b ON a.graph_id = b.graph_id AND a.i = b.i AND a.j = b.j AND a.run < b.run GROUP BY ALL",
)
def window_similarity(spark, sf_dir):
    return com.window_similarity(frame_weights(spark, sf_dir)).withColumn("r", rounded("r", 5))


@query("g19_module_counts", q.ctes(*PARTS) + "SELECT graph_id, gamma_idx, run, count(DISTINCT community) AS n_modules FROM parts GROUP BY ALL")
def module_counts(spark, sf_dir):
    return com.module_counts(partitions(spark, sf_dir))


@query(
    "g20_median_labels",
    q.ctes(*PARTS, q.COHORT) + "SELECT genotype AS label, node, median(community) AS median_label FROM parts JOIN cohort ON graph_id = subject GROUP BY ALL",
)
def median_labels(spark, sf_dir):
    return com.median_labels(partitions(spark, sf_dir), members(spark, sf_dir))


@query(
    "g21_modularity_by_gamma",
    q.ctes(*Q_ALL) + f"SELECT graph_id, gamma_idx, {q.rnd('avg(q)')} AS mean_q, {q.rnd('stddev_pop(q)')} AS sd_q FROM qm GROUP BY ALL",
)
def modularity_by_gamma(spark, sf_dir):
    out = com.modularity_by_gamma(modularities(spark, sf_dir))
    return out.withColumn("mean_q", rounded("mean_q")).withColumn("sd_q", rounded("sd_q"))
