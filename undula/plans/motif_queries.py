"""Queries for meta-connectivity, modules and trimers (F)."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from undula.functions.partitioning import cut_lineage
from undula.functions.similarity import rounded
from undula.operators import connectivity as con, meta
from undula.plans import fragments as q
from undula.plans.catalog import query
from undula.plans.network_queries import BASE, W12, stream
from undula.sources import tables as src

MC = f"""mc AS (
  SELECT a.subject, a.window_size, a.pair_id AS pair_a, b.pair_id AS pair_b, {q.corr('a.fc', 'b.fc')} AS mc
  FROM dfc a JOIN dfc b ON a.subject = b.subject AND a.frame = b.frame AND a.pair_id > b.pair_id GROUP BY ALL)"""
LINKS = """links AS (SELECT DISTINCT subject, i, j, i * (i - 1) // 2 + j AS pair_id FROM pr)"""
SORTED = """ordl AS (SELECT l.subject, l.pair_id, l.i, l.j, row_number() OVER (PARTITION BY l.subject ORDER BY fc.fc DESC, l.pair_id) - 1 AS pos
  FROM links l JOIN fc ON l.subject = fc.subject AND l.i = fc.i AND l.j = fc.j)"""
METAS = """metas AS (SELECT a.subject, a.pos AS pos_a, b.pos AS pos_b, a.i AS i1, a.j AS j1, b.i AS i2, b.j AS j2
  FROM ordl a JOIN ordl b ON a.subject = b.subject AND a.pos > b.pos)"""
TRIMERS = """tri AS (SELECT subject, pos_a, pos_b, root,
    list_filter([i1, j1], lambda x: x <> root)[1] AS leaf1, list_filter([i2, j2], lambda x: x <> root)[1] AS leaf2
  FROM (SELECT *, CASE WHEN i1 = i2 OR i1 = j2 THEN i1 WHEN j1 = i2 OR j1 = j2 THEN j1 END AS root FROM metas) WHERE root IS NOT NULL)"""
SORTED_ALL = (*BASE, q.FC, LINKS, SORTED, METAS, TRIMERS)
STATIC = (
    "ordl AS (SELECT DISTINCT i, j, pair_id, pair_id AS pos, 0 AS subject FROM dfc)",
    METAS,
    TRIMERS,
)


def observed_links(spark, sf_dir):
    return meta.link_index(src.signals(spark, sf_dir).select("subject", "region"), ["subject"])


def sorted_links(spark, sf_dir):
    """Each subject's links with their position by falling correlation."""
    fc = con.fc_matrix(src.signals(spark, sf_dir)).withColumn("pair_id", con.pair_id())
    # a group is one subject's links
    pos = F.row_number().over(W.partitionBy("subject").orderBy(F.col("fc").desc(), "pair_id")) - 1
    order = fc.select("subject", "pair_id", pos.alias("pos"))
    return meta.ordered_links(observed_links(spark, sf_dir), order, ["subject"])


def static_links(signals):
    return meta.link_index(signals.select("region"))


@query("f1_meta_connectivity", q.ctes(*W12, MC) + f"SELECT subject, window_size, pair_a, pair_b, {q.rnd('mc', 4)} AS mc FROM mc")
def meta_connectivity(spark, sf_dir):
    out = meta.meta_connectivity(stream(spark, sf_dir))
    return out.select("subject", "window_size", "pair_a", "pair_b", rounded("mc", 4).alias("mc"))


@query("f2_link_index", q.ctes(*BASE, LINKS) + "SELECT subject, pair_id, i, j FROM links")
def link_index(spark, sf_dir):
    return observed_links(spark, sf_dir)


@query("f2_ordered_meta_links", q.ctes(*SORTED_ALL) + "SELECT subject, pos_a, pos_b FROM metas")
def ordered_meta_links(spark, sf_dir):
    return meta.meta_links(sorted_links(spark, sf_dir), ["subject"], "pos").select("subject", "pos_a", "pos_b")


@query("f3_meta_link_regions", q.ctes(*SORTED_ALL) + "SELECT * FROM metas")
def meta_link_regions(spark, sf_dir):
    return meta.meta_links(sorted_links(spark, sf_dir), ["subject"], "pos")


@query("f4_trimers", q.ctes(*SORTED_ALL) + "SELECT subject, pos_a AS pair_a, pos_b AS pair_b, root, leaf1, leaf2 FROM tri")
def trimers(spark, sf_dir):
    return meta.trimers(sorted_links(spark, sf_dir), ["subject"], "pos")


@query(
    "f5_nplet_mask",
    q.ctes(*SORTED_ALL, "np AS (SELECT m.subject, m.pos_a, m.pos_b, coalesce(t.root + 1, 0) AS nplet FROM metas m LEFT JOIN tri t ON m.subject = t.subject AND m.pos_a = t.pos_a AND m.pos_b = t.pos_b)")
    + """SELECT subject, pos_a AS row, pos_b AS col, nplet FROM np UNION ALL SELECT subject, pos_b, pos_a, nplet FROM np
UNION ALL SELECT subject, pos, pos, NULL FROM ordl""",
)
def nplet_mask(spark, sf_dir):
    links = sorted_links(spark, sf_dir)
    motifs = meta.trimers(links, ["subject"], "pos")
    index = meta.nplet_index(meta.meta_links(links, ["subject"], "pos"), motifs, ["subject"])
    return meta.nplet_mask(index, links, ["subject"], "pos")


@query(
    "f6_leaves_and_root",
    q.ctes(*SORTED_ALL) + "SELECT subject, pos_a, pos_b, root, least(leaf1, leaf2) AS leaf_low, greatest(leaf1, leaf2) AS leaf_high FROM tri",
)
def leaves_and_root(spark, sf_dir):
    ends = [F.col(c) for c in ("i1", "j1", "i2", "j2")]
    metas = meta.meta_links(sorted_links(spark, sf_dir), ["subject"], "pos")
    found = metas.withColumn("root", meta.root_of(*ends)).where("root is not null").withColumn("leaves", meta.leaves_of(*ends))
    return found.select("subject", "pos_a", "pos_b", "root", F.array_min("leaves").alias("leaf_low"), F.array_max("leaves").alias("leaf_high"))


GENUINE = """mean AS (SELECT subject, pair_id, avg(fc) AS mean_fc FROM dfc GROUP BY ALL),
fcp AS (SELECT subject, i * (i - 1) // 2 + j AS pair_id, fc FROM fc),
gen AS (SELECT m.subject, t.pos_a AS pair_a, t.pos_b AS pair_b, t.root, sign(l.fc) AS leaf_sign, sign(a.fc) AS root_sign1, sign(b.fc) AS root_sign2,
    least(abs(a.fc), abs(b.fc)) > abs(l.fc) AS fc_root, abs(m.mc) > abs(l.fc) AS mc_fc, abs(m.mc) > abs(d.mean_fc) AS mc_dfc
  FROM mc m JOIN tri t ON m.pair_a = t.pos_a AND m.pair_b = t.pos_b
  JOIN fcp a ON a.subject = m.subject AND a.pair_id = t.pos_a
  JOIN fcp b ON b.subject = m.subject AND b.pair_id = t.pos_b
  JOIN fcp l ON l.subject = m.subject AND l.pair_id = greatest(leaf1, leaf2) * (greatest(leaf1, leaf2) - 1) // 2 + least(leaf1, leaf2)
  JOIN mean d ON d.subject = m.subject AND d.pair_id = l.pair_id)"""
GENUINE_ALL = (*W12, q.FC, MC, *STATIC, GENUINE)


def genuine(spark, sf_dir):
    # written once: the series, the static networks and the links read it
    signals = cut_lineage(src.signals(spark, sf_dir))
    series = cut_lineage(con.link_series(signals, [12]))
    motifs = cut_lineage(meta.trimers(static_links(signals)))
    mc = meta.meta_connectivity_of_series(series).select("subject", "pair_a", "pair_b", "mc")
    frames = series.select("subject", "window_size", "i", "j", F.explode("fc").alias("fc"))
    return meta.genuine_trimers(motifs, con.fc_matrix(signals), mc, con.mean_over_frames(frames))


@query(
    "f7_genuine_by_fc",
    q.ctes(*GENUINE_ALL) + "SELECT subject, pair_a, pair_b, root, CAST(leaf_sign AS INTEGER) AS leaf_sign, CAST(root_sign1 AS INTEGER) AS root_sign1, CAST(root_sign2 AS INTEGER) AS root_sign2, fc_root FROM gen",
)
def genuine_by_fc(spark, sf_dir):
    return genuine(spark, sf_dir).drop("mc_fc", "mc_dfc")


@query("f8_genuine_by_mc", q.ctes(*GENUINE_ALL) + "SELECT subject, pair_a, pair_b, root, mc_fc, mc_dfc FROM gen")
def genuine_by_mc(spark, sf_dir):
    return genuine(spark, sf_dir).select("subject", "pair_a", "pair_b", "root", "mc_fc", "mc_dfc")


SHARES = ", ".join(q.rnd(f"avg({r}::DOUBLE)") + f" AS {r}" for r in meta.RULES)


@query(
    "f9_trimer_prevalence_by_group",
    q.ctes(*GENUINE_ALL, q.COHORT) + f"SELECT genotype AS label, pair_a, pair_b, root, {SHARES} FROM gen JOIN cohort USING (subject) GROUP BY ALL",
)
def trimer_prevalence_by_group(spark, sf_dir):
    members = src.cohort(spark, sf_dir).select("subject", F.col("genotype").alias("label"))
    out = meta.prevalence(genuine(spark, sf_dir), members)
    return out.select("label", "pair_a", "pair_b", "root", *[rounded(r).alias(r) for r in meta.RULES])


@query("f9_trimer_prevalence", q.ctes(*GENUINE_ALL) + f"SELECT pair_a, pair_b, root, {SHARES} FROM gen GROUP BY ALL")
def trimer_prevalence(spark, sf_dir):
    out = meta.prevalence(genuine(spark, sf_dir))
    return out.select("pair_a", "pair_b", "root", *[rounded(r).alias(r) for r in meta.RULES])


@query(
    "f10_values_by_root",
    q.ctes(*W12, MC, *STATIC)
    + f"""SELECT m.subject, root, count(*) AS n, {q.rnd('avg(mc)', 5)} AS mean_mc, {q.rnd('stddev_samp(mc)', 5)} AS sd_mc, {q.rnd('sum(abs(mc))', 4)} AS strength
FROM mc m JOIN tri t ON m.pair_a = t.pos_a AND m.pair_b = t.pos_b GROUP BY m.subject, root""",
)
def values_by_root(spark, sf_dir):
    dfc = stream(spark, sf_dir)
    out = meta.values_by_root(meta.meta_connectivity(dfc), meta.trimers(static_links(src.signals(spark, sf_dir))))
    return out.select("subject", "root", "n", rounded("mean_mc", 5).alias("mean_mc"), rounded("sd_mc", 5).alias("sd_mc"), rounded("strength", 4).alias("strength"))


RUN_MODULES = "pm AS (SELECT graph_id, gamma_idx, run, node, community + 1 AS community FROM parts)"


def modules(spark, sf_dir):
    parts = src.price_band_partitions(src.signals(spark, sf_dir))
    return parts.withColumn("community", F.col("community") + 1)


@query(
    "f11_intramodule_pairs",
    q.ctes(q.SIGNALS, q.PARTITIONS, RUN_MODULES)
    + """SELECT a.graph_id, a.gamma_idx, a.run, a.community AS module, a.node AS i, b.node AS j FROM pm a
JOIN pm b ON a.graph_id = b.graph_id AND a.gamma_idx = b.gamma_idx AND a.run = b.run AND a.community = b.community AND a.node <= b.node""",
)
def intramodule_pairs(spark, sf_dir):
    return meta.intramodule_pairs(modules(spark, sf_dir), ["graph_id", "gamma_idx", "run"])


@query(
    "f11_module_mask",
    q.ctes(q.SIGNALS, q.PARTITIONS, RUN_MODULES)
    + """SELECT a.graph_id, a.gamma_idx, a.run, a.node AS i, b.node AS j, CASE WHEN a.community = b.community THEN a.community ELSE 0 END AS module FROM pm a
JOIN pm b ON a.graph_id = b.graph_id AND a.gamma_idx = b.gamma_idx AND a.run = b.run AND a.node > b.node""",
)
def module_mask(spark, sf_dir):
    return meta.module_mask(modules(spark, sf_dir), ["graph_id", "gamma_idx", "run"])


@query(
    "f12_ordered_mc_values",
    q.ctes(
        *W12,
        MC,
        """about AS (SELECT pair_id, i, j, pair_id % 4 + 1 AS community, row_number() OVER (ORDER BY pair_id % 4, pair_id) - 1 AS pos
          FROM (SELECT DISTINCT pair_id, i, j FROM dfc))""",
    )
    + f"""SELECT subject, a.pos AS pos_a, b.pos AS pos_b, {q.rnd('mc', 4)} AS mc, CASE WHEN a.community = b.community THEN a.community ELSE 0 END AS module,
  a.i AS i1, a.j AS j1, b.i AS i2, b.j AS j2
FROM mc JOIN about a ON a.pair_id IN (mc.pair_a, mc.pair_b) JOIN about b ON b.pair_id IN (mc.pair_a, mc.pair_b) AND a.pos > b.pos""",
)
def ordered_mc_values(spark, sf_dir):
    dfc = stream(spark, sf_dir)
    links = static_links(src.signals(spark, sf_dir))
    partition = links.select(F.col("pair_id").alias("node"), (F.col("pair_id") % 4 + 1).alias("community"))
    # one row per link of the region set
    pos = F.row_number().over(W.orderBy("community", "node")) - 1
    order = partition.select(F.col("node").alias("pair_id"), pos.alias("pos"))
    mc = meta.meta_connectivity(dfc).select("subject", "pair_a", "pair_b", "mc")
    return meta.ordered_values(mc, order, partition, links).withColumn("mc", rounded("mc", 4))


@query(
    "f13_viscosity",
    q.ctes(*W12, MC)
    + f"SELECT subject, count(*) FILTER (mc < 0) AS n_negative, {q.rnd('avg((mc < 0)::DOUBLE)')} AS share_negative, {q.rnd('avg(mc) FILTER (mc < 0)', 5)} AS mean_negative FROM mc GROUP BY subject",
)
def viscosity(spark, sf_dir):
    out = meta.viscosity(meta.meta_connectivity(stream(spark, sf_dir)))
    return out.select("subject", "n_negative", rounded("share_negative").alias("share_negative"), rounded("mean_negative", 5).alias("mean_negative"))
