"""Queries for connectivity (B) and speed of change (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from undula.functions.similarity import rounded
from undula.operators import connectivity as con
from undula.operators import prep, speed as spd
from undula.operators.order_stats import medians_of_lists
from undula.plans import fragments as q
from undula.plans.catalog import query
from undula.sources import tables as src

BASE = (q.SIGNALS, q.PAIRS)
W12 = (*BASE, q.dfc(12))
SIZES = list(range(5, 51))
FULL_SWEEP = (*BASE, *[q.dfc(w, name=f"d{w}") for w in SIZES], q.union_all("dfc", *[f"d{w}" for w in SIZES]))
SWEEP = (*BASE, q.dfc(6, name="d6"), q.dfc(9, name="d9"), q.dfc(12, name="d12"), q.union_all("dfc", "d6", "d9", "d12"))


def stream(spark, sf_dir, windows=12, lag=1, **kw):
    return con.dfc_stream(src.signals(spark, sf_dir), windows, lag, **kw)


# ---- B: connectivity -------------------------------------------------------------------


@query("b1_fc_pearson", q.ctes(*BASE, q.FC) + f"SELECT subject, i, j, {q.rnd('fc')} AS fc FROM fc")
def fc_pearson(spark, sf_dir):
    return con.fc_matrix(src.signals(spark, sf_dir)).withColumn("fc", rounded("fc"))


@query(
    "b2_fc_phase_locking",
    q.ctes(q.EVENT_SIGNALS, "z AS (SELECT subject, t, region, CASE WHEN value < 20.005 THEN -1 ELSE 1 END AS s FROM esig)")
    + f"""SELECT a.subject, a.region AS i, b.region AS j, {q.rnd("abs(avg(a.s * b.s))")} AS fc
FROM z a JOIN z b ON a.subject = b.subject AND a.t = b.t AND a.region > b.region GROUP BY a.subject, a.region, b.region""",
)
def fc_phase_locking(spark, sf_dir):
    shifted = src.event_signals(spark, sf_dir).withColumn("value", F.col("value") - 20.005)
    return con.fc_matrix(shifted, method="plv").withColumn("fc", rounded("fc"))


@query(
    "b3_fc_full_layout",
    q.ctes(*BASE, q.FC)
    + f"""SELECT subject, i, j, {q.rnd('fc')} AS fc FROM fc
UNION ALL SELECT subject, j AS i, i AS j, {q.rnd('fc')} FROM fc
UNION ALL SELECT DISTINCT subject, region, region, 0.0 FROM sig""",
)
def fc_full_layout(spark, sf_dir):
    return con.fc_matrix(src.signals(spark, sf_dir), layout="full").withColumn("fc", rounded("fc"))


@query("b4_sliding_dfc", q.ctes(*W12) + f"SELECT subject, window_size, 1 AS lag, frame, i, j, pair_id, {q.rnd('fc', 4)} AS fc FROM dfc")
def sliding_dfc(spark, sf_dir):
    return stream(spark, sf_dir).withColumn("fc", rounded("fc", 4))


@query(
    "b4_disjoint_windows_dfc",
    q.ctes(*BASE, q.dfc(12, 12)) + f"SELECT subject, window_size, 12 AS lag, frame, i, j, pair_id, {q.rnd('fc', 5)} AS fc FROM dfc",
)
def disjoint_windows_dfc(spark, sf_dir):
    return stream(spark, sf_dir, lag=None).withColumn("fc", rounded("fc", 5))


@query(
    "b4_full_matrix_dfc",
    q.ctes(*BASE, q.dfc(12, 12))
    + f"""SELECT subject, window_size, frame, i, j, {q.rnd('fc', 5)} AS fc FROM dfc
UNION ALL SELECT subject, window_size, frame, j, i, {q.rnd('fc', 5)} FROM dfc
UNION ALL SELECT subject, 12, t // 12, region, region, CASE WHEN stddev_samp(value) > 0 THEN 1.0 ELSE 0.0 END
FROM sig WHERE t < 72 GROUP BY subject, t // 12, region""",
)
def full_matrix_dfc(spark, sf_dir):
    return stream(spark, sf_dir, lag=None, layout="3D").drop("lag").withColumn("fc", rounded("fc", 5))


@query(
    "b4_sliding_phase_locking",
    q.ctes(
        q.SIGNALS,
        "c AS (SELECT subject, t, region, value - 30000 AS value FROM sig)",
        "pr AS (SELECT a.subject, a.t, a.region AS i, b.region AS j, (CASE WHEN (a.value < 0) = (b.value < 0) THEN 1 ELSE -1 END) AS s "
        "FROM c a JOIN c b ON a.subject = b.subject AND a.t = b.t AND a.region > b.region)",
    )
    + """SELECT subject, t AS frame, i, j, round(r, 6) + 0.0 AS fc FROM (
  SELECT subject, t, i, j, abs(avg(s) OVER (PARTITION BY subject, i, j ORDER BY t ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS r FROM pr)
WHERE t <= 63""",
)
def sliding_phase_locking(spark, sf_dir):
    shifted = src.signals(spark, sf_dir).withColumn("value", F.col("value") - 30000)
    out = con.dfc_stream(shifted, 20, 1, method="plv")
    return out.select("subject", "frame", "i", "j", rounded("fc").alias("fc"))


@query(
    "b5_window_sweep",
    q.ctes(*FULL_SWEEP)
    + f"SELECT subject, window_size, i, j, count(*) AS frames, {q.rnd('avg(fc)', 5)} AS mean_fc, {q.rnd('max(fc)', 5)} AS max_fc FROM dfc GROUP BY ALL",
)
def window_sweep(spark, sf_dir):
    return (
        con.link_series(src.signals(spark, sf_dir), SIZES)
        .select("subject", "window_size", "i", "j", F.explode("fc").alias("fc"))
        .groupBy("subject", "window_size", "i", "j")
        .agg(
            F.count(F.lit(1)).alias("frames"),
            rounded(F.avg("fc"), 5).alias("mean_fc"),
            rounded(F.max("fc"), 5).alias("max_fc"),
        )
    )


REGION_COMMUNITY = "comm AS (SELECT DISTINCT region, region % 2 AS community FROM sig)"
COMMUNITY_PAIRS = """cpr AS (SELECT pr.*, a.community FROM pr JOIN comm a ON pr.i = a.region JOIN comm b ON pr.j = b.region AND a.community = b.community)"""


def region_community(signals):
    return signals.select("region").distinct().withColumn("community", F.col("region") % 2)


@query(
    "b6_community_dfc",
    q.ctes(*BASE, REGION_COMMUNITY, COMMUNITY_PAIRS, q.dfc(12, 1, pairs="cpr"))
    + f"SELECT subject, i % 2 AS community, frame, i, j, {q.rnd('fc', 4)} AS fc FROM dfc",
)
def community_dfc(spark, sf_dir):
    signals = src.signals(spark, sf_dir)
    out = con.community_dfc(signals, region_community(signals), 12, 1)
    return out.select("subject", "community", "frame", "i", "j", rounded("fc", 4).alias("fc"))


@query(
    "b7_fcd",
    q.ctes(*W12)
    + f"""SELECT a.subject, a.window_size, a.frame AS f1, b.frame AS f2, {q.rnd(q.corr('a.fc', 'b.fc'), 4)} AS r
FROM dfc a JOIN dfc b ON a.subject = b.subject AND a.pair_id = b.pair_id AND a.frame < b.frame
GROUP BY a.subject, a.window_size, a.frame, b.frame""",
)
def fcd(spark, sf_dir):
    return con.fcd(stream(spark, sf_dir)).withColumn("r", rounded("r", 4))


@query(
    "b8_vectorize_and_rebuild",
    q.ctes(*BASE, q.dfc(12, 12))
    + f"""SELECT subject, frame, i, j, {q.rnd('fc', 5)} AS fc FROM dfc
UNION ALL SELECT subject, frame, j, i, {q.rnd('fc', 5)} FROM dfc
UNION ALL SELECT DISTINCT subject, t // 12, region, region, 1.0 FROM sig WHERE t < 72""",
)
def vectorize_and_rebuild(spark, sf_dir):
    packed = con.pack_links(stream(spark, sf_dir, lag=None), ["subject", "frame"])
    return con.unpack_links(packed, ["subject", "frame"]).withColumn("fc", rounded("fc", 5))


@query(
    "b9_symmetry_check",
    q.ctes(*BASE, q.FC, "m AS (SELECT subject, fc AS a, CASE WHEN subject % 2 = 1 THEN fc * 1.01 ELSE fc END AS b FROM fc)")
    + "SELECT subject, bool_and(abs(a - b) <= 1e-8 + 1e-5 * least(abs(a), abs(b))) AS symmetric FROM m GROUP BY subject",
)
def symmetry_check(spark, sf_dir):
    """The upper triangle of every second subject is stretched, so some matrices are not symmetric."""
    full = con.fc_matrix(src.signals(spark, sf_dir), layout="full")
    stretched = F.when((F.col("subject") % 2 == 1) & (F.col("i") < F.col("j")), F.col("fc") * 1.01).otherwise(F.col("fc"))
    return con.is_symmetric(full.withColumn("fc", stretched), ["subject"])


@query(
    "b10_reorder_matrix",
    q.ctes(
        *BASE,
        q.FC,
        "ord AS (SELECT region AS node, row_number() OVER (ORDER BY sum(value) DESC) - 1 AS pos FROM sig GROUP BY region)",
    )
    + f"""SELECT fc.subject, a.pos AS i, b.pos AS j, {q.rnd('fc')} AS fc FROM fc
JOIN ord a ON fc.i = a.node JOIN ord b ON fc.j = b.node""",
)
def reorder_matrix(spark, sf_dir):
    signals = src.signals(spark, sf_dir)
    order = prep.position_by(signals.groupBy(F.col("region").alias("node")).agg((-F.sum("value")).alias("key")), "key").drop("key")
    return con.reorder(con.fc_matrix(signals), order).withColumn("fc", rounded("fc"))


@query(
    "b11_group_mean_matrix",
    q.ctes(*BASE, q.FC, q.COHORT)
    + f"SELECT genotype AS label, i, j, {q.rnd('avg(fc)')} AS fc FROM fc JOIN cohort USING (subject) GROUP BY genotype, i, j",
)
def group_mean_matrix(spark, sf_dir):
    members = src.cohort(spark, sf_dir).select("subject", F.col("genotype").alias("label"))
    return con.mean_matrix(con.fc_matrix(src.signals(spark, sf_dir)), members, ["i", "j"], "fc").withColumn("fc", rounded("fc"))


@query(
    "b12_mean_over_frames",
    q.ctes(*W12) + f"SELECT subject, window_size, i, j, {q.rnd('avg(fc)', 5)} AS mean_fc FROM dfc GROUP BY ALL",
)
def mean_over_frames(spark, sf_dir):
    return con.mean_over_frames(stream(spark, sf_dir)).withColumn("mean_fc", rounded("mean_fc", 5))


@query(
    "b13_thresholded_adjacency",
    q.ctes(*W12) + f"SELECT subject, frame, i, j, {q.rnd('fc', 4)} AS fc FROM dfc WHERE abs(fc) > 0.4",
)
def thresholded_adjacency(spark, sf_dir):
    return con.adjacency(stream(spark, sf_dir)).select("subject", "frame", "i", "j", rounded("fc", 4).alias("fc"))


# ---- C: speed --------------------------------------------------------------------------

SPEED_COLS = f"subject, window_size, frame1, frame2, {q.rnd('speed', 4)} AS speed"


def rounded_speed(df):
    return df.withColumn("speed", rounded("speed", 4))


@query("c1_pearson_speed", q.ctes(*W12, q.speed([(0, 1)], "2")) + f"SELECT {SPEED_COLS} FROM speed")
def pearson_speed(spark, sf_dir):
    return rounded_speed(spd.dfc_speed(stream(spark, sf_dir), 1))


RANKED = f"rk AS (SELECT subject, window_size, frame, pair_id, {q.average_rank('subject, window_size, frame', 'fc')} AS rk FROM dfc)"


@query(
    "c2_spearman_speed",
    q.ctes(*W12, RANKED, q.speed([(0, 2)], "3", source="rk", value="rk")) + f"SELECT {SPEED_COLS} FROM speed",
)
def spearman_speed(spark, sf_dir):
    return rounded_speed(spd.dfc_speed(stream(spark, sf_dir), 2, "spearman"))


@query("c3_cosine_speed", q.ctes(*W12, q.speed([(0, 5)], "6", cosine=True)) + f"SELECT {SPEED_COLS} FROM speed")
def cosine_speed(spark, sf_dir):
    return rounded_speed(spd.dfc_speed(stream(spark, sf_dir), 5, "cosine"))


@query(
    "c4_unified_median_speed",
    q.ctes(*W12, q.speed([(0, 12)], "13"))
    + f"SELECT subject, window_size, {q.rnd('median(speed)', 5)} AS median_speed FROM speed GROUP BY subject, window_size",
)
def unified_median_speed(spark, sf_dir):
    speeds = spd.dfc_speed(stream(spark, sf_dir), 12)
    return spd.median_speed(speeds, ["subject", "window_size"]).withColumn("median_speed", rounded("median_speed", 5))


@query("c5_classic_speed", q.ctes(*W12, q.speed([(0, 12)], "12")) + f"SELECT {SPEED_COLS} FROM speed")
def classic_speed(spark, sf_dir):
    return rounded_speed(spd.dfc_speed(stream(spark, sf_dir), 12, count="classic"))


WHOLE = """whole AS (
  SELECT subject, window_size, frame, pair_id, fc FROM dfc
  UNION ALL SELECT subject, window_size, frame, pair_id + 100000, fc FROM dfc
  UNION ALL SELECT DISTINCT subject, window_size, frame, 200000 + r, 1.0
            FROM (SELECT subject, window_size, frame, unnest([i, j]) AS r FROM dfc))"""


@query(
    "c5_classic_full_matrix_speed",
    q.ctes(*W12, WHOLE, q.speed([(0, 4)], "4", source="whole")) + f"SELECT {SPEED_COLS} FROM speed",
)
def classic_full_matrix_speed(spark, sf_dir):
    return rounded_speed(spd.dfc_speed(stream(spark, sf_dir), 4, count="classic", matrix="full"))


TAUS = [0, 1, 2, 3]
SPLIT = q.speed([(tau, 24 + tau) for tau in TAUS], "28")


@query("c6_tau_split_speed", q.ctes(*W12, SPLIT) + f"SELECT tau, {SPEED_COLS} FROM speed")
def tau_split_speed(spark, sf_dir):
    return rounded_speed(spd.split_speed(stream(spark, sf_dir), [12], TAUS))


SWEEP_SPEED = (
    *FULL_SWEEP,
    *[q.speed([(tau, w + tau) for tau in TAUS], str(w + max(TAUS)), source=f"d{w}", name=f"s{w}") for w in SIZES],
    q.union_all("speed", *[f"s{w}" for w in SIZES]),
)


@query(
    "c9_speed_sweep",
    q.ctes(*SWEEP_SPEED)
    + f"SELECT subject, window_size, tau, count(*) AS n, {q.rnd('avg(speed)', 4)} AS mean_speed FROM speed GROUP BY subject, window_size, tau",
)
def speed_sweep(spark, sf_dir):
    """The production sweep: every window size at four taus, in one plan."""
    packed = spd.signal_speeds(src.signals(spark, sf_dir), SIZES, tau=max(TAUS), min_tau_zero=True)
    speeds = packed.select("subject", "window_size", "tau", F.explode("speed").alias("speed"))
    return speeds.groupBy("subject", "window_size", "tau").agg(F.count("speed").alias("n"), rounded(F.avg("speed"), 4).alias("mean_speed"))


@query("c7_partner_frames", q.ctes(*W12, SPLIT) + "SELECT subject, window_size, tau, frame1, frame2 FROM speed")
def partner_frames(spark, sf_dir):
    return spd.partner_frames(stream(spark, sf_dir), [12], TAUS)


@query(
    "c7_partner_networks",
    q.ctes(*W12, q.speed([(0, 4)], "5"))
    + f"""SELECT s.subject, s.frame1, s.frame2, d.pair_id, {q.rnd('d.fc', 4)} AS fc2
FROM speed s JOIN dfc d ON s.subject = d.subject AND s.frame2 = d.frame""",
)
def partner_networks(spark, sf_dir):
    return spd.partner_networks(stream(spark, sf_dir), 4).select(
        "subject", "frame1", "frame2", "pair_id", rounded("fc2", 4).alias("fc2")
    )


def oversampled_sql(tau):
    taus = range(-tau, tau + 1)
    parts = [q.speed([(t, w + t) for t in taus], str(w + tau), source=f"d{w}", name=f"s{w}") for w in (6, 9, 12)]
    return q.ctes(*SWEEP, *parts, q.union_all("speed", "s6", "s9", "s12"))


def stream_medians(spark, sf_dir, tau):
    packed = spd.signal_speeds(src.signals(spark, sf_dir), [6, 9, 12], tau)
    return medians_of_lists(packed, ["subject", "window_size", "tau"], "speed", "median_speed")


@query(
    "c8_oversampled_medians",
    oversampled_sql(2) + f"SELECT subject, window_size, tau, {q.rnd('median(speed)', 5)} AS median_speed FROM speed GROUP BY ALL",
)
def oversampled_medians(spark, sf_dir):
    out = stream_medians(spark, sf_dir, 2)
    return out.withColumn("median_speed", rounded("median_speed", 5))


@query(
    "c9_speed_distribution",
    q.ctes(*W12, q.speed([(t, 12 + t) for t in range(4)], "15")) + f"SELECT tau, {SPEED_COLS} FROM speed",
)
def speed_distribution(spark, sf_dir):
    return rounded_speed(spd.speed_rows(spd.signal_speeds(src.signals(spark, sf_dir), [12], tau=3, min_tau_zero=True)))


@query(
    "c10_batch_speed",
    q.ctes(
        *BASE,
        q.dfc(6, 2, "d6"),
        q.dfc(12, 2, "d12"),
        q.speed([(0, 3)], "4", source="d6", name="s6"),
        q.speed([(0, 6)], "7", source="d12", name="s12"),
        q.union_all("speed", "s6", "s12"),
    )
    + f"SELECT {SPEED_COLS} FROM speed",
)
def batch_speed(spark, sf_dir):
    return rounded_speed(spd.batch_speed(stream(spark, sf_dir, [6, 12], 2), [6, 12], 2))


@query(
    "c11_community_speed",
    q.ctes(
        *BASE,
        REGION_COMMUNITY,
        COMMUNITY_PAIRS,
        q.dfc(12, 1, pairs="cpr", name="cd"),
        "e AS (SELECT * FROM cd WHERE i % 2 = 0)",
        "o AS (SELECT * FROM cd WHERE i % 2 = 1)",
        q.speed([(tau, 24 + tau) for tau in TAUS], "28", source="e", name="se"),
        q.speed([(tau, 24 + tau) for tau in TAUS], "28", source="o", name="so"),
    )
    + f"SELECT 0 AS community, tau, {SPEED_COLS} FROM se UNION ALL SELECT 1, tau, {SPEED_COLS} FROM so",
)
def community_speed(spark, sf_dir):
    signals = src.signals(spark, sf_dir)
    cd = con.community_dfc(signals, region_community(signals), 12, 1)
    return rounded_speed(spd.split_speed(cd, [12], TAUS, keys=("subject", "community")))


@query(
    "c12_marginal_means",
    oversampled_sql(1)
    + f""", m AS (SELECT subject, window_size, tau, median(speed) AS ms FROM speed GROUP BY ALL)
SELECT subject, window_size, tau,
  CASE WHEN grouping(subject) = 0 THEN 'subject' WHEN grouping(window_size) = 0 THEN 'window_size'
       WHEN grouping(tau) = 0 THEN 'tau' ELSE 'all' END AS margin,
  {q.rnd('avg(ms)', 5)} AS mean_speed, {q.rnd('min(ms)', 5)} AS min_speed, {q.rnd('max(ms)', 5)} AS max_speed, count(ms) AS n
FROM m GROUP BY GROUPING SETS ((subject), (window_size), (tau), ())""",
)
def marginal_means(spark, sf_dir):
    med = stream_medians(spark, sf_dir, 1)
    out = spd.marginal_means(med)
    for c in ("mean_speed", "min_speed", "max_speed"):
        out = out.withColumn(c, rounded(c, 5))
    return out
