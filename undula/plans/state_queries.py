"""Queries for states and bursts (H), manifold measures (I) and stored results (A26, A27)."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from undula.functions.partitioning import cut_lineage, ensure_checkpoint_dir
from undula.functions.similarity import rounded
from undula.operators import connectivity as con, manifold as man, pooling as pool, states as st
from undula.plans import fragments as q
from undula.plans.catalog import query
from undula.plans.network_queries import BASE, stream
from undula.sources import store, tables as src

N_STATES = 4


def labels(signals):
    return src.state_labels(signals, N_STATES)


# ---- H ---------------------------------------------------------------------------------


@query("h1_kmeans_states")
def kmeans_states(spark, sf_dir):
    features = st.sample_features(src.signals(spark, sf_dir))
    return st.assign_states(st.fit_states(features, N_STATES), features)


@query("h2_elbow_curve")
def elbow_curve(spark, sf_dir):
    return st.elbow_curve(st.sample_features(src.signals(spark, sf_dir)))


@query("h3_silhouette")
def silhouette(spark, sf_dir):
    features = st.sample_features(src.signals(spark, sf_dir))
    score = st.silhouette(st.fit_states(features, N_STATES), features)
    return spark.createDataFrame([(N_STATES, float(score))], "k int, silhouette double")


FEATURES = """zm AS (SELECT region, avg(value) AS m, stddev_pop(value) AS s FROM sig GROUP BY region),
feat AS (SELECT subject, t, list(coalesce((value - m) / nullif(s, 0), 0) ORDER BY region) AS x FROM sig JOIN zm USING (region) GROUP BY subject, t)"""
# Given centres: the first samples of the four smallest subjects.
NEAREST = f"""cent AS (SELECT row_number() OVER (ORDER BY subject) - 1 AS cluster, x AS c FROM feat WHERE t = 0 QUALIFY row_number() OVER (ORDER BY subject) <= {N_STATES}),
near AS (SELECT subject, t, cluster, d FROM (SELECT subject, t, cluster, list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c[k]) * (x[k] - c[k]))) AS d FROM feat, cent)
  QUALIFY row_number() OVER (PARTITION BY subject, t ORDER BY d, cluster) = 1)"""


def given_centres(features):
    first = features.where("t = 0").orderBy("subject").limit(N_STATES).collect()
    return np.array([r["features"] for r in first])


@query("h1_nearest_centres", q.ctes(q.SIGNALS, FEATURES, NEAREST) + "SELECT subject, t, CAST(cluster AS INTEGER) AS cluster FROM near")
def nearest_centres(spark, sf_dir):
    """The assignment step of k-means for centres that SQL can restate."""
    features = st.sample_features(src.signals(spark, sf_dir))
    return st.assign_states(given_centres(features), features)


@query(
    "h2_assignment_cost",
    q.ctes(q.SIGNALS, FEATURES, NEAREST) + f"SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n, {q.rnd('sum(d)', 4)} AS inertia FROM near GROUP BY cluster",
)
def assignment_cost(spark, sf_dir):
    features = st.sample_features(src.signals(spark, sf_dir))
    return st.assignment_cost(given_centres(features), features).withColumn("inertia", rounded("inertia", 4))


@query(
    "h3_silhouette_of_labels",
    q.ctes(
        q.SIGNALS, FEATURES, q.STATES,
        "lab AS (SELECT row_number() OVER () AS id, cluster, x FROM feat JOIN states USING (subject, t))",
        "pairs AS (SELECT a.id, a.cluster AS own, b.cluster, sum(sqrt(list_sum(list_transform(range(1, len(a.x) + 1), lambda k: (a.x[k] - b.x[k]) * (a.x[k] - b.x[k]))))) AS total, count(*) AS n FROM lab a, lab b GROUP BY ALL)",
        "s AS (SELECT id, max(CASE WHEN own = cluster THEN total / nullif(n - 1, 0) END) AS a, max(CASE WHEN own = cluster THEN n END) AS n, min(CASE WHEN own <> cluster THEN total / n END) AS b FROM pairs GROUP BY id)",
    )
    + f"SELECT count(*) AS n, {q.rnd('avg(CASE WHEN b IS NOT NULL THEN CASE WHEN n > 1 THEN coalesce((b - a) / nullif(greatest(a, b), 0), 0) ELSE 0 END END)')} AS silhouette FROM s",
)
def silhouette_of_labels(spark, sf_dir):
    signals = src.signals(spark, sf_dir)
    labelled = st.sample_features(signals).join(labels(signals), ["subject", "t"])
    return st.mean_silhouette(labelled).withColumn("silhouette", rounded("silhouette"))


STATE_FC = f"""sfc0 AS (SELECT cluster, i, j, {q.corr('x', 'y')} AS fc FROM pr JOIN states USING (subject, t) GROUP BY cluster, i, j),
sfc AS (SELECT g.cluster, g.i, g.j, coalesce(s.fc, 0) AS fc
  FROM (SELECT c.cluster, p.i, p.j FROM (SELECT unnest(range({N_STATES})) AS cluster) c, (SELECT DISTINCT i, j FROM pr) p) g
  LEFT JOIN sfc0 s ON s.cluster = g.cluster AND s.i = g.i AND s.j = g.j)"""
STATES_ALL = (*BASE, q.STATES, STATE_FC)


def state_networks(signals):
    return st.state_fc(signals, labels(signals), N_STATES)


@query("h4_state_fc", q.ctes(*STATES_ALL) + f"SELECT cluster, i, j, {q.rnd('fc', 5)} AS fc FROM sfc")
def state_fc(spark, sf_dir):
    return state_networks(src.signals(spark, sf_dir)).withColumn("fc", rounded("fc", 5))


@query(
    "h5_global_efficiency",
    "WITH RECURSIVE " + q.ctes(
        *BASE,
        q.FC,
        "e AS (SELECT subject, i AS a, j AS b, 1 / abs(fc) AS d FROM fc WHERE fc <> 0 UNION ALL SELECT subject, j, i, 1 / abs(fc) FROM fc WHERE fc <> 0)",
        "p AS (SELECT subject, a, b, d, [a, b] AS seen FROM e UNION ALL SELECT p.subject, p.a, e.b, p.d + e.d, list_append(p.seen, e.b) FROM p JOIN e ON p.subject = e.subject AND p.b = e.a WHERE NOT list_contains(p.seen, e.b) AND len(p.seen) < 5)",
        "best AS (SELECT subject, a, b, min(d) AS d FROM p GROUP BY ALL)",
    )[len("WITH "):]
    + f"SELECT subject AS graph_id, {q.rnd('sum(1 / d) / 42', 6)} AS efficiency FROM best GROUP BY subject",
)
def global_efficiency(spark, sf_dir):
    signals = src.signals(spark, sf_dir)
    edges = con.fc_matrix(signals).select(F.col("subject").alias("graph_id"), "i", "j", F.abs("fc").alias("w"))
    return st.global_efficiency(edges, signals.agg(F.max("region")).first()[0] + 1).withColumn("efficiency", rounded("efficiency"))


SEQUENCE = "seq AS (SELECT s.subject, s.t, f.i, f.j, f.fc FROM states s JOIN sfc f USING (cluster))"
ACTIVE = """act AS (SELECT seq.*, CAST(fc > m * 0.01 AS INTEGER) AS active FROM seq
  JOIN (SELECT subject, i, j, max(fc) AS m FROM seq GROUP BY ALL) USING (subject, i, j))"""
EVENTS = """ev AS (SELECT subject, i, j, min(t) AS onset, max(t) + 1 AS "offset", count(*) AS duration
  FROM (SELECT *, t - row_number() OVER (PARTITION BY subject, i, j ORDER BY t) AS island FROM act WHERE active = 1) GROUP BY subject, i, j, island)"""
EVENTS_ALL = (*STATES_ALL, SEQUENCE, ACTIVE, EVENTS)


def sequence(spark, sf_dir):
    signals = src.signals(spark, sf_dir)
    return st.link_sequence(labels(signals), state_networks(signals))


def events(spark, sf_dir):
    return st.activation_events(st.link_activation(sequence(spark, sf_dir)))


@query(
    "h6_link_sequence",
    q.ctes(*STATES_ALL, SEQUENCE)
    + f"SELECT subject, i, j, count(*) AS n, {q.rnd('sum(fc)', 5)} AS total, {q.rnd('sum(fc * t)', 3)} AS moment FROM seq GROUP BY subject, i, j",
)
def link_sequence(spark, sf_dir):
    """The sequence of each link, summed plainly and by time: the sequence itself is long."""
    total, moment = rounded(F.sum("fc"), 5), rounded(F.sum(F.col("fc") * F.col("t")), 3)
    return sequence(spark, sf_dir).groupBy("subject", "i", "j").agg(F.count("fc").alias("n"), total.alias("total"), moment.alias("moment"))


@query("h7_link_activation", q.ctes(*STATES_ALL, SEQUENCE, ACTIVE) + "SELECT subject, t, i, j, active FROM act")
def link_activation(spark, sf_dir):
    return st.link_activation(sequence(spark, sf_dir))


@query("h8_activation_events", q.ctes(*EVENTS_ALL) + 'SELECT subject, i, j, onset, "offset", duration FROM ev')
def activation_events(spark, sf_dir):
    return events(spark, sf_dir)


@query(
    "h9_link_dynamics",
    q.ctes(*EVENTS_ALL) + f"SELECT i, j, count(*) AS n_events, {q.rnd('avg(duration)', 5)} AS mean_duration, max(duration) AS max_duration FROM ev GROUP BY i, j",
)
def link_dynamics(spark, sf_dir):
    return st.link_dynamics(events(spark, sf_dir)).withColumn("mean_duration", rounded("mean_duration", 5))


@query(
    "d19_describe_durations",
    q.ctes(*EVENTS_ALL)
    + f"""SELECT i, j, count(*) AS count, {q.rnd('avg(duration)', 5)} AS mean, {q.rnd('stddev_samp(duration)', 5)} AS std, min(duration) AS min,
 quantile_cont(duration, 0.25) AS q25, quantile_cont(duration, 0.5) AS q50, quantile_cont(duration, 0.75) AS q75, max(duration) AS max FROM ev GROUP BY i, j""",
)
def describe_durations(spark, sf_dir):
    out = pool.describe(events(spark, sf_dir), ["i", "j"], "duration")
    return out.withColumn("mean", rounded("mean", 5)).withColumn("std", rounded("std", 5))


DWELL = """dw AS (SELECT subject, cluster, min(t) AS start, count(*) AS length
  FROM (SELECT *, t - row_number() OVER (PARTITION BY subject, cluster ORDER BY t) AS island FROM states) GROUP BY subject, cluster, island)"""


@query("h10_dwell_times", q.ctes(q.SIGNALS, q.STATES, DWELL) + "SELECT * FROM dw")
def dwell_times(spark, sf_dir):
    return st.dwell_times(labels(src.signals(spark, sf_dir)))


@query(
    "h10_dwell_times_concatenated",
    q.ctes(
        q.SIGNALS,
        q.STATES,
        "cat AS (SELECT row_number() OVER (ORDER BY subject, t) - 1 AS t, cluster FROM states)",
    )
    + "SELECT cluster, min(t) AS start, count(*) AS length FROM (SELECT *, t - row_number() OVER (PARTITION BY cluster ORDER BY t) AS island FROM cat) GROUP BY cluster, island",
)
def dwell_times_concatenated(spark, sf_dir):
    return st.dwell_times(labels(src.signals(spark, sf_dir)), concat=True)


@query(
    "h11_dwell_by_state",
    q.ctes(q.SIGNALS, q.STATES, DWELL)
    + f"SELECT cluster, count(*) AS n, {q.rnd('avg(length)', 5)} AS mean_length, max(length) AS max_length, CAST(sum(length) AS BIGINT) AS total FROM dw GROUP BY cluster",
)
def dwell_by_state(spark, sf_dir):
    out = st.dwell_by_state(st.dwell_times(labels(src.signals(spark, sf_dir))))
    return out.withColumn("mean_length", rounded("mean_length", 5))


# ---- I ---------------------------------------------------------------------------------

Q = 0.9
NEAR = """near AS (SELECT a.subject, a.t, b.t AS other, -ln(sqrt(sum((a.value - b.value) * (a.value - b.value))) + 2.220446049250313e-16) AS y
  FROM sig a JOIN sig b ON a.subject = b.subject AND a.region = b.region AND a.t <> b.t GROUP BY a.subject, a.t, b.t)"""
OVER = f"""over_u AS (SELECT *, CASE WHEN other > t THEN other - 1 ELSE other END AS pos FROM near
  JOIN (SELECT subject, t, quantile_cont(y, {Q}) AS u FROM near GROUP BY subject, t) USING (subject, t) WHERE y > u)"""
THETA = f"""gaps AS (SELECT subject, t, pos - lag(pos) OVER (PARTITION BY subject, t ORDER BY pos) AS g FROM over_u),
sums AS (SELECT subject, t, count(g) AS n, count(*) FILTER (g > 1) AS c, sum((g - 1) * {1 - Q!r}) AS s FROM gaps GROUP BY subject, t),
samples AS (SELECT DISTINCT subject, t FROM sig),
theta AS (SELECT subject, t, CASE WHEN s > 0 THEN (s + n + c - sqrt((s + n + c) * (s + n + c) - 8 * c * s)) / (2 * s) END AS theta FROM samples LEFT JOIN sums USING (subject, t))"""
DIMENSION = """samples AS (SELECT DISTINCT subject, t FROM sig),
ds AS (SELECT subject, t, sum(y - u) - max(y - u) AS s, count(*) - 1 AS n FROM over_u GROUP BY subject, t),
dim AS (SELECT subject, t, CASE WHEN n > 0 THEN 1 / (s / n + 2.220446049250313e-16) END AS dimension FROM samples LEFT JOIN ds USING (subject, t))"""


@query(
    "i1_log_distances",
    q.ctes(q.SIGNALS, NEAR) + f"SELECT subject, t, count(*) AS n_other, {q.rnd('avg(y)', 5)} AS mean_y, {q.rnd('max(y)', 5)} AS max_y FROM near GROUP BY subject, t",
)
def log_distances(spark, sf_dir):
    near = man.closeness(src.signals(spark, sf_dir))
    return near.groupBy("subject", "t").agg(
        F.count(F.lit(1)).alias("n_other"), rounded(F.avg("y"), 5).alias("mean_y"), rounded(F.max("y"), 5).alias("max_y")
    )


def theta(spark, sf_dir, step=1):
    signals = cut_lineage(src.signals(spark, sf_dir))
    samples = man.every(signals, step).select("subject", "t").distinct()
    return man.fluidity(man.exceedances(signals, Q, step=step), samples, Q)


def dimension(spark, sf_dir, scale="mean_excess"):
    signals = cut_lineage(src.signals(spark, sf_dir))
    return man.local_dimension(man.exceedances(signals, Q), signals.select("subject", "t").distinct(), scale)


@query("i2_fluidity", q.ctes(q.SIGNALS, NEAR, OVER, THETA) + f"SELECT subject, t, {q.rnd('theta', 5)} AS theta FROM theta")
def fluidity(spark, sf_dir):
    return theta(spark, sf_dir).withColumn("theta", rounded("theta", 5))


@query("i3_local_dimension", q.ctes(q.SIGNALS, NEAR, OVER, DIMENSION) + f"SELECT subject, t, {q.rnd('dimension', 3)} AS dimension FROM dim")
def local_dimension(spark, sf_dir):
    return dimension(spark, sf_dir).withColumn("dimension", rounded("dimension", 3))


HALF = "half AS (SELECT subject, t // 2 AS t, region, value FROM sig WHERE t % 2 = 0)"
HALF_THETA = (HALF, NEAR.replace("sig a JOIN sig b", "half a JOIN half b"), OVER, THETA.replace("FROM sig", "FROM half"))


@query("i2_fluidity_every_second", q.ctes(q.SIGNALS, *HALF_THETA) + f"SELECT subject, CAST(t * 2 AS INTEGER) AS t, {q.rnd('theta', 5)} AS theta FROM theta")
def fluidity_every_second(spark, sf_dir):
    return theta(spark, sf_dir, step=2).withColumn("theta", rounded("theta", 5))


L_MOMENTS = """samples AS (SELECT DISTINCT subject, t FROM sig),
ranked AS (SELECT subject, t, y - u AS e, row_number() OVER (PARTITION BY subject, t ORDER BY y) AS r, count(*) OVER (PARTITION BY subject, t) - 1 AS n FROM over_u),
lm AS (SELECT subject, t, avg(e) AS l1, 2 * avg((r - 1)::DOUBLE / (n - 1) * e) - avg(e) AS l2 FROM ranked WHERE r <= n AND n > 1 GROUP BY subject, t),
dim AS (SELECT subject, t, CASE WHEN l2 > 1e-9 * l1 THEN 1 / ((l1 / l2 - 1) * l1 + 2.220446049250313e-16) END AS dimension FROM samples LEFT JOIN lm USING (subject, t))"""


@query("i3_local_dimension_l_moments", q.ctes(q.SIGNALS, NEAR, OVER, L_MOMENTS) + f"SELECT subject, t, {q.rnd('dimension', 3)} AS dimension FROM dim")
def local_dimension_l_moments(spark, sf_dir):
    return dimension(spark, sf_dir, "l_moments").withColumn("dimension", rounded("dimension", 3))


@query(
    "i4_fluidity_percentiles",
    q.ctes(
        q.SIGNALS,
        q.COHORT,
        NEAR,
        OVER,
        THETA,
        "pq AS (SELECT subject, unnest(range(3)) AS level_idx, unnest([0.05, 0.5, 0.95]) AS level, unnest(quantile_cont(theta, [0.05, 0.5, 0.95])) AS v FROM theta WHERE theta IS NOT NULL GROUP BY subject)",
    )
    + f"SELECT genotype AS label, level_idx, level, {q.rnd('avg(v)', 5)} AS mean FROM pq JOIN cohort USING (subject) GROUP BY ALL",
)
def fluidity_percentiles(spark, sf_dir):
    members = src.cohort(spark, sf_dir).select("subject", F.col("genotype").alias("label"))
    return man.percentile_summary(theta(spark, sf_dir), members, "theta").withColumn("mean", rounded("mean", 5))


# ---- stored results --------------------------------------------------------------------


def scratch_store(spark, name):
    """A new folder for stored results below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


STORED = f"SELECT subject, window_size, count(*) AS n, {q.rnd('sum(fc)', 4)} AS total FROM dfc GROUP BY ALL"


def summary(stored):
    total = rounded(F.sum("fc"), 4).alias("total")
    return stored.groupBy("subject", "window_size").agg(F.count("fc").alias("n"), total)


@query("a24_store_round_trip", q.ctes(*BASE, q.dfc(24)) + STORED)
def store_round_trip(spark, sf_dir):
    """A stream of two window sizes is stored, one of them stored again, and the other one read back by its parameters."""
    path = scratch_store(spark, "round-trip")
    # written once: both saves read it
    signals = cut_lineage(src.signals(spark, sf_dir))
    store.save(con.dfc_stream(signals, [24, 36]), path)
    # the first five frames reach over 40 samples
    store.save(con.dfc_stream(signals.where("t < 40"), 36).where("frame < 5"), path)
    return summary(store.load(spark, path, window_size=24, lag=1))


@query(
    "a25_read_through",
    q.ctes(*BASE, q.dfc(24)) + f"SELECT *, 1 AS computed FROM ({STORED})",
)
def read_through(spark, sf_dir):
    """The second request of a parameter set is answered from the store."""
    path, calls = scratch_store(spark, "read-through"), []

    def compute():
        calls.append(24)
        return stream(spark, sf_dir, windows=24)

    for _ in range(2):
        found = store.read_through(spark, path, compute, window_size=24, lag=1)
    return summary(found).withColumn("computed", F.lit(len(calls)))


GRID = """grid AS (SELECT subject, m FROM (SELECT DISTINCT subject FROM obs), (SELECT unnest(range(12)) AS m)),
done AS (SELECT subject, t // 7 AS m, count(*) AS n FROM obs GROUP BY ALL)"""


def month_parts(spark, sf_dir):
    obs = src.shipped_prices(spark, sf_dir).withColumn("m", F.floor(F.col("t") / 7).cast("int"))
    grid = obs.select("subject").distinct().select("subject", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("m"))
    return obs, grid


@query("a26_missing_results", q.ctes(q.OBSERVED, GRID) + "SELECT subject, m FROM grid WHERE (subject, m) NOT IN (SELECT (subject, m) FROM done WHERE n >= 50)")
def missing_results(spark, sf_dir):
    obs, grid = month_parts(spark, sf_dir)
    return store.missing(obs, grid, ["subject", "m"], expected_rows=50)


@query(
    "a27_merge_onto_grid",
    q.ctes(q.OBSERVED, GRID, "big AS (SELECT * FROM done WHERE n >= 50)")
    + "SELECT m, count(*) FILTER (n IS NULL) AS n_missing FROM grid LEFT JOIN big USING (subject, m) GROUP BY m",
)
def merge_onto_grid(spark, sf_dir):
    obs, grid = month_parts(spark, sf_dir)
    parts = obs.groupBy("subject", "m").agg(F.count(F.lit(1)).alias("n")).where("n >= 50")
    return store.count_missing(store.merge_onto_grid(parts, grid, ["subject", "m"]), "n", ["m"])
