"""SQL building blocks (common table expressions) shared by the oracle statements."""

from __future__ import annotations

from undula.sources.tables import EVENT_KINDS


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def rnd(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def corr(x: str, y: str) -> str:
    return f"CASE WHEN stddev_samp({x}) * stddev_samp({y}) > 0 THEN corr({x}, {y}) ELSE 0 END"


OBSERVED = """obs AS (
  SELECT l_suppkey AS subject, (year(l_shipdate) - (SELECT year(min(l_shipdate)) FROM lineitem)) * 12 + month(l_shipdate) - 1 AS t,
         l_linenumber - 1 AS region, l_extendedprice AS value
  FROM lineitem)"""

SIGNALS = f"""{OBSERVED},
sig AS (
  SELECT g.subject, g.t, g.region, coalesce(v.value, 0) AS value
  FROM (SELECT s.subject, tt.t, rr.region
        FROM (SELECT DISTINCT subject FROM obs) s,
             (SELECT unnest(range((SELECT max(t) + 1 FROM obs))) AS t) tt,
             (SELECT unnest(range((SELECT max(region) + 1 FROM obs))) AS region) rr) g
  LEFT JOIN (SELECT subject, t, region, avg(value) AS value FROM obs GROUP BY subject, t, region) v
    ON v.subject = g.subject AND v.t = g.t AND v.region = g.region)"""

_KINDS = ", ".join(f"'{k}'" for k in EVENT_KINDS)

EVENT_SIGNALS = f"""esum AS (
  SELECT user_id AS subject,
         CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) / 21600.0) AS INTEGER) AS t,
         list_position([{_KINDS}], event_type) - 1 AS region, sum(value) AS value
  FROM events GROUP BY ALL),
esig AS (
  SELECT g.subject, g.t, g.region, coalesce(v.value, 0) AS value
  FROM (SELECT s.subject, tt.t, rr.region
        FROM (SELECT DISTINCT subject FROM esum) s,
             (SELECT unnest(range((SELECT max(t) + 1 FROM esum))) AS t) tt,
             (SELECT unnest(range((SELECT max(region) + 1 FROM esum))) AS region) rr) g
  LEFT JOIN esum v ON v.subject = g.subject AND v.t = g.t AND v.region = g.region)"""

COHORT = """cohort AS (
  SELECT s_suppkey AS subject, 'g' || n_regionkey AS genotype,
         CASE WHEN s_acctbal >= 4500 THEN 'treated' ELSE 'control' END AS treatment,
         CASE WHEN n_nationkey < 12 THEN '2m' ELSE '4m' END AS session, s_acctbal AS score
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

SESSION_SCORES = """scores AS (
  SELECT o_custkey AS subject,
         avg(CASE WHEN o_orderdate < TIMESTAMP '1998-07-01' THEN o_totalprice END) / 500000 AS oip_2m,
         avg(CASE WHEN o_orderdate >= TIMESTAMP '1998-07-01' THEN o_totalprice END) / 500000 AS oip_4m
  FROM orders GROUP BY o_custkey)"""

PAIRS = """pr AS (
  SELECT a.subject, a.t, a.region AS i, b.region AS j, a.value AS x, b.value AS y
  FROM sig a JOIN sig b ON a.subject = b.subject AND a.t = b.t AND a.region > b.region)"""

FC = f"""fc AS (
  SELECT subject, i, j, {corr('x', 'y')} AS fc FROM pr GROUP BY subject, i, j)"""

STATES = """states AS (
  SELECT subject, t, least(region, 3) AS cluster
  FROM (SELECT subject, t, region,
               row_number() OVER (PARTITION BY subject, t ORDER BY value DESC, region) AS rn FROM sig)
  WHERE rn = 1)"""

PARTITIONS = """parts AS (
  SELECT graph_id, gamma_idx, run, node, CAST(floor(level / 12000) AS INTEGER) AS community
  FROM (SELECT subject AS graph_id, (t // 6) % 2 AS gamma_idx, t // 12 AS run, region AS node, avg(value) AS level
        FROM sig GROUP BY ALL))"""


def dfc(window: int, lag: int = 1, name: str = "dfc", pairs: str = "pr") -> str:
    score = (
        "CASE WHEN stddev_samp(x) OVER w * stddev_samp(y) OVER w > 0 THEN corr(x, y) OVER w ELSE 0 END"
    )
    return f"""{name} AS (
  SELECT subject, {window} AS window_size, t // {lag} AS frame, i, j, i * (i - 1) // 2 + j AS pair_id, r AS fc
  FROM (SELECT subject, t, i, j, {score} AS r FROM {pairs}
        WINDOW w AS (PARTITION BY subject, i, j ORDER BY t ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING))
  WHERE t % {lag} = 0 AND t <= (SELECT max(t) + 1 FROM sig) - {window})"""


def union_all(name: str, *tables: str) -> str:
    return f"{name} AS ({' UNION ALL '.join(f'SELECT * FROM {t}' for t in tables)})"


def speed(
    steps: list[tuple[int, int]],
    last: str,
    source: str = "dfc",
    name: str = "speed",
    value: str = "fc",
    cosine: bool = False,
) -> str:
    """Speeds of frames f with f <= n - last - 1 against f + step, per (tau, step)."""
    grid = ", ".join(f"({tau}, {step})" for tau, step in steps)
    x, y = f"a.{value}", f"b.{value}"
    sim = corr(x, y)
    if cosine:
        norm = f"sqrt(sum({x} * {x})) * sqrt(sum({y} * {y}))"
        sim = f"CASE WHEN {norm} > 0 THEN sum({x} * {y}) / ({norm}) ELSE 0 END"
    return f"""{name}_n AS (SELECT subject, window_size, max(frame) + 1 AS n FROM {source} GROUP BY subject, window_size),
{name} AS (
  SELECT a.subject, a.window_size, g.tau, a.frame AS frame1, b.frame AS frame2,
         greatest(-1, least(2, 1 - ({sim}))) AS speed
  FROM {source} a JOIN {name}_n m ON a.subject = m.subject AND a.window_size = m.window_size
  CROSS JOIN (VALUES {grid}) g(tau, step)
  JOIN {source} b ON a.subject = b.subject AND a.window_size = b.window_size AND a.pair_id = b.pair_id
       AND b.frame = a.frame + g.step
  WHERE a.frame <= m.n - {last} - 1
  GROUP BY a.subject, a.window_size, g.tau, a.frame, b.frame)"""


def average_rank(partition: str, order: str) -> str:
    return (
        f"rank() OVER (PARTITION BY {partition} ORDER BY {order}) "
        f"+ (count(*) OVER (PARTITION BY {partition}, {order}) - 1) / 2.0"
    )


def normal_p(z: str) -> str:
    """Two-sided normal tail by the power series of the error function; 0 to 9 digits beyond 6."""
    x = f"(({z}) / sqrt(2.0))"
    term = f"CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * exp((2 * n + 1) * ln({x}) - lgamma(n + 1)) / (2 * n + 1)"
    return f"CASE WHEN {z} <= 0 THEN 1.0 WHEN {z} > 6 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda n: {term})) END"


def chi2_p(x: str, df: str) -> str:
    """Upper chi-square tail of whole degrees of freedom: finite sums, with a normal tail where they are odd."""
    even = f"exp(-({x}) / 2) * list_sum(list_transform(range(0, greatest({df} // 2, 1)), lambda i: exp(i * ln(({x}) / 2) - lgamma(i + 1))))"
    odd = (
        f"{normal_p(f'sqrt({x})')} + CASE WHEN {df} < 3 THEN 0 ELSE exp(-({x}) / 2) * "
        f"list_sum(list_transform(range(0, greatest(({df} - 1) // 2, 1)), lambda i: exp((i + 0.5) * ln(({x}) / 2) - lgamma(i + 1.5)))) END"
    )
    return f"CASE WHEN {x} <= 0 THEN 1.0 WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END"


def correlation_p(r: str, n: str) -> str:
    """Two-sided t tail of a correlation over ``n`` rows: the finite sums of whole degrees of freedom."""
    s, c, nu = f"abs({r})", f"sqrt(1 - ({r}) * ({r}))", f"({n} - 2)"
    even = f"{s} * list_sum(list_transform(range(0, greatest({nu} // 2, 1)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) * pow({c}, 2 * k))) / sqrt(pi())"
    odd = (
        f"2 / pi() * (asin({s}) + CASE WHEN {nu} < 3 THEN 0 ELSE {s} * sqrt(pi()) / 2 * "
        f"list_sum(list_transform(range(0, greatest(({nu} - 1) // 2, 1)), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow({c}, 2 * k + 1))) END)"
    )
    return f"CASE WHEN {r} IS NULL THEN NULL WHEN {s} >= 1 THEN 0.0 WHEN {nu} % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END"
