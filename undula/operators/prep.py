"""Signal preparation and cohort algebra (family A)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from undula.operators.order_stats import running_totals

LENGTH_POLICIES = ("exclude_shortest", "truncate", "none")
PHENOTYPES = ("good", "learners", "impaired", "bad")

# The two accepted series names, kept as given by the data files.
SERIES_NAME = r"tc_Coimagine_(.+?)_(\d+)_\d+_seeds\.mat"
LOT_PREFIX = "lot3_"


# ---- keys and lengths ------------------------------------------------------------------


def subject_shapes(signals: DataFrame) -> DataFrame:
    """Samples and regions per subject: (subject, n_timepoints, n_regions)."""
    return signals.groupBy("subject").agg(
        (F.max("t") + 1).alias("n_timepoints"), F.countDistinct("region").alias("n_regions")
    )


def series_key(name: str | Column) -> Column:
    """Subject key '<id>_<number>' of a series name, NULL when the name does not match."""
    name = F.col(name) if isinstance(name, str) else name
    ident = F.regexp_extract(name, SERIES_NAME, 1)
    number = F.regexp_extract(name, SERIES_NAME, 2)
    return F.when(ident != "", F.concat_ws("_", ident, number))


def lot_number(name: str | Column, prefix: str = LOT_PREFIX) -> Column:
    """The number of four digits or more after the last ``prefix``; NULL when the name has no such prefix."""
    name = F.col(name) if isinstance(name, str) else name
    rest = F.element_at(F.split(name, F.lit(prefix)), -1)
    more = F.regexp_extract(rest, "^[0-9]{5,}", 0)
    digits = F.when(more != "", more).otherwise(F.substring(rest, 1, 4))
    return F.when(F.contains(name, F.lit(prefix)), digits.try_cast("int"))


def extract_keys(names: DataFrame, name: str, key: Column, out: str = "key") -> DataFrame:
    return names.withColumn(out, key).where(F.col(out).isNotNull())


def apply_length_policy(signals: DataFrame, policy: str) -> DataFrame:
    """Keep subjects longer than the shortest, cut all to the shortest, or leave as is."""
    if policy not in LENGTH_POLICIES:
        raise ValueError(f"unsupported policy {policy!r}, use one of {LENGTH_POLICIES}")
    if policy == "none":
        return signals
    lengths = signals.groupBy("subject").agg((F.max("t") + 1).alias("_len"))
    shortest = lengths.agg(F.min("_len").alias("_min"))
    if policy == "truncate":
        return signals.join(F.broadcast(shortest), F.col("t") < F.col("_min")).drop("_min")
    longer = lengths.join(F.broadcast(shortest), F.col("_len") > F.col("_min")).select("subject")
    return signals.join(longer, "subject", "left_semi")


def drop_transient(signals: DataFrame, k: int = 50) -> DataFrame:
    """Drop the first k samples and count t from 0 again."""
    return signals.where(F.col("t") >= k).withColumn("t", F.col("t") - k)


def zero_pad(signals: DataFrame, n_t: int) -> DataFrame:
    """Extend every (subject, region) to n_t samples with zeros."""
    ends = signals.groupBy("subject", "region").agg((F.max("t") + 1).alias("_next"))
    tail = F.when(F.col("_next") < n_t, F.sequence(F.col("_next"), F.lit(n_t - 1)))
    padding = ends.select("subject", F.explode(tail).alias("t"), "region", F.lit(0.0).alias("value"))
    return signals.select("subject", "t", "region", "value").unionByName(padding)


def keep_long(signals: DataFrame, min_timepoints: int) -> DataFrame:
    long_enough = (
        signals.groupBy("subject").agg((F.max("t") + 1).alias("n")).where(F.col("n") >= min_timepoints)
    )
    return signals.join(long_enough.select("subject"), "subject", "left_semi")


def split_by_length(signals: DataFrame, min_timepoints: int) -> DataFrame:
    """(subject, n_timepoints, length_class) with class 'long' or 'short'."""
    shape = signals.groupBy("subject").agg((F.max("t") + 1).alias("n_timepoints"))
    kind = F.when(F.col("n_timepoints") >= min_timepoints, "long").otherwise("short")
    return shape.withColumn("length_class", kind)


# ---- matching --------------------------------------------------------------------------


def match_cohort(shapes: DataFrame, cohort: DataFrame) -> DataFrame:
    """Subjects present on both sides, in subject order when sorted by the caller."""
    return shapes.join(cohort, "subject")


def unmatched(shapes: DataFrame, cohort: DataFrame) -> DataFrame:
    """Keys present on one side only: (subject, side)."""
    left = shapes.select("subject").join(cohort, "subject", "left_anti").withColumn("side", F.lit("signals"))
    right = cohort.select("subject").join(shapes, "subject", "left_anti").withColumn("side", F.lit("cohort"))
    return left.unionByName(right)


def intersect_sessions(first: DataFrame, second: DataFrame) -> DataFrame:
    """Keys in both sessions with their 0-based positions among each session's sorted keys."""
    return (
        position_by(first.select("subject").distinct(), "subject", "pos_first")
        .join(position_by(second.select("subject").distinct(), "subject", "pos_second"), "subject")
    )


def position_by(df: DataFrame, key: str, out: str = "pos") -> DataFrame:
    """0-based position of every row in the order of ``key``, a numeric column without repeats.

    Uses the cell-wise running totals, so no single task sorts all rows.
    """
    ordered = running_totals(df.withColumn("one", F.lit(1)), [], key, ["one"])
    return ordered.select(*df.columns, F.col("before_one").cast("int").alias(out))


def keep_listed(cohort: DataFrame, wanted: DataFrame, key: str = "subject") -> DataFrame:
    """Semi-join on a key list, sorted by key."""
    return cohort.join(wanted.select(key), key, "left_semi").orderBy(key)


# ---- cohort columns --------------------------------------------------------------------


def map_codes(c: str | Column, codes: Mapping[str, int]) -> Column:
    """Mapped code, NULL for values without a code."""
    c = F.col(c) if isinstance(c, str) else c
    chain = None
    for raw, code in codes.items():
        chain = F.when(c == raw, F.lit(code)) if chain is None else chain.when(c == raw, F.lit(code))
    return chain


def exclude_flagged(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Keep rows whose flags are all 0; an unmapped (NULL) flag drops the row."""
    return df.where(reduce(lambda a, b: a & b, [F.col(f) == 0 for f in flags]))


def session_change(df: DataFrame, first: str, second: str, prefix: str) -> DataFrame:
    return df.withColumn(f"{prefix}_diff", F.col(second) - F.col(first)).withColumn(
        f"{prefix}_sum", F.col(second) + F.col(first)
    )


def split_code(df: DataFrame, column: str, names: Sequence[str], sep: str = "_") -> DataFrame:
    parts = F.split(column, sep)
    return df.select("*", *[F.get(parts, k).alias(n) for k, n in enumerate(names)])


def one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.coalesce(F.col(column) == v, F.lit(False)).alias(f"{column}_{v}") for v in levels])


def clean_label(c: str | Column) -> Column:
    """Strip a leading 'Both_' tag and turn dots into spaces."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.replace(c, F.lit("Both_"), F.lit("")), F.lit("."), F.lit(" "))


def stack_sessions(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Union of signal tables with the session name as a column."""
    tagged = [df.withColumn("session", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def classify_phenotypes(df: DataFrame, metric: str = "OiP", threshold: float = 0.2) -> DataFrame:
    """Add ``Phenotype_<metric>`` from the two session scores; NULL when a score is missing."""
    early, late = f"{metric}_2M", f"{metric}_4M"
    missing = {early, late} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    was, now = F.col(early) >= threshold, F.col(late) >= threshold
    good, learners, impaired, bad = PHENOTYPES
    label = (
        F.when(was & now, good)
        .when(~was & now, learners)
        .when(was & ~now, impaired)
        .when(~was & ~now, bad)
    )
    return df.withColumn(f"Phenotype_{metric}", label)


# ---- groups ----------------------------------------------------------------------------


def groups_by(cohort: DataFrame, columns: Sequence[str], grouping: str) -> DataFrame:
    """Membership rows (grouping, label, subject); rows with a missing level are left out."""
    levels = [F.col(c).cast("string") for c in columns]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in levels])
    return cohort.where(whole).select(F.lit(grouping).alias("grouping"), F.concat_ws("_", *levels).alias("label"), "subject")


def groups_by_session(groups: DataFrame, sessions: DataFrame) -> DataFrame:
    """Split every group by session: label '<group> <session>'."""
    return groups.join(sessions.select("subject", "session"), "subject").select(
        "grouping", F.concat_ws(" ", "label", "session").alias("label"), "subject"
    )


def combination_groups(
    cohort: DataFrame,
    primary: str,
    by: str,
    primary_levels: Sequence[str],
    by_levels: Sequence[str],
    sessions: Sequence[str] = ("2m", "4m"),
) -> DataFrame:
    """Members of every primary x by x session cell; an empty cell keeps one row with NULL subject."""
    spark = cohort.sparkSession
    cells = [(p, b, s) for p in primary_levels for b in by_levels for s in sessions]
    grid = spark.createDataFrame(cells, f"`{primary}` string, `{by}` string, session string")
    label = F.concat(F.concat_ws("_", primary, by), F.lit(" "), F.col("session"))
    # the grid is a parameter-sized table, so the cohort is never shuffled for it
    members = cohort.join(F.broadcast(grid), [primary, by, "session"]).select(label.alias("label"), "subject")
    empty = grid.select(label.alias("label")).join(
        members.select("label").distinct(), "label", "left_anti"
    )
    return members.unionByName(empty.withColumn("subject", F.lit(None).cast("long")))


def group_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, standard error of the mean and count of the non-missing values."""
    n = F.count(value)
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(n)).alias("sem"), n.alias("count")
    )


# ---- scaling ---------------------------------------------------------------------------


def center(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    means = signals.groupBy(*keys).agg(F.avg("value").alias("_m"))
    return signals.join(means, list(keys)).withColumn("value", F.col("value") - F.col("_m")).drop("_m")


def zscore_by_region(signals: DataFrame) -> DataFrame:
    """Z-score per region over all subjects' samples, population SD; NULL when the SD is 0."""
    moments = signals.groupBy("region").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    # one row per channel
    return (
        signals.join(F.broadcast(moments), "region")
        .withColumn("value", F.try_divide(F.col("value") - F.col("_m"), F.col("_s")))
        .select("subject", "t", "region", "value")
    )


def binarize(signals: DataFrame, share: float = 10.0) -> DataFrame:
    """1 where a sample exceeds SD/share of its whole subject (population SD), else 0."""
    spread = signals.groupBy("subject").agg((F.stddev_pop("value") / share).alias("_cut"))
    return signals.join(spread, "subject").select(
        "subject", "t", "region", (F.col("value") > F.col("_cut")).cast("int").alias("active")
    )


def alignment_report(signals: DataFrame, cohort: DataFrame, length_column: str | None = None) -> DataFrame:
    """Subjects whose rows disagree: missing on a side, or with another length than the cohort states."""
    shape = signals.groupBy("subject").agg((F.max("t") + 1).alias("_n"), F.lit(True).alias("_s"))
    side = cohort.select("subject", F.lit(True).alias("_c"), *([length_column] if length_column else []))
    both = shape.join(side, "subject", "full_outer")
    problem = F.when(F.col("_s").isNull(), "no signals").when(F.col("_c").isNull(), "no cohort row")
    if length_column:
        problem = problem.when(F.col("_n") != F.col(length_column), "length differs")
    return both.withColumn("problem", problem).where("problem is not null").select("subject", "problem")


def validate_alignment(signals: DataFrame, cohort: DataFrame, length_column: str | None = None) -> None:
    bad = alignment_report(signals, cohort, length_column).limit(5).collect()
    if bad:
        raise ValueError(f"signals and cohort are not aligned: {[(r.subject, r.problem) for r in bad]}")
