"""Canonical schemas and the adapters that build them from the driver's tables.

Signals are long rows (subject, t, region, value) with t and region 0-based and
every (t, region) cell present. A subject is a supplier, a sample a shipping month,
a region a line number; the value is the mean price, 0 where nothing was shipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from undula.functions.partitioning import cut_lineage

SIGNALS = T.StructType(
    [
        T.StructField("subject", T.LongType()),
        T.StructField("t", T.IntegerType()),
        T.StructField("region", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)
COHORT = T.StructType(
    [
        T.StructField("subject", T.LongType()),
        T.StructField("genotype", T.StringType()),
        T.StructField("treatment", T.StringType()),
        T.StructField("session", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

HOURS_PER_SAMPLE = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def complete_grid(observed: DataFrame) -> DataFrame:
    """Average repeated cells and fill missing (t, region) cells with 0.

    The grid reaches from 0 to the last sample and region of any subject. Empty rows for the whole
    grid are unioned in before one aggregation; the extent is a one-row aggregate. ``observed`` is
    read three times: what is costly to read comes here as written cells (``observed_cells``).
    """
    extent = observed.agg(F.max("t").alias("_t"), F.max("region").alias("_r"))
    grid = (
        observed.select("subject")
        .distinct()
        .crossJoin(F.broadcast(extent))
        .select("subject", "_r", F.explode(F.sequence(F.lit(0), "_t")).alias("t"))
        .select("subject", "t", F.explode(F.sequence(F.lit(0), "_r")).alias("region"))
        .withColumn("value", F.lit(None).cast("double"))
    )
    return (
        observed.select("subject", "t", "region", "value")
        .unionByName(grid)
        .groupBy("subject", "t", "region")
        .agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("value"))
    )


def shipped_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw observations: one row per line item as (subject, t, region, value)."""
    lineitem = table(spark, sf_dir, "lineitem")
    first = lineitem.agg(F.year(F.min("l_shipdate")).alias("_first"))
    month = (F.year("l_shipdate") - F.col("_first")) * 12 + F.month("l_shipdate") - 1
    return lineitem.crossJoin(F.broadcast(first)).select(
        F.col("l_suppkey").alias("subject"),
        month.alias("t"),
        (F.col("l_linenumber") - 1).alias("region"),
        F.col("l_extendedprice").alias("value"),
    )


def observed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price per (subject, t, region): line items are read once, and the cells that are left are written."""
    year = F.year("l_shipdate")
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("subject"), (year * 12 + F.month("l_shipdate") - 1).alias("_month"), (F.col("l_linenumber") - 1).alias("region"))
        .agg(F.avg("l_extendedprice").alias("value"))
    )
    cells = cut_lineage(cells)
    # January of the first year is sample 0.
    first = cells.agg((F.floor(F.min("_month") / 12) * 12).cast("int").alias("_first"))
    return cells.crossJoin(F.broadcast(first)).select("subject", (F.col("_month") - F.col("_first")).alias("t"), "region", "value")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_grid(observed_cells(spark, sf_dir))


def tolerant_scan(spark: SparkSession, path: str, schema: T.StructType = SIGNALS, kind: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Rows of all readable files below ``path``, and what was left out: (rows, rejected).

    ``rejected`` is (file, reason, n): files that cannot be read or are of another schema, files without rows, and how
    many rows of a file lack a key or cannot be parsed. Formats are parquet and csv (with a header).
    Key columns are those of ``schema`` but the last one. Files of no bytes are not listed.
    """
    if kind not in ("parquet", "csv"):
        raise ValueError(f"unsupported format {kind!r}, use 'parquet' or 'csv'")
    keys = schema.fieldNames()[:-1]
    reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    if kind == "csv":
        marked = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
        found = reader.schema(marked).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").csv(path)
    else:
        found = reader.schema(schema).parquet(path).withColumn("_broken", F.lit(None).cast("string"))
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    found = found.select("*", F.col("_metadata.file_path").alias("_file"))
    rows = found.where(F.col("_broken").isNull() & whole).select(*schema.fieldNames())
    reason = F.when(F.col("_broken").isNotNull(), "broken row").when(~whole, "no key")
    seen = found.groupBy(F.col("_file").alias("file"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    seen = cut_lineage(seen)
    # Only names are listed; the content column is pruned.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    silent = files.join(seen.select(plain("file").alias("_seen")).distinct(), plain(F.col("file")) == F.col("_seen"), "left_anti")
    lost = silent.select("file", F.lit("not readable or empty").alias("reason"), F.lit(0).cast("long").alias("n"))
    return rows, seen.where(F.col("reason").isNotNull()).unionByName(lost)


def event_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second source: users x 6-hour buckets x event types, summed values."""
    kinds = F.array(*[F.lit(k) for k in EVENT_KINDS])
    hours = F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    cells = (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("subject"),
            F.floor(hours / HOURS_PER_SAMPLE).cast("int").alias("t"),
            (F.array_position(kinds, F.col("event_type")) - 1).cast("int").alias("region"),
            "value",
        )
        .groupBy("subject", "t", "region")
        .agg(F.sum("value").alias("value"))
    )
    return complete_grid(cells)


EVENT_KINDS = ("click", "error", "purchase", "signup", "view")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with two grouping factors, a session and a behavioural score."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("subject"),
        F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("genotype"),
        F.when(F.col("s_acctbal") >= 4500, "treated").otherwise("control").alias("treatment"),
        F.when(F.col("n_nationkey") < 12, "2m").otherwise("4m").alias("session"),
        F.col("s_acctbal").alias("score"),
    )


def session_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores per customer (first and second period), NULL where a period is empty."""
    early = F.col("o_orderdate") < F.lit("1998-07-01").cast("timestamp_ntz")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("subject"))
        .agg(
            (F.avg(F.when(early, F.col("o_totalprice"))) / 500000).alias("OiP_2M"),
            (F.avg(F.when(~early, F.col("o_totalprice"))) / 500000).alias("OiP_4M"),
        )
    )


def state_labels(signals: DataFrame, n_states: int = 4) -> DataFrame:
    """A discrete state per (subject, t): the region with the largest sample, capped at the last state.

    Feeds the state operators with labels that SQL can restate exactly.
    """
    top = signals.groupBy("subject", "t").agg(
        F.max(F.struct("value", (-F.col("region")).alias("tie"))).alias("top")
    )
    return top.select("subject", "t", F.least(-F.col("top.tie"), F.lit(n_states - 1)).alias("cluster"))


def price_band_partitions(signals: DataFrame) -> DataFrame:
    """Partitions (graph_id, gamma_idx, run, node, community) of each subject's regions.

    A run is one year, a gamma index its half; regions in the same price band share a community.
    """
    half = F.floor(F.col("t") / 6) % 2
    return (
        signals.groupBy(
            F.col("subject").alias("graph_id"),
            half.cast("int").alias("gamma_idx"),
            F.floor(F.col("t") / 12).cast("int").alias("run"),
            F.col("region").alias("node"),
        )
        .agg(F.avg("value").alias("level"))
        .select(
            "graph_id",
            "gamma_idx",
            "run",
            "node",
            F.floor(F.col("level") / 12000).cast("int").alias("community"),
        )
    )
