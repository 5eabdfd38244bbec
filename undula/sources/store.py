"""Results kept as Parquet partitions keyed by their parameters (A24 to A27).

Parameters are columns and partition folders, never file names. Every save is a run of its own below
``runs``; when its files are written, the rows of each parameter set are counted as they were
stored and appended to ``manifest`` as the last step. Only the manifest says what is there: a run
that was cut off is in no manifest row, so its parameter sets are missing and computed again. The last
run of a parameter set counts. Nothing is replaced in place, so readers never see half a result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException


def save(df: DataFrame, path: str, by: Sequence[str] = ("window_size", "lag")) -> None:
    """Write a result; it replaces the parameter sets that it contains.

    Rows are rebalanced by the partition columns: small ones share a file, a large one is split.
    """
    spark, run, by = df.sparkSession, uuid.uuid4().hex, list(by)
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(f"{path}/runs/run={run}")
    try:
        stored = spark.read.parquet(f"{path}/runs/run={run}")
    except AnalysisException as error:
        if _nothing_there(error):
            return
        raise
    entry = stored.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).select(
        "*", F.lit(run).alias("run"), F.current_timestamp().alias("saved_at")
    )
    # One file, so that a save is listed as a whole or not at all.
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _nothing_there(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error)


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The parameter sets that are stored: (parameters, rows, run, saved_at), None when there are none."""
    try:
        entries = spark.read.parquet(f"{path}/manifest")
    except AnalysisException as error:
        if _nothing_there(error):
            return None
        raise
    names = [c for c in entries.columns if c not in ("rows", "run", "saved_at")]
    newest = F.max_by(F.struct("rows", "run", "saved_at"), F.struct("saved_at", "run"))
    return entries.groupBy(*names).agg(newest.alias("_m")).select(*names, "_m.*")


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def load_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def load(spark: SparkSession, path: str, **params) -> DataFrame | None:
    """Stored rows for the given parameters, None when the manifest lists none."""
    entries = manifest(spark, path)
    if entries is None:
        return None
    for name, value in params.items():
        entries = entries.where(F.col(name) == value)
    names = [c for c in entries.columns if c not in ("rows", "run", "saved_at")]
    # A row per parameter set and its run; the runs also prune the folders that are read.
    entries = entries.select(*names, "run").collect()
    if not entries:
        return None
    stored = spark.read.option("basePath", f"{path}/runs").parquet(*sorted({f"{path}/runs/run={e['run']}" for e in entries}))
    wanted = spark.createDataFrame([tuple(e) for e in entries], [*names, "run"])
    return stored.join(F.broadcast(wanted), [*names, "run"], "left_semi").drop("run")


def read_through(spark: SparkSession, path: str, compute: Callable[[], DataFrame], **params) -> DataFrame:
    """Stored result of ``params``; computed, saved and read back when absent."""
    found = load(spark, path, **params)
    if found is None:
        save(compute(), path, tuple(params))
        found = load(spark, path, **params)
    return found


def missing(stored: DataFrame | None, wanted: DataFrame, keys: Sequence[str], expected_rows: int = 1) -> DataFrame:
    """Wanted keys that are absent or have fewer rows than expected."""
    if stored is None:
        return wanted.select(*keys)
    complete = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= expected_rows)
    return wanted.select(*keys).join(complete, list(keys), "left_anti")


def complete_missing(
    spark: SparkSession,
    path: str,
    wanted: Sequence[Mapping[str, int]],
    compute: Callable[..., DataFrame],
    expected_rows: int = 1,
) -> list[dict]:
    """Compute and save only the missing parameter sets; returns the sets that were computed.

    ``wanted`` is the parameter grid, a handful of rows.
    """
    names = list(wanted[0])
    grid = spark.createDataFrame([tuple(w[n] for n in names) for w in wanted], names)
    todo = [row.asDict() for row in missing(load(spark, path), grid, names, expected_rows).collect()]
    for params in todo:
        save(compute(**params), path, tuple(names))
    return todo


def merge_onto_grid(parts: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every grid row with its values, NULL where a part is missing."""
    return grid.join(parts, list(keys), "left")


def count_missing(merged: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return merged.groupBy(*keys).agg(F.count_if(F.col(value).isNull()).alias("n_missing"))
