"""Explicit partitioning, and cutting of long lineages."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition by ``cols`` into at least as many partitions as there are cores.

    Adaptive execution merges small shuffle partitions by their size in bytes. Expanding region
    pairs or comparing frames multiplies that size afterwards, so the number is given here.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder that executors share and read on from there.

    Used between the rounds of an iteration and where a small result feeds many branches.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; on one host, and only there, a local one if none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-checkpoint-"))
