"""Shared pieces of the corpus operators: scratch folders, skew-safe lookups, components, word kernels."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.functions.partitioning import ensure_checkpoint_dir

#: A key with fewer rows than this is left to an ordinary shuffle join.
HEAVY_ROWS = 5_000
#: At most so many keys are broadcast by ``attach``.
HEAVY_KEYS = 50_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, in no more files than keep all cores busy.

    Adaptive execution may leave a small result in very many partitions, each of which would become
    a file; the tasks take several of them instead.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism).checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in a scratch folder: cut from its lineage, and smaller than a checkpoint where values repeat."""
    path = scratch(df.sparkSession, name)
    df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    out = f"__{name}"
    while out.lower() in {c.lower() for c in df.columns}:
        out += "_"
    return out


def row_key(*cols: str) -> Column:
    """128 bits that tell rows apart by the named columns; rows equal in all of them share it."""
    given = [F.col(c) for c in cols] + [F.isnull(c) for c in cols]
    return F.concat(F.hex(F.xxhash64(*given)), F.hex(F.xxhash64(F.lit("second"), *given)))


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of ``rows`` with ``facts``, which has one row per non-null ``key``.

    ``facts[weight]`` is the number of ``rows`` with that key. Keys with many rows are joined by
    broadcast, so that they stay where they are; as each of them has at least total / HEAVY_KEYS
    rows, there are at most HEAVY_KEYS of them. The rest is an ordinary join in which no key is
    large. ``facts`` is read three times and should be cut from its lineage.
    """
    names = [c for c in facts.columns if c != key]
    total = facts.agg(F.sum(weight)).first()[0] or 0
    bound = max(HEAVY_ROWS, total // HEAVY_KEYS)
    heavy = facts.filter(F.col(weight) >= bound).select(
        F.col(key).alias("__heavy"), *[F.col(c).alias(f"__heavy_{c}") for c in names]
    )
    light = facts.filter(F.col(weight) < bound).select(F.col(key).alias("__light"), *names)
    near = rows.join(F.broadcast(heavy), F.col(key) == F.col("__heavy"), "left")
    hashable = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind]
    # Rows that are served already, or have no key, are dealt out evenly instead of by their key.
    own = F.when(F.col("__heavy").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(
        F.concat(F.lit("~"), F.hex(F.xxhash64(*hashable))).cast(dict(rows.dtypes)[key])
    )
    joined = near.withColumn("__own", own).join(light, F.col("__own") == F.col("__light"), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        *[F.coalesce(F.col(f"__heavy_{c}"), F.col(c)).alias(c) for c in names],
    )


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a, b) as (node, root), the root being the smallest node.

    Alternates between tying each node's larger neighbours and its smaller neighbours to the
    smallest one. Only minima are aggregated, so a node with very many neighbours costs its task no
    memory. Raises if ``rounds`` do not suffice (about the square of the logarithm of the longest
    path is needed).
    """
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    before = None
    for _ in range(rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == state:
            found = nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
            return found.select("node", F.coalesce("root", "node").alias("root"))
        before = state
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tied = cut_lineage(larger.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        least = tied.groupBy("a").agg(F.min("b").alias("m"))
        smaller = tied.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(smaller.union(least.select("a", "m")).distinct())
    raise RuntimeError(f"components are still growing after {rounds} rounds")


def _word_bytes() -> bytes:
    """Maps UTF-8 bytes: A-Z to a-z, other ASCII than letters and digits to a space."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 0x20
    return bytes(table)


WORD_BYTES = _word_bytes()


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    if not words:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    starts = np.zeros(len(words), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    top = int(lengths.max())
    powers = np.ones(top, np.uint64)
    np.cumprod(np.full(top - 1, 0x9E3779B97F4A7C15, np.uint64), out=powers[1:])
    letters = mix64(np.arange(1, 257, dtype=np.uint64))
    return mix64(np.add.reduceat(letters[data] * powers[place], starts) + lengths.astype(np.uint64))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc_part(column: str, parts: int) -> Column:
    """crc32 of a number's decimal text, modulo ``parts``; null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts))
