"""Token ids in training order: fixed-stride binary shards of a keyed permutation of all sequences.

1. Texts are tokenised whole with a given public vocabulary, each followed by the end token, and cut
   into sequences of ``length`` ids. A sequence goes on over the documents of one scan task; only a
   task's last one is padded. The sequences are written once, with their task and place; until
   they reach their shard they are packed with a Zstandard dictionary of a few first texts.
2. The tasks' counts, summed in order, number the sequences 0 .. n-1.
3. A Feistel network over the next power of four, keyed, is applied again to whatever it maps beyond
   n-1 (cycle-walking); so every number gets a slot of 0 .. n-1 of its own without a sort or table.
4. Rows go to the shard ``slot div shard_rows`` by number, are ordered by slot in it and are written
   as records of ``length`` little-endian ids and one closing zero id. The byte of a slot is known, so
   a reader starts or resumes anywhere.

Shards are written by Spark's own writer and committer, the closing id being its row separator; a
lost task is repeated from the written sequences. A long document is simply cut; no source or key
is gathered in one task. One row per scan task is the only thing summed in one place.

Defined cases: null and empty texts give no ids and occur in no sequence; a null doc_id stays null
in the lists; repeated rows are tokenised as often as they occur; an empty table gives no shards.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from undula.llm.common import bounded, cut_lineage, mix64, scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH = 2048
SHARD_ROWS = 4096
KEY = 0x5EED
ROUNDS = 6
#: Offsets are broadcast if no more scan tasks than this were counted.
MOST_TASKS = 1_000_000
#: Bounds of the sample that the packing dictionary is fitted on, and its size.
SAMPLE_TEXTS, SAMPLE_BYTES, DICT_BYTES = 300, 2 << 20, 110 << 10
LEVEL = 6
STAGED = "part long, pos long, n_tokens int, doc_ids array<long>, starts array<int>, tokens binary"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def id_type(ranks) -> str:
    return "<u2" if len(ranks) < 65_536 else "<u4"


def fit_dictionary(docs: DataFrame, ranks: dict, length: int) -> bytes:
    """A dictionary for packed sequences, fitted in one task on the bounded sample; b"" if that is too small."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(ranks), id_type(ranks)

    def fit(batches):
        enc, ids, left = encoder(shared.value), [], SAMPLE_BYTES
        for frame in batches:
            for text in frame["text"]:
                if len(text) <= left:
                    ids += enc.encode_ordinary(text)
                    left -= len(text)
        data, size = np.array(ids, kind).tobytes(), length * int(kind[2:])
        rows = [data[a : a + size] for a in range(0, len(data), size)]
        try:
            made = zstandard.train_dictionary(DICT_BYTES, rows, k=256, d=8).as_bytes() if len(rows) > 7 else b""
        except zstandard.ZstdError:
            made = b""
        yield pd.DataFrame({"data": [made]})

    rows = docs.filter("text is not null").select("text").limit(SAMPLE_TEXTS).coalesce(1).mapInPandas(fit, "data binary").collect()
    return bytes(rows[0]["data"]) if rows else b""


def _packing(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def tokenise(docs: DataFrame, ranks: dict, dictionary: bytes, length: int = LENGTH) -> DataFrame:
    """Sequences of each scan task: part, pos, n_tokens, doc_ids, starts (of documents in it), packed tokens."""
    shared, end, kind = docs.sparkSession.sparkContext.broadcast(ranks), len(ranks), id_type(ranks)
    names = [c.split(" ")[0] for c in STAGED.split(", ")]

    def run(batches):
        enc, part = encoder(shared.value), TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_packing(dictionary))
        pos, held, ids, starts, rows = 0, [], [], [], []

        def cut(tokens):
            nonlocal pos, ids, starts
            fill = np.full(length, end, kind)
            fill[: len(tokens)] = tokens
            rows.append((part, pos, len(tokens), ids, starts, packer.compress(fill.tobytes())))
            pos, ids, starts = pos + 1, [], []

        for frame in batches:
            for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"]):
                if not text:
                    continue
                doc_id = None if doc_id is pd.NA else int(doc_id)
                ids.append(doc_id)
                starts.append(len(held))
                held += enc.encode_ordinary(text)
                held.append(end)
                at = 0
                while len(held) - at >= length:
                    cut(held[at : at + length])
                    at += length
                    if len(held) > at:
                        ids, starts = [doc_id], [0]
                held = held[at:]
            if len(rows) >= 256:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if held:
            cut(held)
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", "text").mapInPandas(run, STAGED)


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Slots of the numbers ``x`` (0 .. n-1), or with ``back`` the numbers of slots."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def walk(v):
        left, right = v >> shift, v & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (mix64(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix64(right ^ k) & mask)
        return left << shift | right

    y = walk(x.astype(np.uint64))
    while (beyond := y >= np.uint64(n)).any():
        y[beyond] = walk(y[beyond])
    return y.astype(np.int64)


def slot_of(column, n: int, key: int):
    @F.pandas_udf("long")
    def slots(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, key))

    return slots(column)


def materialise(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, length: int = LENGTH,
                shard_rows: int = SHARD_ROWS, key: int = KEY) -> DataFrame:
    """Writes shards below ``path`` and returns their index: slot, shard, sequence, n_tokens, doc_ids, starts."""
    spark = docs.sparkSession
    ranks = load_ranks(vocabulary)
    size, dictionary = int(id_type(ranks)[2:]), fit_dictionary(docs, ranks, length)
    tokenise(docs, ranks, dictionary, length).write.option("compression", "none").parquet(f"{path}/sequences")
    staged = spark.read.parquet(f"{path}/sequences")
    counts = staged.groupBy("part").agg(F.count("*").alias("n"))
    earlier = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut_lineage(counts.select("part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")))
    n = offsets.agg(F.sum("n")).first()[0] or 0
    numbered = staged.join(bounded(offsets.drop("n"), MOST_TASKS), "part").withColumn("sequence", F.col("offset") + F.col("pos"))
    slots = numbered.withColumn("slot", slot_of(F.col("sequence"), n, key)).withColumn("shard", F.expr(f"cast(slot div {shard_rows} as int)"))

    def unpack(batches):
        packed = zstandard.ZstdDecompressor(dict_data=_packing(dictionary))
        for frame in batches:
            yield pd.DataFrame({"value": [packed.decompress(t) for t in frame["tokens"]]})

    if n:
        dealt = slots.select("shard", "slot", "tokens").repartitionById(-(-n // shard_rows), F.col("shard"))
        ids = dealt.sortWithinPartitions("slot").select("tokens").mapInPandas(unpack, "value binary")
        ids.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0" * size).text(f"{path}/shards")
    index = slots.select("slot", F.col("shard").cast("long").alias("shard"), "sequence", "n_tokens", "doc_ids", "starts")
    index.coalesce(4 * spark.sparkContext.defaultParallelism).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_slots(spark: SparkSession, path: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS,
               size: int = 2, start: int = 0, stop: int | None = None) -> DataFrame:
    """slot and tokens (bytes of ``length`` ids) of the slots start .. stop-1, from their shards only."""
    files = spark.read.format("binaryFile")
    if stop is not None:
        shards = range(start // shard_rows, max(start, stop - 1) // shard_rows + 1)
        files = files.option("pathGlobFilter", "part-{" + ",".join(f"{s:05d}" for s in shards) + "}-*")
    found = files.load(f"{path}/shards").select(
        F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("long").alias("shard"), "content"
    )

    def run(batches):
        stride = (length + 1) * size
        for frame in batches:
            for shard, data in zip(frame["shard"], frame["content"]):
                if len(data) % stride:
                    raise ValueError(f"shard {shard} has {len(data)} bytes, not a multiple of {stride}")
                slots = [shard * shard_rows + r for r in range(len(data) // stride)]
                chosen = [s for s in slots if s >= start and (stop is None or s < stop)]
                at = [(s - shard * shard_rows) * stride for s in chosen]
                yield pd.DataFrame({"slot": pd.Series(chosen, dtype="int64"), "tokens": [data[a : a + length * size] for a in at]})

    return found.mapInPandas(run, "slot long, tokens binary")


def ordered(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Materialises ``docs`` in a scratch folder and reads every slot back: its index row and tokens_sha256.

    Only the digest of the ids that were read meets the index, not the ids.
    """
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    index = materialise(docs, path, vocabulary)
    if index.isEmpty():
        return index.withColumn("tokens_sha256", F.lit(None).cast("string"))
    return index.join(read_slots(spark, path).select("slot", F.sha2("tokens", 256).alias("tokens_sha256")), "slot")
