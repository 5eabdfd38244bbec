"""Exact deduplication with cuckoo filters over live digests.

Texts are equal when identical after lower-casing A-Z. Digests (SHA-256 of the normalised UTF-8
text) are dealt to buckets. A bucket keeps a cuckoo filter of its live digests and, as its content,
the digests themselves with the largest doc_id and the number of documents. A lookup that misses in
the filter is new for certain; a hit is verified against the content. Digests leave the filter when
their last document is deleted. A filter that overflows is built again at twice its size from the
stored digests, so nothing is ever refused.

``deduplicate`` streams all digests of a bucket through such an index; ``build_index`` stores the
indexes as rows and ``update_index`` inserts into and deletes from them. Which document is the largest
live one after a deletion is read from the table of ``members`` (digest, doc_id, copies), of which only
the digests that change are looked up; a hot digest is many rows there and never one list.

Hot groups: each task sums equal digests of a batch before they are shuffled, and the decisions
return to the documents by ``common.attach``, which leaves hot digests where they are.

Defined cases: a null text counts as empty; a null doc_id is smaller than any other; rows equal in
text and doc_id are all kept if their doc_id is the largest one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from array import array

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import attach, cut_lineage

SLOTS = 4
MAX_KICKS = 200
#: Digests that one bucket of an index should hold.
BUCKET_DIGESTS = 100_000


class CuckooFilter:
    """16-bit fingerprints of 32-byte digests in buckets of four, two candidate buckets each."""

    def __init__(self, capacity: int = 64):
        self.size = 1 << max(4, math.ceil(math.log2(max(1, capacity) / (SLOTS * 0.8))))
        self.table: list[list[int]] = [[] for _ in range(self.size)]
        self.state = 1

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[2:10], "big") & (self.size - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & (self.size - 1)

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.table[a] or mark in self.table[b]

    def insert(self, digest: bytes) -> bool:
        """False if no place was found; the filter must then be built anew at a larger size."""
        mark, a, b = self._places(digest)
        for place in (a, b):
            if len(self.table[place]) < SLOTS:
                self.table[place].append(mark)
                return True
        place = a
        for _ in range(MAX_KICKS):
            self.state = (self.state * 1103515245 + 12345) & 0x7FFFFFFF
            slot = (self.state >> 16) % SLOTS
            mark, self.table[place][slot] = self.table[place][slot], mark
            place = self._other(place, mark)
            if len(self.table[place]) < SLOTS:
                self.table[place].append(mark)
                return True
        return False

    def delete(self, digest: bytes) -> None:
        mark, a, b = self._places(digest)
        self.table[a if mark in self.table[a] else b].remove(mark)


class LiveIndex:
    """A cuckoo filter in front of the bucket's content: digest -> [largest doc_id, documents]."""

    def __init__(self, expected: int = 64):
        self.filter, self.content, self.false_hits, self.resizes = CuckooFilter(expected), {}, 0, 0

    def insert(self, digest: bytes, doc_id, copies: int) -> None:
        if digest in self.filter:
            live = self.content.get(digest)
            if live is not None:
                live[0] = doc_id if live[0] is None else live[0] if doc_id is None else max(live[0], doc_id)
                live[1] += copies
                return
            self.false_hits += 1
        self.content[digest] = [doc_id, copies]
        if not self.filter.insert(digest):
            self._grow()

    def delete(self, digest: bytes, copies: int) -> None:
        """Takes ``copies`` documents of a text away; the digest goes with the last one."""
        if digest not in self.filter or digest not in self.content:
            return
        live = self.content[digest]
        live[1] -= copies
        if live[1] <= 0:
            del self.content[digest]
            self.filter.delete(digest)

    def put(self, digest: bytes, doc_id, copies: int) -> None:
        """What is live of a text now: its largest doc_id and its documents, none to forget it."""
        if copies <= 0:
            if digest in self.content:
                self.delete(digest, self.content[digest][1])
        elif digest in self.content:
            self.content[digest] = [doc_id, copies]
        else:
            self.insert(digest, doc_id, copies)

    def _grow(self) -> None:
        size = self.filter.size
        while True:
            self.resizes += 1
            size *= 2
            self.filter = CuckooFilter(1)
            self.filter.size, self.filter.table = size, [[] for _ in range(size)]
            if all(self.filter.insert(d) for d in self.content):
                return


def _digest(text: pd.Series) -> pd.Series:
    # bytes.lower changes ASCII letters only.
    return text.map(lambda t: hashlib.sha256((t or "").encode("utf-8", "surrogatepass").lower()).digest())


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.pandas_udf(_digest, "binary")("text").alias("digest"))


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    if frame.empty:
        return frame.assign(copies=pd.Series(dtype="int64"))
    return frame.groupby("digest", sort=False, as_index=False).agg(doc_id=("doc_id", "max"), copies=("doc_id", "size"))


def _pre_aggregate(batches):
    for frame in batches:
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield _summed(frame)[["digest", "doc_id", "copies"]]


def _bucketed(keys: DataFrame, buckets: int) -> DataFrame:
    partial = keys.mapInPandas(_pre_aggregate, "digest binary, doc_id long, copies long")
    return partial.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def _bucket_count(keys: DataFrame) -> int:
    return max(1, math.ceil(keys.count() / BUCKET_DIGESTS))


def _fill(index: LiveIndex, frame: pd.DataFrame) -> LiveIndex:
    ids = frame["doc_id"].astype("Int64")
    for digest, doc_id, copies in zip(frame["digest"], ids, frame["copies"]):
        index.insert(digest, None if doc_id is pd.NA else int(doc_id), int(copies))
    return index


def _rows(index: LiveIndex) -> pd.DataFrame:
    rows = [(d, i, n) for d, (i, n) in index.content.items()]
    frame = pd.DataFrame(rows, columns=["digest", "keep_id", "group_size"])
    return frame.astype({"keep_id": "Int64", "group_size": "int64"})


def live_digests(keys: DataFrame) -> DataFrame:
    """digest, keep_id, group_size of each distinct digest, found by one index per bucket."""
    buckets = _bucket_count(keys)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _rows(_fill(LiveIndex(len(frame)), frame))

    return _bucketed(keys, buckets).groupBy("bucket").applyInPandas(run, "digest binary, keep_id long, group_size long")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest."""
    keys = cut_lineage(digests(docs))
    groups = cut_lineage(live_digests(keys).filter("group_size > 1"))
    joined = attach(keys, groups, "digest", "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "digest")


INDEX = "bucket long, buckets long, filter binary, digests long, false_hits long, resizes long"


def _stored(bucket: int, buckets: int, index: LiveIndex) -> pd.DataFrame:
    # Marks are never 0, which stands for a free slot.
    marks = array("H", [m for place in index.filter.table for m in (place + [0] * SLOTS)[:SLOTS]]).tobytes()
    state = pickle.dumps((index.filter.size, marks, index.filter.state, index.content))
    return pd.DataFrame([(bucket, buckets, state, len(index.content), index.false_hits, index.resizes)],
                        columns=["bucket", "buckets", "filter", "digests", "false_hits", "resizes"])


def _loaded(row) -> LiveIndex:
    index = LiveIndex()
    index.filter.size, marks, index.filter.state, index.content = pickle.loads(row["filter"])
    slots = array("H", marks).tolist()
    index.filter.table = [[m for m in slots[k : k + SLOTS] if m] for k in range(0, len(slots), SLOTS)]
    return index


def build_index(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Indexes of all documents, one row per non-empty bucket."""
    keys = cut_lineage(digests(docs))
    buckets = buckets or _bucket_count(keys)

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        return _stored(key[0], buckets, _fill(LiveIndex(len(frame)), frame))

    return _bucketed(keys, buckets).groupBy("bucket").applyInPandas(run, INDEX)


def members(docs: DataFrame) -> DataFrame:
    """digest, doc_id, copies of all documents: what is live, to be kept beside an index that deletes."""
    return digests(docs).groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))


def changed_members(live: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """``live`` after inserting and deleting the given documents."""
    gone = members(deletes).withColumn("copies", -F.col("copies"))
    every = live.unionByName(members(inserts)).unionByName(gone)
    return every.groupBy("digest", "doc_id").agg(F.sum("copies").alias("copies")).filter("copies > 0")


def update_index(index: DataFrame, inserts: DataFrame, deletes: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """The stored indexes after inserting and then deleting the given documents.

    ``live`` are the members before the change; with them the largest live doc_id of each text is right
    after any deletion. Without them a deleted document must have been inserted, and the largest doc_id of a text that loses documents
    stays on record until its last document goes. ``index`` is read twice.
    """
    buckets = (index.agg(F.max("buckets")).first()[0]) or 1
    if live is not None:
        touched = digests(inserts).select("digest").union(digests(deletes).select("digest")).distinct()
        after = changed_members(live.join(touched, "digest", "left_semi"), inserts, deletes)
        now = after.groupBy("digest").agg(F.max("doc_id").alias("doc_id"), F.sum("copies").alias("copies"))
        change = touched.join(now, "digest", "left").select("digest", "doc_id", F.coalesce("copies", F.lit(0)).alias("copies"))
        change = change.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))

        def replace(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            held = _loaded(old.iloc[0]) if len(old) else LiveIndex(len(new))
            for digest, doc_id, copies in zip(new["digest"], new["doc_id"].astype("Int64"), new["copies"]):
                held.put(digest, None if doc_id is pd.NA else int(doc_id), int(copies))
            return _stored(key[0], buckets, held)

        return index.groupBy("bucket").cogroup(change.groupBy("bucket")).applyInPandas(replace, INDEX)
    change = _bucketed(digests(inserts), buckets).withColumn("sign", F.lit(1)).union(
        _bucketed(digests(deletes), buckets).withColumn("sign", F.lit(-1))
    )

    def run(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        held = _loaded(old.iloc[0]) if len(old) else LiveIndex(len(new))
        _fill(held, new[new["sign"] > 0])
        for digest, copies in zip(new["digest"][new["sign"] < 0], new["copies"][new["sign"] < 0]):
            held.delete(digest, int(copies))
        return _stored(key[0], buckets, held)

    return index.groupBy("bucket").cogroup(change.groupBy("bucket")).applyInPandas(run, INDEX)
