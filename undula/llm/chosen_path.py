"""N-gram Jaccard self-join by chosen paths.

Documents are sets of hashed runs of five words; two are linked if their Jaccard similarity is at
least 0.8. Equal sets are handled once, with the number of their documents.

Candidates. A set is embedded as ``COORDINATES`` minhash tokens (coordinate, value). A run starts
with all sets in one node; at a node, one coordinate (with probability 1/4 two, so 1 / 0.8 on
average) is sampled by a hash of the path, and sets that share its token go to a common child. Sets
alone in a child are done with; a child of at most ``LEAF`` sets, or one ``DEPTH`` levels down, is
compared by brute force; others are split again. Runs are repeated until two sets at the threshold
meet with probability ``RECALL`` (``runs_needed`` follows the recursion). Sets whose tokens agree
in ``AGREE`` coordinates or more are tied; a leaf emits only a spanning forest of the ties.

Verification. Tied sets form clusters, which are disjoint; inside them every pair is compared once on
its exact sets. So a pair counts once however often it met, and pairs that never met are found
if their cluster did. Clusters and leaves of more than ``TILE`` sets are cut into tiles; a unit of
work holds two tiles at most, and emits a count and a label per set, never the pairs.

Defined cases: a document of one to four words is one run of all its words; documents without words
(null, empty) are alone and have no links; a null doc_id gets a class like any other and is never a
class id unless all of the class are null; repeated rows are copies and count as links; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm.common import attach, components, cut_lineage, fresh, mix64, row_key, word_hashes, words_of

SHINGLE = 5
#: Similarity as a fraction, 4 / 5.
ABOVE, BELOW = 4, 5
COORDINATES = 64
AGREE = 38
LEAF = 512
TILE = 512
DEPTH = 3
RECALL = 0.999
#: Rows and shingles that a unit of small leaves or clusters should hold.
UNIT_ROWS = 4_000
UNIT_SHINGLES = 1_500_000
SETS = "set string, n long, tokens binary"


def _missed(runs: int, similarity: float, depth: int) -> float:
    """Probability that two sets of that similarity are not tied after so many runs, all of which share their coordinates."""
    total = 0.0
    for agree in range(COORDINATES + 1):
        weight = math.comb(COORDINATES, agree) * similarity**agree * (1 - similarity) ** (COORDINATES - agree)
        met = 1.0
        for _ in range(depth):
            x = agree / COORDINATES * met
            met = 0.75 * x + 0.25 * (1 - (1 - x) ** 2)
        total += weight * ((1 - met) ** runs if agree >= AGREE else 1)
    return total


def runs_needed(recall: float = RECALL, similarity: float = ABOVE / BELOW, depth: int = DEPTH) -> int:
    """Runs after which two sets of that similarity have met at ``depth`` and been tied with that probability."""
    runs = 1
    while (missed := _missed(runs, similarity, depth)) > 1 - recall:
        if missed == _missed(runs + 1, similarity, depth):
            raise ValueError(f"{COORDINATES} coordinates do not reach a recall of {recall}")
        runs += 1
    return runs


def shingles(texts) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    words = [words_of(t) for t in texts]
    h = word_hashes([w for ws in words for w in ws])
    mult = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
    runs = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE if len(runs) else 0):
        runs += h[k : k + len(runs)] * mult[k]
    runs, out, at = mix64(runs), [], 0
    for ws in words:
        n = len(ws)
        if n >= SHINGLE:
            out.append(np.unique(runs[at : at + n - SHINGLE + 1]))
        elif n:
            out.append(mix64((h[at : at + n] * mult[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signature(found: np.ndarray) -> bytes:
    """The minhash value of each coordinate, 32 bits each."""
    keys = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64))
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        x = (found[None, at : at + 4096] ^ keys[:COORDINATES, None]) * (keys[COORDINATES:, None] | np.uint64(1))
        least = np.minimum(least, (x >> np.uint64(32)).min(axis=1))
    return least.astype("<u4").tobytes()


def _embed(text: pd.Series) -> pd.DataFrame:
    rows = []
    for at in range(0, len(text), 200):
        for s in shingles(text.iloc[at : at + 200].tolist()):
            rows.append((hashlib.md5(s.tobytes()).hexdigest(), len(s), signature(s)) if len(s) else (None, 0, None))
    return pd.DataFrame(rows, columns=["set", "n", "tokens"])


def _shingle_bytes(text: pd.Series) -> pd.Series:
    return pd.Series([s.tobytes() for at in range(0, len(text), 200) for s in shingles(text.iloc[at : at + 200].tolist())])


def _child(path: Column) -> Column:
    """Paths of the children that a set with column ``tokens`` goes to from the node ``path``."""
    first = F.pmod(F.xxhash64(path, F.lit("first")), F.lit(COORDINATES))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(path, F.lit("second")), F.lit(COORDINATES - 1)), F.lit(COORDINATES))
    to = lambda c: F.hex(F.xxhash64(path, c, F.substring("tokens", (c * 4 + 1).cast("int"), F.lit(4))))
    two = F.pmod(F.xxhash64(path, F.lit("number")), F.lit(4)) == 0
    return F.when(two, F.array(to(first), to(second))).otherwise(F.array(to(first)))


def _leaves(sets: DataFrame, runs: int) -> DataFrame:
    """set, path, size: the members of every node that is compared by brute force."""
    roots = F.array(*[F.hex(F.xxhash64(F.lit("run"), F.lit(r))) for r in range(runs)])
    level = sets.select("set", F.explode(F.flatten(F.transform(roots, _child))).alias("path"))
    leaves = None
    for depth in range(1, DEPTH + 1):
        sizes = cut_lineage(level.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1"))
        level = cut_lineage(attach(level, sizes, "path", "size").filter("size is not null"))
        small = level if depth == DEPTH else level.filter(F.col("size") <= LEAF)
        leaves = small if leaves is None else leaves.union(small)
        if depth == DEPTH or level.filter(F.col("size") > LEAF).isEmpty():
            return leaves
        large = level.filter(F.col("size") > LEAF).select("set", "path").join(sets.select("set", "tokens"), "set")
        level = large.select("set", F.explode(_child(F.col("path"))).alias("path"))
    return leaves


def _tiled(rows: DataFrame, group: str, size: str, bins: int) -> DataFrame:
    """``rows`` with unit, lo, hi, tile: groups up to TILE go whole to a bin, others as pairs of tiles."""
    tiles = F.ceil(F.col(size) / TILE)
    tile = F.when(tiles > 1, F.pmod(F.xxhash64("set"), tiles)).otherwise(F.lit(0)).cast("long")
    partners = F.when(tiles > 1, F.sequence(F.lit(0).cast("long"), tiles - 1)).otherwise(F.array(F.lit(0).cast("long")))
    out = rows.withColumn("tile", tile).withColumn("tiles", tiles).withColumn("other", F.explode(partners))
    out = out.withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other"))
    unit = F.when(F.col("tiles") > 1, F.xxhash64(group, "lo", "hi")).otherwise(F.pmod(F.xxhash64(group), F.lit(bins)))
    return out.withColumn("unit", unit).drop("other", "tiles", size)


def _labels(near: np.ndarray) -> np.ndarray:
    """The smallest place in the connected component of each place; ``near`` is symmetric."""
    labels = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        least = np.where(near, labels[None, :], len(labels)).min(axis=1)
        least = least[least]
        if (least == labels).all():
            return labels
        labels = least


def _same_tile(part: pd.DataFrame) -> np.ndarray | None:
    """Pairs that another unit compares: both of one tile where the unit has two."""
    if part["lo"].iloc[0] == part["hi"].iloc[0]:
        return None
    tile = part["tile"].to_numpy()
    return tile[:, None] == tile[None, :]


def _ties(frame: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the tied sets of each leaf in the unit."""
    out = []
    for _, part in frame.sort_values("set").groupby(["path", "lo", "hi"], sort=False):
        part = part.drop_duplicates("set")
        tokens = np.frombuffer(b"".join(part["tokens"]), "<u4").reshape(len(part), COORDINATES)
        agree = np.zeros((len(part), len(part)), np.int16)
        for c in range(COORDINATES):
            agree += tokens[:, c, None] == tokens[None, :, c]
        near = agree >= AGREE
        if (apart := _same_tile(part)) is not None:
            near &= ~apart
        labels, names = _labels(near), part["set"].to_numpy()
        moved = labels != np.arange(len(labels))
        out += zip(names[moved], names[labels[moved]])
    return pd.DataFrame(out, columns=["a", "b"])


def shared_counts(found: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of all pairs of sorted distinct arrays."""
    lengths = np.array([len(f) for f in found])
    values, column, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(found)), lengths)
    common = np.cumsum(times > 1) - 1
    use = times[column] > 1
    row, column = row[use], common[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros((len(found), len(found)), np.float64), max(64, (8 << 20) // max(1, len(found)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        dense = np.zeros((len(found), min(width, int(column[-1]) + 1 - at)), np.float32)
        dense[row[a:b], column[a:b] - at] = 1
        out += dense @ dense.T
    return np.rint(out).astype(np.int64)


def _verify(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of each set with the others of its cluster in the unit: set, label, sets, docs."""
    out = []
    for _, part in frame.sort_values("set").groupby(["root", "lo", "hi"], sort=False):
        part = part.drop_duplicates("set")
        found = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
        n = np.array([len(f) for f in found])
        linked = (ABOVE + BELOW) * shared_counts(found) >= ABOVE * (n[:, None] + n[None, :])
        np.fill_diagonal(linked, False)
        if (apart := _same_tile(part)) is not None:
            linked &= ~apart
        names, copies = part["set"].to_numpy(), part["copies"].to_numpy()
        out += zip(names, names[_labels(linked)], linked.sum(axis=1), linked @ copies)
    return pd.DataFrame(out, columns=["set", "label", "sets", "docs"])


def candidate_clusters(sets: DataFrame, recall: float = RECALL) -> DataFrame:
    """set, root of all sets that are tied to another one."""
    leaves = cut_lineage(_leaves(sets, runs_needed(recall)))
    bins = max(1, math.ceil(leaves.count() / UNIT_ROWS))
    units = _tiled(leaves.join(sets.select("set", "tokens"), "set"), "path", "size", bins)
    ties = units.groupBy("unit").applyInPandas(_ties, "a string, b string")
    return components(ties).select(F.col("node").alias("set"), "root")


def verified(docs: DataFrame, named: DataFrame, sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """set, root, sets, docs: components and numbers of links over the exact similarities."""
    sizes = cut_lineage(clusters.groupBy("root").agg(F.count("*").alias("size")))
    placed = attach(clusters, sizes, "root", "size").join(sets.select("set", "n", "copies"), "set")
    one = named.filter("set is not null").groupBy("set").agg(F.min("key").alias("key"))
    wanted = cut_lineage(placed.join(one, "set"))
    bins = max(1, math.ceil((wanted.agg(F.sum("n")).first()[0] or 0) / UNIT_SHINGLES))
    texts = docs.select(row_key("doc_id", "text").alias("key"), "text").join(wanted.drop("n"), "key")
    whole = texts.select("set", "root", "size", "copies", F.pandas_udf(_shingle_bytes, "binary").asNondeterministic()("text").alias("shingles"))
    units = _tiled(whole, "root", "size", bins)
    found = cut_lineage(units.groupBy("unit").applyInPandas(_verify, "set string, label string, sets long, docs long"))
    counts = found.groupBy("set").agg(F.sum("sets").alias("sets"), F.sum("docs").alias("docs")).filter("sets > 0")
    classes = components(found.select(F.col("set").alias("a"), F.col("label").alias("b")))
    return counts.join(classes.withColumnRenamed("node", "set"), "set")


def _joined(docs: DataFrame, recall: float) -> DataFrame:
    """key, doc_id, class_id, class_key (of the first document), n_links, class_size."""
    named = docs.select("doc_id", row_key("doc_id", "text").alias("key"), F.pandas_udf(_embed, SETS).asNondeterministic()("text").alias("e"))
    named = cut_lineage(named.select("doc_id", "key", "e.*"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    sets = cut_lineage(named.filter("set is not null").groupBy("set").agg(
        F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.count("*").alias("copies"), first.alias("first")
    ))
    links = cut_lineage(verified(docs, named, sets, candidate_clusters(sets, recall)))
    full = sets.drop("n", "tokens").join(links, "set", "left").filter("copies > 1 or root is not null")
    full = cut_lineage(full.select("set", "copies", "first", F.coalesce("root", "set").alias("root"), F.coalesce("docs", F.lit(0)).alias("docs")))
    classes = full.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("members"), F.sum("copies").alias("class_size"))
    facts = cut_lineage(attach(full.drop("first"), cut_lineage(classes), "root", "members").select(
        "set", "copies", "head", "class_size", (F.col("copies") - 1 + F.col("docs")).alias("links")
    ))
    found = attach(named.select("doc_id", "key", "set"), facts, "set", "copies")
    alone = F.col("head").isNull()
    return found.select(
        "key", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(alone, F.col("key")).otherwise(F.col("head.key")).alias("class_key"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def jaccard_join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (its smallest doc_id), n_links, class_size."""
    return _joined(docs, recall).select("doc_id", "class_id", "n_links", "class_size")


def keep_one_of_each(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The first document of each class, by doc_id; all columns as they were.

    Of rows that are equal in doc_id and text one stays.
    """
    classes = _joined(docs, recall).filter(F.col("key") == F.col("class_key"))
    name = fresh(docs, "key")
    kept = classes.select(F.col("key").alias(name)).distinct()
    rows = docs.withColumn(name, row_key("doc_id", "text")).join(kept, name).dropDuplicates([name])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
