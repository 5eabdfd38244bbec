"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

Each text is cut at seeds: of every ``window`` consecutive words, the run of ``SEED`` words with the
smallest hash. What lies from one seed to the end of the next is a block; the first one starts with the
text, the last one ends with it. The reference of a seed is its block in the row that comes first by
(doc_id, row, place); the index maps seeds to those blocks, by shuffle. A text is parsed by going from block to block: as long as its own block equals the
reference block, and that one continues the last one in the same reference text, the factor grows. A
factor of at least ``window`` words of a smaller doc_id is a duplicate span.

Factors end where the first holder of a seed ends or differs, although another document may go on.
Windows that contain an indexed seed but lie in no such factor are therefore checked at the factor
boundaries: where at least one later document has open windows of a seed, all open windows of that seed
are compared by 128-bit hashes and the smallest doc_id of each is found. A window
is always held by the seed that is smallest in it, in whichever text it occurs, so equal windows meet. The first holder
of a window is never inside a factor, so what is found equals a comparison of all windows.

A first aggregation, which carries a seed and two ids, finds the seeds of several documents. A sieve
of them (a bitmap of at most ``MOST_BITS``, so its broadcast is bounded) then spares the shuffle of most
other blocks, and a sieve of rows that of most texts without repeats; what passes by chance is dropped
by the joins, and a full sieve would only let all pass. Frequent
seeds and windows are joined by ``common.attach`` without gathering their rows; what is collected
per row is bounded by its own words. Blocks are compared by 128 bits.

Defined cases: words are runs of characters other than space and ``\\x09-\\x0D``, unchanged; null and
empty texts have no words and give an empty text; a text with fewer words than a window stays; a null
doc_id is neither smaller nor larger than any other, so such a row stays whole and makes nothing go;
rows with the same doc_id do not make each other go; repeated rows are treated alike; an empty table
gives no rows. A very long text is one array of word hashes, 16 bytes a word. Other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.llm.common import attach, cut_lineage, mix64, stored

WINDOW = 50
SEED = 25
ROOTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
#: Bits of a sieve, 8 MB.
MOST_BITS = 1 << 26
#: Characters of text whose words are worked off together.
CHUNK = 4 << 20


def _byte_table() -> bytes:
    found = bytearray(range(256))
    for b in b"\t\n\x0b\x0c\r":
        found[b] = 0x20
    return bytes(found)


BYTES = _byte_table()


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and tab to carriage return."""
    return [w for w in text.encode("utf-8", "surrogatepass").translate(BYTES).split(b" ") if w] if text else []


def inverse(x: np.uint64) -> np.uint64:
    """Of an odd number, modulo 2 ** 64."""
    return np.uint64(pow(int(x), -1, 1 << 64))


def powers(root: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, root, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Ranges:
    """Hashes of ranges of words that do not depend on where the range lies."""

    def __init__(self, words: np.ndarray, root: np.uint64):
        n = len(words)
        up = powers(root, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n], dtype=np.uint64)])
        self.down = powers(inverse(root), n)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


def letters(salt: np.uint64) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * salt)


LETTERS = tuple(letters(r) for r in ROOTS)


class Texts:
    """The words of several texts on end: ``owner`` of each, ``offset`` of each text, and one or two hashes of each word."""

    def __init__(self, texts, both: bool = False):
        split = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        self.owner = np.repeat(np.arange(len(split)), counts)
        self.offset = np.cumsum(counts) - counts
        words = [w for ws in split for w in ws]
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        self.hashes = []
        for root, table in list(zip(ROOTS, LETTERS))[: 1 + both]:
            up = powers(root, int(lengths.max(initial=0)))
            sums = np.add.reduceat(table[data] * up[place], starts) if n else np.zeros(0, np.uint64)
            self.hashes.append(mix64(sums + lengths.astype(np.uint64)))

    def ranges(self) -> list[Ranges]:
        return [Ranges(h, root) for h, root in zip(self.hashes, ROOTS)]


def parts(frames):
    """The rows of ``frames`` in groups of about ``CHUNK`` characters of text, or one longer text."""
    for frame in frames:
        size = frame["text"].str.len().fillna(0).to_numpy(np.int64)
        group = (np.cumsum(size) - size) // CHUNK
        for lo in np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(frame) else ():
            yield frame.iloc[lo : lo + int((group == group[lo]).sum())]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of each ``width`` consecutive values, the first of equal ones."""
    best, size = np.arange(len(x)), 1
    while size < width:
        step = min(size, width - size)
        a, b = best[: len(best) - step], best[step:]
        best, size = np.where(x[b] < x[a], b, a), size + step
    return best


def seeds(words: np.ndarray, owner: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """pos, hash, lo, hi of each seed: where it starts, and the first and last window that it holds."""
    n = len(words) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    starts = np.arange(len(words) - seed + 1)
    grams = Ranges(words, ROOTS[0]).of(starts, starts + seed)
    at = np.flatnonzero(owner[:n] == owner[window - 1 :])
    holder = sliding_least(grams, window - seed + 1)[at]
    first = np.flatnonzero(np.r_[True, holder[1:] != holder[:-1]]) if len(at) else at
    pos = holder[first]
    return pos, grams[pos], at[first], at[np.r_[first[1:], len(at)] - 1] if len(at) else at


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, row; a hash of 64 bits is enough to tell rows of the same doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row"))


def seed_ids(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """seed, doc_id: each seed once per document."""

    def find(frames):
        for part in parts(frames):
            texts = Texts(part["text"])
            pos, found, _, _ = seeds(texts.hashes[0], texts.owner, window, seed)
            yield pd.DataFrame({"seed": _signed(found), "doc_id": part["doc_id"].to_numpy()[texts.owner[pos]]}).drop_duplicates()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(find, "seed long, doc_id long")


def sieve(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(word, bits) of a bitmap over the low bits of a hash, and its size in bits."""
    size = min(MOST_BITS, max(1 << 10, 1 << (16 * keys.count()).bit_length()))
    place = keys.select(F.pmod(F.col(key), F.lit(size)).alias("place"))
    bit = F.expr("shiftleft(1L, CAST(pmod(place, 64L) AS INT))")
    return cut_lineage(place.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))), size


def bitmap(words: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size // 64, np.uint64)
    rows = words.toPandas()
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def sifted(rows: DataFrame, words: DataFrame, size: int, key: str) -> DataFrame:
    """``rows`` with a column ``maybe``: whether ``key`` passes the sieve."""
    place = F.pmod(F.col(key), F.lit(size))
    met = rows.withColumn("place", place).join(F.broadcast(words), F.shiftright("place", 6) == F.col("word"), "left")
    hit = F.expr("shiftright(bits, CAST(pmod(place, 64L) AS INT)) & 1L") == 1
    return met.withColumn("maybe", F.coalesce(hit, F.lit(False))).select(*rows.columns, "maybe")


BLOCK = "row long, doc_id long, name binary, idx int, pos int, lo int, hi int, last int, block long, block2 long"


def _names(*hashes: np.ndarray) -> list[bytes]:
    """The bytes of one or more hashes per row."""
    data = np.ascontiguousarray(np.stack(hashes, axis=1)).tobytes()
    width = 8 * len(hashes)
    return [data[k : k + width] for k in range(0, len(data), width)]


def blocks(docs: DataFrame, window: int, seed: int, bits) -> DataFrame:
    """A row per seed that passes ``bits``: its name, its windows [lo, hi] and its block [pos, last) of words."""

    def find(frames):
        for part in parts(frames):
            texts = Texts(part["text"], both=True)
            pos, found, lo, hi = seeds(texts.hashes[0], texts.owner, window, seed)
            if not len(pos):
                continue
            owner = texts.owner[pos]
            head = np.r_[True, owner[1:] != owner[:-1]]
            first = np.maximum.accumulate(np.where(head, np.arange(len(pos)), 0))
            offset = texts.offset[owner]
            ends = np.r_[texts.offset[1:], len(texts.owner)][owner]
            last = np.where(np.r_[head[1:], True], ends, np.roll(pos, -1) + seed)
            begin = np.where(head, offset, pos)
            one, two = (r.of(begin, last) for r in texts.ranges())
            kept = passes(bits.value, found)
            yield pd.DataFrame({
                "row": part["row"].to_numpy()[owner[kept]], "doc_id": part["doc_id"].to_numpy()[owner[kept]], "name": _names(found[kept]),
                "idx": (np.arange(len(pos)) - first)[kept], "pos": (begin - offset)[kept], "lo": (lo - offset)[kept], "hi": (hi - offset)[kept],
                "last": (last - offset)[kept], "block": _signed(one[kept]), "block2": _signed(two[kept]),
            })

    return keyed(docs).mapInPandas(find, BLOCK)


def indexed(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """The blocks whose seed is in several documents: whether each is ``same`` as the reference block of its seed, and where that lies."""
    held = docs.filter("doc_id IS NOT NULL")
    ids = seed_ids(held, window, seed).groupBy("seed").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    words, size = sieve(cut_lineage(ids.filter("least < most").select("seed")), "seed")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(words, size))
    every = stored(blocks(held, window, seed, bits), "lz-blocks")
    # A frequent seed is one row per task here.
    block = F.struct("doc_id", "row", "pos", "last", "block", "block2")
    index = every.groupBy("name").agg(F.min(block).alias("ref"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    index = stored(index.filter("ref.doc_id < most").select("name", "ref", "n"), "lz-index")
    found = attach(every, index, "name", "n").filter("ref IS NOT NULL")
    same = (F.col("ref.doc_id") < F.col("doc_id")) & (F.col("block") == F.col("ref.block")) & (F.col("block2") == F.col("ref.block2"))
    same = same & (F.col("last") - F.col("pos") == F.col("ref.last") - F.col("ref.pos"))
    return found.select("row", "doc_id", "name", "idx", "pos", "lo", "hi", "last", same.alias("same"), F.col("ref.doc_id").alias("least"),
                        F.col("ref.row").alias("ref_row"), (F.col("ref.pos") - F.col("pos")).alias("shift"))


def parsed(found: DataFrame) -> DataFrame:
    """``found`` with the factor [start, end) in words that each block belongs to, null where it equals no reference block."""
    order = Window.partitionBy("row", "doc_id").orderBy("idx")
    before = lambda c: F.lag(c).over(order)
    goes_on = before("same") & F.col("same") & (before("idx") + 1 == F.col("idx"))
    for c in ("shift", "ref_row", "least"):
        goes_on = goes_on & (before(c) == F.col(c))
    rows = found.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("factor", F.sum("new").over(order))
    whole = Window.partitionBy("row", "doc_id", "factor")
    start, end = F.min("pos").over(whole), F.max("last").over(whole)
    return rows.select("row", "doc_id", "name", "least", "lo", "hi", F.when(F.col("same"), start).alias("start"), F.when(F.col("same"), end).alias("end"))


def open_ranges(parses: DataFrame, window: int) -> DataFrame:
    """row, doc_id, ranges (array of lo, hi): windows to be checked, those of seeds that a later document leaves open."""
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    short = F.col("start").isNull() | (F.col("end") - F.col("start") < window)
    ends = F.array(span(lo, F.least(hi, F.col("start") - 1)), span(F.greatest(lo, F.least(hi, F.col("start") - 1) + 1, F.col("end") - window + 1), hi))
    left = F.filter(F.when(short, F.array(span(lo, hi))).otherwise(ends), lambda r: r["lo"] <= r["hi"])
    rows = parses.select("row", "doc_id", "least", "name", F.inline(left))
    wanted = rows.groupBy("name").agg(F.count("*").alias("n"), F.max((F.col("least") < F.col("doc_id")).cast("int")).alias("open"))
    wanted = cut_lineage(wanted.filter("open = 1"))
    found = attach(rows.drop("least"), wanted, "name", "n").filter("open = 1")
    return found.groupBy("row", "doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def checked(docs: DataFrame, ranges: DataFrame, window: int) -> DataFrame:
    """row, doc_id, lo, hi: spans of windows that also start in a smaller doc_id, among those of ``ranges``."""

    def find(frames):
        for part in parts(frames):
            texts = Texts(part["text"], both=True)
            at = [np.unique(np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in spans])) for spans in part["ranges"]]
            owner = np.repeat(np.arange(len(at)), [len(a) for a in at])
            at = np.concatenate(at)
            whole = at + texts.offset[owner]
            names = _names(*(r.of(whole, whole + window) for r in texts.ranges()))
            yield pd.DataFrame({"row": part["row"].to_numpy()[owner], "doc_id": part["doc_id"].to_numpy()[owner], "at": at, "name": names})

    likely = sifted(keyed(docs), *sieve(ranges, "row"), "row").filter("maybe").drop("maybe")
    every = stored(likely.join(ranges, ["row", "doc_id"]).mapInPandas(find, "row long, doc_id long, at int, name binary"), "lz-windows")
    least = every.groupBy("name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).filter("least < most")
    found = attach(every, stored(least.drop("most"), "lz-least"), "name", "n").filter("least < doc_id")
    return found.select("row", "doc_id", F.col("at").alias("lo"), (F.col("at") + window).alias("hi"))


def duplicate_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """row, doc_id, spans (array of lo, hi in words): what each text repeats of smaller doc_ids; pieces may overlap."""
    parses = stored(parsed(indexed(docs, window, seed)), "lz-parses")
    long = parses.filter(F.col("end") - F.col("start") >= window).select("row", "doc_id", F.col("start").alias("lo"), F.col("end").alias("hi"))
    rest = checked(docs, stored(open_ranges(parses, window), "lz-ranges"), window)
    return long.unionByName(rest).groupBy("row", "doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


KEPT = "n_words long, n_removed long, text string, spans array<struct<lo:int,hi:int>>"


def _kept(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for t, s in zip(text, spans):
        words = words_of(t)
        merged: list[list[int]] = []
        for lo, hi in sorted((r["lo"], r["hi"]) for r in s) if s is not None else ():
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(hi, merged[-1][1])
            else:
                merged.append([lo, hi])
        n = len(words)
        for lo, hi in reversed(merged):
            del words[lo:hi]
        out.append((n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass"), [{"lo": lo, "hi": hi} for lo, hi in merged]))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "text", "spans"])


def deduplicate_passages(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, text (kept words joined by a space), spans (words removed)."""
    if not 0 < seed <= window:
        raise ValueError("a seed has at least one word and no more than a window")
    spans = stored(duplicate_spans(docs.select("doc_id", "text"), window, seed), "lz-spans")
    rows = sifted(keyed(docs), *sieve(spans, "row"), "row")
    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    likely = rows.filter("maybe").select("doc_id", "text", "row").join(spans, ["row", "doc_id"], "left").select("doc_id", "text", "spans")
    whole = likely.unionByName(rows.filter("NOT maybe").select("doc_id", "text", none))
    # Not to be evaluated once for each of its fields.
    kept = F.pandas_udf(_kept, KEPT).asNondeterministic()
    return whole.select("doc_id", kept(F.col("text"), F.col("spans")).alias("kept")).select("doc_id", "kept.*")
