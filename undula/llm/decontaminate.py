"""Benchmark decontamination with an Aho-Corasick automaton over normalised test items.

A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one
window. A document word is hit if it lies inside an occurrence of a window.

Each run of ``window`` words contains a whole chunk of ``window // 2 + 1`` words that starts at a
multiple of that length in its item. The automaton therefore holds the disjoint chunks of every item
(about one node per character) and each hit is widened over the item's words to the longest run;
runs of ``window`` words and more are exactly the occurrences. Each text is scanned once per block.

Defined cases: null and empty texts have no words and no hits; items without words never match; an
item without id marks words but is not listed; rows with the same item_id count as one item; an
empty benchmark hits nothing. Repeated documents are judged one by one.
"""

from __future__ import annotations

import math
import re
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm.common import cut_lineage, fresh, words_of

WINDOW = 13
#: Benchmark text per automaton; a larger benchmark is worked off in blocks of this size.
BLOCK_BYTES = 2 << 20
FOUND = "n_words long, n_hit long, items array<string>, ranges array<struct<first:int,last:int>>, spans array<struct<start:int,end:int>>"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Matcher:
    """The automaton over the chunks of one block of items."""

    def __init__(self, items: list[tuple], window: int):
        self.window, self.chunk = window, window // 2 + 1
        texts: dict[tuple, list] = {}
        for item, text in items:
            if words := tuple(words_of(text)):
                texts.setdefault(words, []).append(item)
        self.texts, self.ids = list(texts), list(texts.values())
        places: dict[str, list] = {}
        for t, words in enumerate(self.texts):
            size = self.chunk if len(words) >= window else len(words)
            for at in range(0, len(words) - size + 1, self.chunk):
                places.setdefault(f" {b' '.join(words[at : at + size]).decode()} ", []).append((t, at, size))
        self.automaton = ahocorasick.Automaton()
        for pattern, found in places.items():
            self.automaton.add_word(pattern, found)
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def runs(self, words: list[bytes]):
        """(first word, end, index of the item text) of each occurrence, widened as far as it goes."""
        if self.empty or not words:
            return set()
        line, found, starts = f" {b' '.join(words).decode()} ", set(), None
        for end, places in self.automaton.iter(line):
            if starts is None:
                ends = accumulate(len(w.decode()) + 1 for w in words)
                starts = {e: k for k, e in enumerate(ends, 1)}
            last = starts[end]
            for t, at, size in places:
                item, lo, hi = self.texts[t], last - size, last
                a, b = at, at + size
                while lo > 0 and a > 0 and words[lo - 1] == item[a - 1]:
                    lo, a = lo - 1, a - 1
                while hi < len(words) and b < len(item) and words[hi] == item[b]:
                    hi, b = hi + 1, b + 1
                if hi - lo >= min(self.window, len(item)):
                    found.add((lo, hi, t))
        return found


def merged(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def judge(text: str | None, matcher: Matcher, ranges=(), items=()) -> tuple:
    words = words_of(text)
    runs = matcher.runs(words)
    spans = []
    if runs or len(ranges):
        ranges = merged([(lo, hi) for lo, hi, _ in runs] + [(r["first"], r["last"]) for r in ranges])
        items = sorted({str(i) for *_, t in runs for i in matcher.ids[t] if i is not None} | set(items))
        at = [m.span() for m in WORD.finditer(text)]
        spans = [{"start": at[lo][0], "end": at[hi - 1][1]} for lo, hi in ranges]
    ranges = [{"first": lo, "last": hi} for lo, hi in ranges]
    return len(words), sum(r["last"] - r["first"] for r in ranges), list(items), ranges, spans


def _scanner(items, window: int):
    kept: list[Matcher] = []

    def table(rows) -> pd.DataFrame:
        return pd.DataFrame(list(rows), columns=["n_words", "n_hit", "items", "ranges", "spans"])

    def matcher() -> Matcher:
        if not kept:
            kept.append(Matcher(items.value, window))
        return kept[0]

    @F.pandas_udf(FOUND)
    def first(text: pd.Series) -> pd.DataFrame:
        return table(judge(t, matcher()) for t in text)

    @F.pandas_udf(FOUND)
    def later(text: pd.Series, ranges: pd.Series, ids: pd.Series) -> pd.DataFrame:
        return table(judge(t, matcher(), r, i) for t, r, i in zip(text, ranges, ids))

    # Not to be evaluated anew for a filter on their result.
    return first.asNondeterministic(), later.asNondeterministic()


def scan(docs: DataFrame, benchmark: DataFrame, out: str, window: int = WINDOW) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, items, ranges (words), spans.

    Spans are code points of the original text, end exclusive. The benchmark is read in blocks of
    ``BLOCK_BYTES``; only one block is broadcast at a time.
    """
    bench = benchmark.select("item_id", "text")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])
        first, later = _scanner(items, window)
        found = later(F.col("text"), F.col(f"{out}.ranges"), F.col(f"{out}.items")) if k else first(F.col("text"))
        docs = docs.withColumn(out, found)
        if k + 1 < blocks:
            docs = cut_lineage(docs)
    return docs


def is_contaminated(found: Column) -> Column:
    """At least a twentieth of the words are hit."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, spans, contaminated."""
    found = scan(docs.select("doc_id", "text"), benchmark, "__found", window)
    c = F.col("__found")
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), c["items"].alias("items"),
                        c["spans"].alias("spans"), is_contaminated(c).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated rows, all columns as they were."""
    name = fresh(docs, "found")
    return scan(docs, benchmark, name, window).filter(~is_contaminated(F.col(name))).drop(name)
