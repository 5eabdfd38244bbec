"""Line deduplication by overlapping windows of three lines.

Lines that are not blank are compared without the spaces, tabs and carriage returns around them;
each three that follow one another (blank lines between them aside) are a window. A text with fewer
such lines is one window. Of a window that occurs more than once in all documents, the occurrence
with the smallest (doc_id, place) stays, of texts that share both the one with the smallest digest; the
lines that later ones cover, blank lines inside them included, are removed. Overlapping windows merge because a line is removed at most once.
A repeated line between other neighbours is in no repeated window and stays.

Windows are compared by 128 bits. Counting is pre-aggregated before its shuffle, and a window that is
very frequent is joined by ``common.attach`` without moving its occurrences to one task. What is
collected per document is bounded by its own lines.

Defined cases: a null text has no lines and stays null; an empty text has one blank line; a null
doc_id comes before any other; rows equal in doc_id and text are one occurrence and are treated
alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import attach, cut_lineage, row_key

LINES = 3


def windows(docs: DataFrame, size: int = LINES) -> DataFrame:
    """key, doc_id, place, lo, hi (lines), window: every window of every text."""
    full = F.filter(
        F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(" \t\r")).alias("line"))),
        lambda x: x["line"] != "",
    )
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("key"), full.alias("full")).filter(F.size("full") > 0)
    width = F.least(F.lit(size), F.size("full"))

    def window(s):
        part = F.slice(F.col("full"), s + 1, width)
        line = part["line"]
        mark = F.concat(F.hex(F.xxhash64(line)), F.hex(F.xxhash64(F.lit("second"), line)))
        return F.struct(s.alias("place"), part[0]["i"].alias("lo"), F.element_at(part, -1)["i"].alias("hi"), mark.alias("window"))

    found = F.transform(F.sequence(F.lit(0), F.size("full") - width), window)
    return rows.select("key", "doc_id", F.inline(found))


def removed_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """key, ranges (array of lo, hi): what later occurrences cover in each text that has any."""
    every = cut_lineage(windows(docs, size))
    first = every.groupBy("window").agg(F.min(F.struct("doc_id", "place", "key")).alias("first"), F.count("*").alias("n"))
    repeated = cut_lineage(first.filter("n > 1"))
    found = attach(every, repeated, "window", "n").filter(
        F.col("first").isNotNull() & ~((F.col("key") == F.col("first.key")) & (F.col("place") == F.col("first.place")))
    )
    return found.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def deduplicate_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text (without the removed lines)."""
    keyed = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    joined = keyed.join(cut_lineage(removed_lines(docs, size)), "key", "left")
    lines = F.split("text", "\n", -1)
    covered = F.flatten(F.transform("ranges", lambda r: F.sequence(r["lo"], r["hi"])))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    short = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    touched = F.col("ranges").isNotNull()
    return joined.select(
        "doc_id", F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(touched, F.size(lines) - F.size(kept)).otherwise(0).cast("long").alias("n_removed"),
        F.when(touched, short).otherwise(F.col("text")).alias("text"),
    )
