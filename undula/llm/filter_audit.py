"""Audit of how document filters interact: every order of application, step by step.

Each document is reduced to a mask of the filters that it fails, and the table to cells: counts per
(part, mask). A recursive query then extends prefixes of filters by a letter not yet used, beside
every possible mask, carries the bits that were applied, and emits at each level what that step does
to each mask: keep, remove, fail it after an earlier removal, fail it alone. Masks and prefixes
depend on the number of filters only (326 prefixes and 32 masks for five), so the recursion stays the
same for any table; its rows meet the cells by mask, and counts add up per part and prefix.

The failure conditions are DataFrame functions of whole texts. Words are runs of characters other than
space and ``\\x09-\\x0D``, compared as they are.

Defined cases: a null text is an empty one (it fails ``A``, and ``E`` if a smaller doc_id has an empty
or null text); a null source is the part ``''``; a null doc_id is neither smaller nor larger than
another, so such a row never fails ``E`` and makes none fail it; rows with the same doc_id are
counted one by one and do not repeat each other; of several label rows of a document one with the
value 1 is enough; documents without labels are neither good nor toxic; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm.common import attach, cut_lineage

SPACES = r"[\x20\x09-\x0D]+"
METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
#: More filters than this would be over 5040 orders.
MOST_FILTERS = 7


def conditions(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text alone, which is not null."""
    words = F.array_remove(F.split(text, SPACES, -1), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * capitals.cast("long") > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masked(docs: DataFrame) -> DataFrame:
    """id (string), part, mask: a row per document; bit k of the mask is set if filter k fails."""
    text = F.coalesce("text", F.lit(""))
    own = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions(F.col("whole")).values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("whole")).select(
        "doc_id", "part", own.alias("mask"), F.sha2("whole", 256).alias("digest")
    )
    rows = cut_lineage(rows)
    seen = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    found = attach(rows, cut_lineage(seen), "digest", "n")
    repeated = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
    return found.select(F.col("doc_id").cast("string").alias("id"), "part", F.col("mask").bitwiseOR(F.when(repeated, 16).otherwise(0)).alias("mask"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part that fail exactly the filters of a mask."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"), F.lit(1).alias("one")
    )
    found = attach(masked(docs), cut_lineage(marks), "id", "one")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return found.groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def steps(spark, letters: str) -> DataFrame:
    """prefix, step, letter, mask, kept, removed, redundant, alone: what the last filter of a prefix does to a mask."""
    if not 0 < len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} different letters are needed")
    every = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << k})" for k, x in enumerate(letters))
    return spark.sql(f"""
WITH RECURSIVE steps(prefix, step, letter, bit, earlier, applied, mask) AS (
    SELECT '', 0, '', 0, 0, 0, CAST(id AS INT) FROM range(0, {1 << len(letters)}, 1, 1)
    UNION ALL
    SELECT concat(prefix, one.letter), step + 1, one.letter, one.bit, applied, applied | one.bit, mask
    FROM steps LATERAL VIEW explode(filter(array({every}), x -> (applied & x.bit) = 0)) AS one
)
SELECT prefix, step, letter, mask,
    (mask & applied) = 0 AS kept,
    (mask & bit) <> 0 AND (mask & earlier) = 0 AS removed,
    (mask & bit) <> 0 AND (mask & earlier) <> 0 AS redundant,
    mask = bit AS alone
FROM steps WHERE step > 0""")


def audit(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """A row per part, order of filters and step; ``cells`` as from ``mask_cells``."""
    # At most 2 ** 7 masks of 13,700 prefixes: bounded by the number of filters, whatever the table.
    effect = cut_lineage(steps(cells.sparkSession, letters))
    size = {c: F.col(c).cast("long") for c in ("kept", "removed", "redundant", "alone")}
    total = lambda flag, of, name: F.sum(size[flag] * F.col(of)).alias(name)
    by_prefix = cells.join(F.broadcast(effect), "mask").groupBy("part", "prefix", "step", "letter").agg(
        total("kept", "n", "kept"), total("removed", "n", "removed"), total("redundant", "n", "redundant"),
        total("alone", "n", "unique_fails"), total("removed", "good", "good_lost"), total("removed", "toxic", "toxic_lost"),
    )
    whole = effect.filter(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    orders = whole.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("at"))
    orders = orders.select("filter_order", F.substring("filter_order", F.lit(1), F.col("at")).alias("prefix"))
    found = by_prefix.join(F.broadcast(orders), "prefix")
    shares = by_prefix.join(F.broadcast(orders), "prefix").groupBy(F.col("part").alias("of"), F.col("letter").alias("by")).agg(F.sum("removed").alias("shapley"))
    joined = found.join(shares, (F.col("part") == F.col("of")) & (F.col("letter") == F.col("by")))
    return joined.select("part", "filter_order", F.col("step").cast("int").alias("step"), *METRICS, "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs`` (doc_id, text, source) and ``labels`` (doc_id, quality, toxic)."""
    return audit(cut_lineage(mask_cells(docs, labels)))
