"""Mixing sources to target weights by pivotal dependent rounding.

The words to take from a source come to ``target / source size`` copies of each of its documents: a
whole number and a fractional probability. The fractions are rounded by pivotal sampling: two
documents of a source meet, and words are moved at random from one to the other until the
probability of one of them is 0 or 1. The move keeps the expectation of either document and the sum
of (size x probability), so a source ends at its target but for one last document.

Pairs meet in groups of at most about ``GROUP_UNITS`` documents of one source; each group leaves one
undecided residual, and ``FAN_IN`` groups are combined per level of a reduction tree until one
residual of a source is left, which is drawn. Groups follow from a hash of the rows and their
number, not from partitions, so reruns on other clusters agree. A hot source has many groups.

Targets: sources by code point, null last, get the weights 3, 1, 2 repeating and share
``SHARE`` times all words; no target exceeds twice the words of its source, and what is beyond goes
to the others by weight. This is the water level that is the largest of the candidate levels.

Defined cases: a null or empty text has size 0 and takes no words; it is copied as often as the
whole part of its source's ratio says. A source without words has target 0. Rows equal in doc_id,
source and text share one decision. An empty table gives no rows. Source totals are one row per
source; ranking them is the only step in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from undula.llm.common import attach, bounded, cut_lineage, mix64, row_key

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
GROUP_UNITS = 20_000
FAN_IN = 16
#: Source totals are broadcast only if they are counted to be no more rows than this.
MOST_BROADCAST = 100_000
SEED = 20240917


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the key of each row."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), row_key("doc_id", "source", "text").alias("key"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut_lineage(total.select("source", "source_size", weight.alias("w")))
    cap = most * F.col("source_size")
    by_level = W.partitionBy(F.lit(0)).orderBy(cap / F.col("w"), F.asc_nulls_last("source"))
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    levels = ranked.select("source", "source_size", "w", level.alias("level"))
    top = levels.agg(F.max("level").alias("top"))
    return levels.crossJoin(F.broadcast(top)).select(
        "source", "source_size", F.least(most * F.col("source_size"), F.col("top") * F.col("w")).alias("target")
    )


def draws(keys, level: int) -> np.ndarray:
    """A uniform number per key and level of the tree, the same in every run."""
    h = np.array([int(k[:16], 16) for k in keys], dtype=np.uint64)
    return (mix64(h + np.uint64((SEED + level) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)) / float(1 << 53)


def pivot(weights, probs, u) -> tuple[list, int | None, float]:
    """Decisions (1, 0 or None), the place of the residual and its probability.

    One unit is held; each next one meets it and one of the two is decided.
    """
    out: list = [None] * len(weights)
    hold, p, a = None, 0.0, 0.0
    for j, (b, q) in enumerate(zip(weights, probs)):
        if hold is None:
            hold, p, a = j, q, b
            continue
        up = min(a * (1 - p), b * q)
        down = min(a * p, b * (1 - q))
        if u[j] * (up + down) < down:
            held_is_full = a * (1 - p) <= b * q
            p, q = p + up / a, q - up / b
            held, other = (1, None) if held_is_full else (None, 0)
        else:
            held_is_empty = a * p <= b * (1 - q)
            p, q = p - down / a, q + down / b
            held, other = (0, None) if held_is_empty else (None, 1)
        if held is None:
            out[j] = other
        else:
            out[hold] = held
            hold, p, a = j, q, b
        if p <= 1e-12 or p >= 1 - 1e-12:
            out[hold] = int(p > 0.5)
            hold = None
    return out, hold, p


UNIT = "key string, source string, place long, width long, weight double, prob double, extra int"


def _meet(level: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        # Large units meet first, so that what is left at the end of a source tends to be small.
        frame = frame.sort_values(["weight", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        u, last = draws(frame["key"], level), int(frame["width"].iloc[0]) == 1
        out, hold, p = pivot(frame["weight"].tolist(), frame["prob"].tolist(), u)
        if hold is not None:
            frame.loc[hold, "prob"] = p
            if last:
                out[hold] = int(draws(frame["key"][hold : hold + 1], level + 1000)[0] < p)
        return frame.assign(extra=pd.array(out, "Int32"))[["key", "source", "place", "width", "weight", "prob", "extra"]]

    return run


def decide(units: DataFrame) -> DataFrame:
    """key, extra (0 or 1) for units (key, source, weight > 0, 0 < prob < 1)."""
    # A source has as many groups as its own units fill; each level of the tree joins FAN_IN of them.
    sizes = cut_lineage(units.groupBy("source").agg(F.ceil(F.count("*") / GROUP_UNITS).cast("long").alias("width")))
    own = bounded(sizes.withColumnRenamed("source", "of"), MOST_BROADCAST)
    state = units.join(own, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    state = state.withColumn("place", F.pmod(F.xxhash64("key"), F.col("width")))
    widest, decided, level = sizes.agg(F.max("width")).first()[0] or 1, [], 0
    while True:
        met = cut_lineage(state.groupBy("source", "place").applyInPandas(_meet(level), UNIT))
        decided.append(met.filter("extra is not null").select("key", "extra"))
        if widest == 1:
            break
        shrunk = F.ceil(F.col("width") / FAN_IN).cast("long")
        state = met.filter("extra is null").drop("extra").withColumn("place", F.floor(F.col("place") / FAN_IN)).withColumn("width", shrunk)
        widest, level = -(-widest // FAN_IN), level + 1
    out = decided[0]
    for more in decided[1:]:
        out = out.union(more)
    return out


def planned(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, key, rows (equal ones)."""
    sizes = cut_lineage(sized(docs))
    target = cut_lineage(source_targets(sizes))
    joined = sizes.join(bounded(target, MOST_BROADCAST), sizes["source"].eqNullSafe(target["source"]), "inner")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = cut_lineage(joined.select(
        "doc_id", sizes["source"], "size", "key", "source_size", "target", F.floor(ratio).alias("base"), (ratio - F.floor(ratio)).alias("prob")
    ))
    units = plan.filter("size > 0 and prob > 0").groupBy("key", "source", "size", "prob").agg(F.count("*").alias("rows"))
    units = cut_lineage(units.withColumn("weight", (F.col("size") * F.col("rows")).cast("double")))
    chosen = decide(units.select("key", "source", "weight", "prob"))
    facts = cut_lineage(units.select("key", "rows").join(chosen, "key").select("key", "extra", "rows"))
    copies = F.col("base") + F.coalesce("extra", F.lit(0))
    return attach(plan, facts, "key", "rows").select(
        "doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), "key"
    )


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    return planned(docs).drop("key")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    plan = planned(docs).groupBy("key").agg(F.first("copies").alias("__copies"), F.count("*").alias("__rows"))
    plan = cut_lineage(plan.filter("__copies > 0").withColumnRenamed("key", "__key"))
    keyed = docs.withColumn("__key", row_key("doc_id", "source", "text"))
    taken = attach(keyed, plan, "__key", "__rows").filter("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.expr("sequence(1L, __copies)"))).drop("__key", "__copies", "__rows", "__copy")
