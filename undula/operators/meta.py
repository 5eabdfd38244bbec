"""Links between links: meta-connectivity, modules and three-node motifs (family F)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from undula.operators.connectivity import pair_id, unfold_pairs
from undula.operators.pairing import correlate_items, correlate_pieces, tile_pairs

RULES = ("fc_root", "mc_fc", "mc_dfc")


def meta_connectivity(dfc: DataFrame, tile: int = 128, chunk: int = 1024) -> DataFrame:
    """Correlation across frames of every two links: rows (subject, window_size, pair_a, pair_b, mc), pair_a > pair_b."""
    keys = ["subject", "window_size"]
    return correlate_items(dfc, keys, "pair_id", "frame", "fc", "pair_b", "pair_a", "mc", tile, chunk)


def meta_connectivity_of_series(series: DataFrame, tile: int = 128) -> DataFrame:
    """The same from ``link_series``, whose lists are the pieces of the links: no frame is shuffled by itself."""
    pieces = series.withColumn("pair_id", pair_id()).select("subject", "window_size", "pair_id", F.col("block").alias("_part"), F.col("fc").alias("_v"))
    return correlate_pieces(pieces, ["subject", "window_size"], "pair_id", "pair_b", "pair_a", "mc", tile)


# ---- index tables ----------------------------------------------------------------------


def link_index(regions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All links of the regions of each key: (keys, pair_id, i, j), i > j.

    ``regions`` is (keys, region) with regions numbered from 0.
    """
    i = regions.select(*keys, F.col("region").alias("i")).distinct().where("i > 0")
    j = F.explode(F.sequence(F.lit(0), F.col("i") - 1))
    pair = (F.col("i") * (F.col("i") - 1) / 2 + F.col("j")).cast("int")
    return i.select(*keys, "i", j.alias("j")).select(*keys, pair.alias("pair_id"), "i", "j")


def ordered_links(links: DataFrame, order: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Links with their position under a sort index: ``order`` is (keys, pair_id, pos)."""
    return links.join(order, [*keys, "pair_id"])


def meta_links(links: DataFrame, keys: Sequence[str] = (), position: str = "pair_id", tile: int = 512) -> DataFrame:
    """Every two links, higher position first, with their four regions.

    Rows (keys, pos_a, pos_b, i1, j1, i2, j2). The links of a key are dealt into tiles, and pairs are
    unfolded from every two of them.
    """
    tiles = tile_pairs(links, keys, position, ["i", "j"], tile)
    pairs = tiles.select(*keys, "same", F.explode("a").alias("x"), "b").select(*keys, "same", "x", F.explode("b").alias("y"))
    high, low = F.greatest("x", "y"), F.least("x", "y")
    apart = pairs.where(~F.col("same") | (F.col("x") < F.col("y"))).select(*keys, high.alias("p"), low.alias("q"))
    return apart.select(
        *keys,
        F.col(f"p.{position}").alias("pos_a"),
        F.col(f"q.{position}").alias("pos_b"),
        F.col("p.i").alias("i1"),
        F.col("p.j").alias("j1"),
        F.col("q.i").alias("i2"),
        F.col("q.j").alias("j2"),
    )


# ---- trimers ---------------------------------------------------------------------------


def trimers(links: DataFrame, keys: Sequence[str] = (), position: str = "pair_id") -> DataFrame:
    """Pairs of links that share one region: (keys, pair_a, pair_b, root, leaf1, leaf2), pair_a > pair_b.

    An equi-join on the shared endpoint, so only trimers are formed, not all meta-links.
    """
    keys = list(keys)
    ends = F.explode(
        F.array(
            F.struct(F.col("i").alias("root"), F.col("j").alias("leaf")),
            F.struct(F.col("j").alias("root"), F.col("i").alias("leaf")),
        )
    )
    touch = links.select(*keys, F.col(position).alias("pair"), ends.alias("e")).select(*keys, "pair", "e.root", "e.leaf")
    a = touch.select(*keys, "root", F.col("pair").alias("pair_a"), F.col("leaf").alias("leaf1"))
    b = touch.select(*keys, "root", F.col("pair").alias("pair_b"), F.col("leaf").alias("leaf2"))
    return a.join(b, [*keys, "root"]).where("pair_a > pair_b").select(*keys, "pair_a", "pair_b", "root", "leaf1", "leaf2")


def nplet_index(metas: DataFrame, motifs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """root + 1 on trimer cells and 0 elsewhere, over all meta-links."""
    keys = list(keys)
    roots = motifs.select(*keys, F.col("pair_a").alias("pos_a"), F.col("pair_b").alias("pos_b"), "root")
    return metas.join(roots, [*keys, "pos_a", "pos_b"], "left").select(
        *keys, "pos_a", "pos_b", F.coalesce(F.col("root") + 1, F.lit(0)).alias("nplet")
    )


def nplet_mask(index: DataFrame, links: DataFrame, keys: Sequence[str] = (), position: str = "pair_id") -> DataFrame:
    """Symmetric form of the n-plet index with an empty (NULL) diagonal."""
    both = F.explode(
        F.array(
            F.struct(F.col("pos_a").alias("row"), F.col("pos_b").alias("col")),
            F.struct(F.col("pos_b").alias("row"), F.col("pos_a").alias("col")),
        )
    )
    off = index.select(*keys, both.alias("c"), "nplet").select(*keys, "c.row", "c.col", "nplet")
    p = F.col(position)
    diagonal = links.select(*keys, p.alias("row"), p.alias("col"), F.lit(None).cast("int").alias("nplet"))
    return off.unionByName(diagonal)


def root_of(i1: Column, j1: Column, i2: Column, j2: Column) -> Column:
    """The region that two links share; NULL when they share none."""
    return F.when((i1 == i2) | (i1 == j2), i1).when((j1 == i2) | (j1 == j2), j1)


def leaves_of(i1: Column, j1: Column, i2: Column, j2: Column) -> Column:
    """The two regions that occur once, in the order of the links."""
    root = root_of(i1, j1, i2, j2)
    return F.when(root.isNotNull(), F.filter(F.array(i1, j1, i2, j2), lambda r: r != root))


def genuine_trimers(
    motifs: DataFrame, fc: DataFrame, mc: DataFrame, mean_dfc: DataFrame
) -> DataFrame:
    """Three verdicts per subject and trimer: rows (subject, pair_a, pair_b, root, signs, RULES).

    fc_root: the weaker root link exceeds the leaf link; mc_fc and mc_dfc: the meta-link exceeds
    the leaf link of the static network or of the mean over frames. All in absolute value.
    """
    i, j = F.greatest("leaf1", "leaf2"), F.least("leaf1", "leaf2")
    leaf_pair = (i * (i - 1) / 2 + j).cast("int").alias("leaf_pair")
    listed = motifs.select("pair_a", "pair_b", "root", leaf_pair)
    with_id = fc.withColumn("pair_id", (F.col("i") * (F.col("i") - 1) / 2 + F.col("j")).cast("int"))

    def link(name: str, as_: str) -> DataFrame:
        return with_id.select("subject", F.col("pair_id").alias(name), F.col("fc").alias(as_))

    # the trimer list grows with the cube of the regions, so its join is left to its measured size
    values = (
        mc.join(listed, ["pair_a", "pair_b"])
        .join(link("pair_a", "fc_a"), ["subject", "pair_a"])
        .join(link("pair_b", "fc_b"), ["subject", "pair_b"])
        .join(link("leaf_pair", "fc_leaf"), ["subject", "leaf_pair"])
        .join(
            mean_dfc.select(
                "subject", (F.col("i") * (F.col("i") - 1) / 2 + F.col("j")).cast("int").alias("leaf_pair"), "mean_fc"
            ),
            ["subject", "leaf_pair"],
        )
    )
    size = F.abs
    return values.select(
        "subject",
        "pair_a",
        "pair_b",
        "root",
        F.signum("fc_leaf").cast("int").alias("leaf_sign"),
        F.signum("fc_a").cast("int").alias("root_sign1"),
        F.signum("fc_b").cast("int").alias("root_sign2"),
        (F.least(size("fc_a"), size("fc_b")) > size("fc_leaf")).alias("fc_root"),
        (size("mc") > size("fc_leaf")).alias("mc_fc"),
        (size("mc") > size("mean_fc")).alias("mc_dfc"),
    )


def prevalence(genuine: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Share of subjects (or of a group's subjects) for which a trimer is genuine, by rule."""
    keys = ["pair_a", "pair_b", "root"]
    if members is not None:
        genuine = genuine.join(members.select("label", "subject"), "subject")
        keys = ["label", *keys]
    return genuine.groupBy(*keys).agg(*[F.avg(F.col(r).cast("double")).alias(r) for r in RULES])


def values_by_root(mc: DataFrame, motifs: DataFrame) -> DataFrame:
    """Meta-link values of the trimers rooted in each region, summarised per subject."""
    return (
        mc.join(motifs.select("pair_a", "pair_b", "root"), ["pair_a", "pair_b"])
        .groupBy("subject", "root")
        .agg(
            F.count("mc").alias("n"),
            F.avg("mc").alias("mean_mc"),
            F.stddev_samp("mc").alias("sd_mc"),
            F.sum(F.abs("mc")).alias("strength"),
        )
    )


# ---- modules ---------------------------------------------------------------------------


def intramodule_pairs(partition: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Node pairs i <= j inside each module, self-pairs included: (keys, module, i, j)."""
    packed = partition.groupBy(*keys, F.col("community").alias("module")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("node").alias("region"), F.lit(0).alias("value")))).alias("vec")
    )
    return unfold_pairs(packed, [*keys, "module"], diagonal=True).select(
        *keys, "module", F.col("j").alias("i"), F.col("i").alias("j")
    )


def module_mask(partition: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every node pair (i > j) with its shared module, 0 between modules."""
    packed = partition.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("node").alias("region"), F.col("community").alias("value")))).alias("vec")
    )
    shared = F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(0)
    return unfold_pairs(packed, keys).select(*keys, "i", "j", shared.alias("module"))


def ordered_values(mc: DataFrame, order: DataFrame, partition: DataFrame, links: DataFrame) -> DataFrame:
    """Meta-link values in community order with module and region ids.

    ``order`` (pair_id, pos), ``partition`` (node = pair_id, community) and ``links`` are one row
    per link. Rows (subject, pos_a, pos_b, mc, module, i1, j1, i2, j2), pos_a > pos_b.
    """
    about = links.join(order, "pair_id").join(partition.select(F.col("node").alias("pair_id"), "community"), "pair_id")

    def side(tag: str) -> DataFrame:
        cols = {"pair_id": f"pair_{tag}", "pos": f"p_{tag}", "community": f"m_{tag}", "i": f"i_{tag}", "j": f"j_{tag}"}
        return about.select(*[F.col(k).alias(v) for k, v in cols.items()])

    both = mc.join(side("a"), "pair_a").join(side("b"), "pair_b")
    first = F.col("p_a") > F.col("p_b")

    def pick(name: str, higher: bool) -> Column:
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        return F.when(first, a if higher else b).otherwise(b if higher else a)

    return both.select(
        "subject",
        pick("p", True).alias("pos_a"),
        pick("p", False).alias("pos_b"),
        "mc",
        F.when(F.col("m_a") == F.col("m_b"), F.col("m_a")).otherwise(0).alias("module"),
        pick("i", True).alias("i1"),
        pick("j", True).alias("j1"),
        pick("i", False).alias("i2"),
        pick("j", False).alias("j2"),
    )


def viscosity(mc: DataFrame) -> DataFrame:
    """Negative meta-links per subject: how many, their share and their mean."""
    negative = F.col("mc") < 0
    return mc.groupBy("subject").agg(
        F.count_if(negative).alias("n_negative"),
        F.avg(negative.cast("double")).alias("share_negative"),
        F.avg(F.when(negative, F.col("mc"))).alias("mean_negative"),
    )
