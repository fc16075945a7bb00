"""Summary statistics in the order and orientation of a linkage panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.functions.columns import variant_id
from locusloom.functions.running import numbered


def align_to_panel(stats: DataFrame, panel: DataFrame, keep: list[str]) -> DataFrame:
    """(region_id, place, id, sign, keep...): the variants that both have, numbered from 0 in panel order.

    ``stats`` and ``panel`` have ``region_id, chr, bp, a1, a2``; a pair of alleles in the other order counts as the same
    variant with ``sign`` -1, for the caller to turn effects. Variants of one side only drop from rows and columns alike,
    since a matrix is addressed by ``place`` (or by the panel's ``panel_place``, which is kept).
    """
    order = [F.col("bp"), F.col("id")]
    listed = numbered(
        panel.select("region_id", "chr", "bp", variant_id(F.col("chr"), F.col("bp"), F.col("a2"), F.col("a1")).alias("id"), "a1", "a2"),
        ["region_id"], F.floor(F.col("bp") / 100_000), order, "__n",
    ).withColumn("panel_place", (F.col("__n") - 1).cast("long"))
    ways = F.array(
        F.struct(F.col("a1").alias("a1"), F.col("a2").alias("a2"), F.lit(1).alias("sign")),
        F.struct(F.col("a2").alias("a1"), F.col("a1").alias("a2"), F.lit(-1).alias("sign")),
    )
    both = listed.select("region_id", "chr", "bp", "id", "panel_place", F.explode(ways).alias("w")).select(
        "region_id", "chr", "bp", "id", "panel_place", "w.a1", "w.a2", "w.sign")
    met = stats.select("region_id", "chr", "bp", "a1", "a2", *keep).join(both, ["region_id", "chr", "bp", "a1", "a2"])
    placed = numbered(met, ["region_id"], F.floor(F.col("bp") / 100_000), [F.col("panel_place"), F.col("sign").desc()], "__k")
    return placed.select("region_id", (F.col("__k") - 1).cast("long").alias("place"), "panel_place", "id", "sign", *keep)


def aligned_matrix(pairs: DataFrame, aligned: DataFrame) -> DataFrame:
    """(region_id, i, j, r) of a panel matrix (region_id, i, j, r by panel place), cut to the aligned rows and columns and
    turned with them."""
    side = lambda k: aligned.select("region_id", F.col("panel_place").alias(k), F.col("place").alias(f"{k}_to"), F.col("sign").alias(f"{k}_sign"))
    return pairs.join(side("i"), ["region_id", "i"]).join(side("j"), ["region_id", "j"]).select(
        "region_id", F.col("i_to").alias("i"), F.col("j_to").alias("j"), (F.col("r") * F.col("i_sign") * F.col("j_sign")).alias("r"))
