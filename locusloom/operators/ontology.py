"""Ontology closure, gene membership with depth and the tissue mapping ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.functions.running import paged, salted_join, shuffled
from locusloom.functions.session import cut_lineage

_SLOTS = 8  # shares of the genes of one term


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) incl. the node itself at depth 0; depth is the shortest path.

    Semi-naive: only pairs new in the last step are extended, and pairs already known are
    anti-joined away, so cycles end. Steps are cut by reliable checkpoints. The step join is
    salted because a root is the ancestor of nearly every node; only links that the step
    climbs are copied to the slots, and these get fewer with every step up.
    """
    links = edges.select("child", "parent").distinct()
    nodes = links.select(F.col("child").alias("node")).union(links.select("parent")).distinct()
    known = cut_lineage(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))
    frontier = known
    up = links.withColumnsRenamed({"child": "ancestor"})
    depth = 0
    while True:  # a pair is new once, so it ends
        depth += 1
        climbed = up.join(shuffled(frontier.select("ancestor").distinct()), "ancestor", "left_semi")
        step = salted_join(frontier, climbed, ["ancestor"]).select("node", F.col("parent").alias("ancestor")).distinct()
        new = step.join(shuffled(known.select("node", "ancestor")), ["node", "ancestor"], "left_anti")
        frontier = cut_lineage(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


def term_members(base: DataFrame, closure: DataFrame) -> DataFrame:
    """(gene, term, depth): genes of a term and of the terms below it, smallest depth.

    A term's ancestors meet its genes in pages. Equal rows of ``base`` meet in one slot of the term and become one there.
    """
    slot = F.pmod(F.xxhash64("gene"), F.lit(_SLOTS)).cast("int")
    given = base.select("gene", F.col("term").alias("node"), slot.alias("__slot"))
    ways = paged(closure, ["node"], ["ancestor", "depth"], "__ways").withColumn(
        "__slot", F.explode(F.sequence(F.lit(0), F.lit(_SLOTS - 1))))
    climbed = given.repartition("node", "__slot").distinct().join(shuffled(ways), ["node", "__slot"])
    return climbed.select("gene", F.inline("__ways")).groupBy("gene", F.col("ancestor").alias("term")).agg(F.min("depth").alias("depth"))


def descendant_map(descendants: DataFrame) -> DataFrame:
    """(id, parent, key_order): each parent maps to itself, a descendant entry overrides.

    ``descendants(parent, descendant, ord)``; among several parents the last one wins, and
    ``key_order`` is where the id first appeared.
    """
    own = descendants.select(
        F.col("parent").alias("id"), "parent", F.struct(F.lit(0).alias("k"), F.col("ord").alias("o"), F.col("parent").alias("d")).alias("key"))
    kids = descendants.filter(F.col("descendant").isNotNull()).select(
        F.col("descendant").alias("id"), "parent", F.struct(F.lit(1).alias("k"), F.col("ord").alias("o"), F.col("descendant").alias("d")).alias("key"))
    return own.unionByName(kids).groupBy("id").agg(
        F.max_by("parent", "key").alias("parent"), F.min("key").alias("key_order"))


def map_tissues(tissues: DataFrame, target: DataFrame, closure: DataFrame) -> DataFrame:
    """(tissue, source_id, parent_id, match_type) by the ladder direct, descendant, broader.

    ``tissues(tissue, source_id)``, ``target`` from :func:`descendant_map`, ``closure`` from
    :func:`ancestors`. A broader match is the first target key among the ancestors.
    """
    direct = tissues.join(shuffled(target.select(F.col("id").alias("source_id"), F.col("parent").alias("__mapped"))), "source_id", "left")
    open_ids = direct.filter(F.col("source_id").isNotNull() & F.col("__mapped").isNull()).select("source_id").distinct()
    up = open_ids.join(shuffled(closure.withColumnRenamed("node", "source_id")), "source_id")
    known = up.select("source_id").distinct().withColumn("__known", F.lit(True))
    broader = (
        up.join(shuffled(target.select(F.col("id").alias("ancestor"), "key_order")), "ancestor")
        .withColumn("__d", F.when(F.col("ancestor") == F.col("source_id"), 0).otherwise(1))
        .groupBy("source_id").agg(F.min_by("ancestor", F.struct("__d", "key_order")).alias("__broader"))
    )
    rows = direct.join(shuffled(broader), "source_id", "left").join(shuffled(known), "source_id", "left")
    match = (
        F.when(F.col("source_id").isNull(), "no_direct_uberon_found")
        .when(F.col("__mapped") == F.col("source_id"), "direct")
        .when(F.col("__mapped").isNotNull(), "descendant")
        .when(F.col("__broader").isNotNull(), "broader_match_found")
        .when(F.col("__known"), "no_cellxgene_match")
        .otherwise("no_uberon_in_ontology")
    )
    return rows.select("tissue", "source_id", F.coalesce("__mapped", "__broader").alias("parent_id"), match.alias("match_type"))
