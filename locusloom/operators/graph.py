"""Hypothesis graphs as node and edge tables keyed by hypothesis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relabel(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Rewrite both endpoints of edges through ``names(old_id, new_id)``; others stay."""
    src = names.select(F.col("old_id").alias("source"), F.col("new_id").alias("__s"))
    dst = names.select(F.col("old_id").alias("target"), F.col("new_id").alias("__t"))
    out = edges.join(src, "source", "left").join(dst, "target", "left")
    return out.select(
        "hypothesis_id", F.coalesce("__s", "source").alias("source"), F.coalesce("__t", "target").alias("target"), "label")


def relabel_nodes(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """New id, and the old one (or the looked-up name) as display name."""
    m = names.select(F.col("old_id").alias("id"), "new_id", "name")
    out = nodes.join(m, "id", "left")
    return out.select("hypothesis_id", F.coalesce("new_id", "id").alias("id"), "type", F.coalesce("name", "id").alias("name"))


def extension_edges(hypotheses: DataFrame, members: DataFrame) -> DataFrame:
    """Edges from co-expressed genes to the term and from the term to the phenotype.

    ``hypotheses(hypothesis_id, causal_gene, go_id, phenotype_id)``,
    ``members(go_id, gene)``.
    """
    involved = hypotheses.select(
        "hypothesis_id", F.col("go_id").alias("source"), F.col("phenotype_id").alias("target"), F.lit("involved_in").alias("label"))
    genes = hypotheses.join(members, "go_id")
    enriched = genes.select("hypothesis_id", F.col("gene").alias("source"), F.col("go_id").alias("target"), F.lit("enriched_in").alias("label"))
    linked = genes.select("hypothesis_id", F.col("causal_gene").alias("source"), F.col("gene").alias("target"), F.lit("coexpressed_with").alias("label"))
    return involved.unionByName(enriched).unionByName(linked)


def extension_nodes(hypotheses: DataFrame, members: DataFrame) -> DataFrame:
    """Term, phenotype and co-expressed gene nodes."""
    go = hypotheses.select("hypothesis_id", F.col("go_id").alias("id"), F.lit("go").alias("type"), F.col("go_name").alias("name"))
    ph = hypotheses.select("hypothesis_id", F.col("phenotype_id").alias("id"), F.lit("phenotype").alias("type"), F.col("phenotype").alias("name"))
    genes = hypotheses.join(members, "go_id").select("hypothesis_id", F.col("gene").alias("id"), F.lit("gene").alias("type"), F.col("gene_name").alias("name"))
    return go.unionByName(ph).unionByName(genes)
