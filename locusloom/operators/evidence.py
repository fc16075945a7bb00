"""Variant-to-gene evidence rules as joins over fact tables.

Tables: ``variants(snp, chr, bp)``, ``genes(gene_key, chr, g_start, g_end)``,
``enhancers(enh_key, kind, chr, e_start, e_end)``, ``associated_with(enh_key, gene_key)``
and ``evidence(snp, gene_key, pred)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusloom.functions.running import paged, salted_join, shuffled, spread, top_k
from locusloom.operators.intervals import (
    ENHANCER_WINDOW_BP,
    GENE_WINDOW_BP,
    arrays_within_k_distance,
    contained_in,
    within_k_distance,
)

# The learned weight of each rule, in rule order.
RULE_WEIGHTS = {
    "regulatory_effect": 0.34,
    "eqtl_association": 0.0176,
    "activity_by_contact": 0.021,
}


_TARGETS = 1000  # genes of one factor in one array
_DOMAIN_SLOTS = 8  # shares of the variants of one domain


def near_genes(variants: DataFrame, genes: DataFrame, k: int = GENE_WINDOW_BP) -> DataFrame:
    """(snp, gene_key) with the gene within ``k`` bp of the variant."""
    pairs = within_k_distance(
        variants.select("snp", "chr", "bp"), genes.select("gene_key", "chr", "g_start", "g_end"),
        k, "bp", "g_start", "g_end",
    )
    return pairs.select("snp", "gene_key")


def in_regulatory_region(variants: DataFrame, enhancers: DataFrame, k: int = ENHANCER_WINDOW_BP) -> DataFrame:
    """(snp, enh_key, kind) for enhancers and super-enhancers within ``k`` bp."""
    wanted = enhancers.filter(F.col("kind").isin("enhancer", "super_enhancer"))
    pairs = within_k_distance(
        variants.select("snp", "chr", "bp"), wanted.select("enh_key", "kind", "chr", "e_start", "e_end"),
        k, "bp", "e_start", "e_end",
    )
    return pairs.select("snp", "enh_key", "kind")


def regulatory_links(variants: DataFrame, enhancers: DataFrame, associated_with: DataFrame) -> DataFrame:
    """(snp, enh_key, kind, gene_key): every enhancer that supports a pair."""
    return salted_join(in_regulatory_region(variants, enhancers), associated_with, ["enh_key"])


def regulatory_effect(variants: DataFrame, enhancers: DataFrame, associated_with: DataFrame) -> DataFrame:
    """Distinct (snp, gene_key) with at least one supporting enhancer."""
    return regulatory_links(variants, enhancers, associated_with).select("snp", "gene_key").distinct()


def _ids(genes: DataFrame, column: str) -> DataFrame:
    return genes.select("gene_key", column).distinct()


def _domain_pages(closest: DataFrame, tads: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(snp, __genes): the closest gene and the genes of its domains, by key or by the second column of ``ids``, in pages.

    Equal (snp, domain) rows meet in one slot of the domain, so they become one row without a shuffle of their own.
    """
    item = ids.columns[1] if ids else "gene_key"
    named = (lambda df: df.join(shuffled(ids), "gene_key")) if ids else (lambda df: df)
    member = tads.select("gene_key", "tad_id").filter(F.col("tad_id").isNotNull()).distinct()
    homes = closest.select("snp", "gene_key").join(shuffled(member), "gene_key", "left")
    alone = named(homes.filter(F.col("tad_id").isNull())).select("snp", F.array(F.struct(item)).alias("__genes"))
    slot = F.pmod(F.xxhash64("snp"), F.lit(_DOMAIN_SLOTS)).cast("int")
    domains = homes.filter(F.col("tad_id").isNotNull()).select("snp", "tad_id", slot.alias("__slot"))
    pages = paged(named(member), ["tad_id"], [item], "__genes").withColumn(
        "__slot", F.explode(F.sequence(F.lit(0), F.lit(_DOMAIN_SLOTS - 1))))
    shared = domains.repartition("tad_id", "__slot").distinct().join(shuffled(pages), ["tad_id", "__slot"])
    return alone.unionByName(shared.select("snp", "__genes"))


def _near_pages(variants: DataFrame, genes: DataFrame, ids: DataFrame | None = None, k: int = GENE_WINDOW_BP) -> DataFrame:
    """(snp, __genes): the genes within ``k`` bp of the variant, by key or by the second column of ``ids``, in pages."""
    item = ids.columns[1] if ids else "gene_key"
    placed = genes.select("gene_key", "chr", "g_start", "g_end")
    if ids:
        placed = placed.join(shuffled(ids), "gene_key")
    met = arrays_within_k_distance(
        variants.select("snp", "chr", "bp"), placed.select(item, "chr", "g_start", "g_end"), k, "bp", "g_start", "g_end", [item], "__genes")
    return met.select("snp", "__genes")


def _each_once(pages: DataFrame, item: str = "gene_key") -> DataFrame:
    """The distinct pairs of pages: these are shuffled once, by variant, as sorted plain values, and laid out after it."""
    plain = pages.select("snp", F.sort_array(F.col("__genes")[item]).alias("__genes"))
    return spread(plain, "snp").select("snp", F.explode("__genes").alias(item)).distinct()


def in_tad_with(closest: DataFrame, tads: DataFrame) -> DataFrame:
    """The closest gene of a variant and every gene sharing one of its domains."""
    return _each_once(_domain_pages(closest, tads))


def candidate_genes(variants: DataFrame, genes: DataFrame, closest: DataFrame, tads: DataFrame, column: str = "gene_key") -> DataFrame:
    """Distinct (snp, gene_key) from the domain rule and the 500 kb rule; for another ``column`` of ``genes``, that of the
    candidates which ``genes`` holds, written beside the keys of the rules before these meet the variants."""
    ids = None if column == "gene_key" else _ids(genes, column)
    return _each_once(_domain_pages(closest, tads, ids).unionByName(_near_pages(variants, genes, ids)), column)


def candidate_sets(candidates: DataFrame, genes: DataFrame) -> DataFrame:
    """One row per variant; the list is bounded by the genes around one position.

    ``candidates`` has (snp, gene_key), or (snp, gene_id) as ``candidate_genes`` gives it.
    """
    named = candidates
    if "gene_id" not in candidates.columns:
        named = candidates.join(shuffled(genes.select("gene_key", "gene_id")), "gene_key")
    ids = F.collect_set("gene_id")
    return named.groupBy("snp").agg(ids.alias("__ids")).select(
        "snp", F.array_join(F.array_sort(F.array_distinct(F.transform("__ids", F.upper))), ",").alias("genes"),
        F.size("__ids").cast("long").alias("n_genes"),
    )


def relevant_gene(
    variants: DataFrame, enhancers: DataFrame, associated_with: DataFrame, evidence: DataFrame
) -> DataFrame:
    """(snp, gene_key, rule) rows of all rules; a rule may repeat for a pair."""
    regulatory = regulatory_links(variants, enhancers, associated_with).select(
        "snp", "gene_key", F.lit("regulatory_effect").alias("rule")
    )
    direct = evidence.filter(F.col("pred").isin("eqtl_association", "activity_by_contact")).select(
        "snp", "gene_key", F.col("pred").alias("rule")
    )
    return regulatory.unionByName(direct)


def rule_flags(relevant: DataFrame) -> DataFrame:
    """One row per (snp, gene_key) with a 0/1 column per rule; duplicates fold map-side."""
    return relevant.groupBy("snp", "gene_key").agg(
        *[F.max(F.when(F.col("rule") == r, 1).otherwise(0)).alias(r) for r in RULE_WEIGHTS]
    )


def noisy_or(relevant: DataFrame, weights: dict[str, float] = RULE_WEIGHTS) -> DataFrame:
    """1 - prod(1 - weight) over the distinct rules that fire for a pair."""
    miss = F.lit(1.0)
    for rule, w in weights.items():
        miss = miss * F.when(F.col(rule) == 1, F.lit(1.0 - w)).otherwise(F.lit(1.0))
    return rule_flags(relevant).select("snp", "gene_key", (1 - miss).alias("score"))


def codes_for(transcribed_to: DataFrame, translates_to: DataFrame) -> DataFrame:
    """gene -> transcript -> protein, distinct (gene_key, protein)."""
    return transcribed_to.join(translates_to, "transcript").select("gene_key", "protein").distinct()


def coexpressed_relevant(relevant_pairs: DataFrame, coexpressed: DataFrame) -> DataFrame:
    """(snp, gene_key) where gene_key is co-expressed with a relevant gene.

    ``coexpressed`` has ``gene_key, with_key``: gene_key is co-expressed with with_key.
    """
    seeds = relevant_pairs.select("snp", F.col("gene_key").alias("with_key")).distinct()
    return salted_join(seeds, coexpressed, ["with_key"]).select("snp", "gene_key").distinct()


def rank_tfs(tf_snp: DataFrame, regulates: DataFrame) -> DataFrame:
    """Transcription factors per (snp, target gene) by absolute motif score.

    ``tf_snp(tf, snp, score, effect)``; equal (score, tf) pairs count once. A factor's targets travel as arrays of at most
    ``_TARGETS`` genes and are laid out after the one shuffle by variant, which serves the ranks.
    """
    changed = tf_snp.filter(F.col("effect").isin("loss", "gain")).select("tf", "snp", "score")
    page = F.pmod(F.xxhash64("gene_key"), F.ceil(F.count("*").over(Window.partitionBy("tf")) / _TARGETS))
    targets = regulates.select("tf", "gene_key").distinct().withColumn("__page", page).groupBy("tf", "__page").agg(
        F.collect_list(F.struct("gene_key")).alias("__targets"))
    by_variant = spread(salted_join(changed, targets.drop("__page"), ["tf"]), "snp")
    hits = by_variant.select("snp", "tf", "score", F.abs("score").alias("abs_score"), F.inline("__targets"))
    w = Window.partitionBy("snp", "gene_key").orderBy(F.col("abs_score").desc(), "tf", "score")
    # equal rows are neighbours in this order: the first of them has its own row number as its rank
    ranked = hits.select("snp", "gene_key", "tf", "abs_score", F.dense_rank().over(w).alias("tf_rank"), (F.rank().over(w) == F.row_number().over(w)).alias("__first"))
    return ranked.filter("__first").drop("__first")


def symbol_facts(rows: DataFrame, genes: DataFrame, symbol: str) -> DataFrame:
    """Attach the gene by (case-free) symbol; rows without a known gene drop out."""
    names = genes.select(F.lower("symbol").alias("__sym"), "gene_key")
    return rows.join(names, F.lower(rows[symbol]) == F.col("__sym")).drop("__sym")


def tfbs_chain(tfbs: DataFrame, binds_to: DataFrame, enhancers: DataFrame) -> DataFrame:
    """(tf_gene, tfbs_key, enh_key): a site bound by the factor, strictly inside an enhancer."""
    inside = contained_in(
        tfbs, enhancers.select("enh_key", "chr", "e_start", "e_end"), "t_start", "t_end", "e_start", "e_end"
    )
    return inside.join(binds_to, "tfbs_key").select("tf_gene", "tfbs_key", "enh_key").distinct()


def coding_effect(annotated: DataFrame, genes: DataFrame) -> DataFrame:
    """Coding rows of an annotated-variant table joined to their gene by symbol."""
    return symbol_facts(annotated.filter(F.col("status") == "coding"), genes, "hugo")


def best_gene(scores: DataFrame) -> DataFrame:
    """Highest score per variant, ties by gene_id."""
    return top_k(scores, ["snp"], [F.col("score").desc(), F.col("gene_id")], 1)


def locus_leads(variants: DataFrame, span_bp: int = 1_000_000) -> DataFrame:
    """Variant with the smallest p per (chr, locus); each task keeps one row per locus."""
    binned = variants.withColumn("locus", F.floor(F.col("bp") / span_bp).cast("long"))
    return top_k(binned, ["chr", "locus"], [F.col("p"), F.col("snp")], 1)
