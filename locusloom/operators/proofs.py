"""Proofs of relevant_gene as edge rows, their graphs and their sampled frequency."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.functions.running import spread
from locusloom.operators.evidence import RULE_WEIGHTS, regulatory_links, rule_flags


def _edge(pred: str, src_type: Column, src: Column, dst_type: Column, dst: Column) -> Column:
    return F.struct(
        F.lit(pred).alias("pred"), src_type.alias("src_type"), src.alias("src"),
        dst_type.alias("dst_type"), dst.alias("dst"),
    )


def proofs(
    variants: DataFrame, enhancers: DataFrame, associated_with: DataFrame, evidence: DataFrame
) -> DataFrame:
    """(snp, gene, rule, via, edges): one row per grounding of a rule.

    The goal itself and hidden goals (positions, alleles, distance tests) are not edges.
    """
    snp, gene = F.col("snp"), F.col("gene_key").cast("string")
    s, g, e = F.lit("snp"), F.lit("gene"), F.col("kind")
    enh = F.col("enh_key").cast("string")
    regulatory = regulatory_links(variants, enhancers, associated_with).select(
        "snp", gene.alias("gene"), F.lit("regulatory_effect").alias("rule"), enh.alias("via"),
        F.array(
            _edge("regulatory_effect", s, snp, g, gene),
            _edge("in_regulatory_region", s, snp, e, enh),
            _edge("associated_with", e, enh, g, gene),
        ).alias("edges"),
    )
    direct = [
        evidence.filter(F.col("pred") == p).select(
            "snp", gene.alias("gene"), F.lit(p).alias("rule"), F.lit("").alias("via"),
            F.array(_edge(p, s, snp, g, gene)).alias("edges"),
        )
        for p in ("eqtl_association", "activity_by_contact")
    ]
    return regulatory.unionByName(direct[0]).unionByName(direct[1])


def proof_edges(proof_rows: DataFrame) -> DataFrame:
    """Distinct edges per (snp, gene). Rows meet by pair before their edges are laid out, so one shuffle of the proofs
    serves the edges, and the nodes made from them."""
    return (
        spread(proof_rows, "snp", "gene").select("snp", "gene", F.explode("edges").alias("e"))
        .select("snp", "gene", "e.pred", "e.src_type", "e.src", "e.dst_type", "e.dst").distinct()
    )


def proof_nodes(edges: DataFrame) -> DataFrame:
    """Distinct (type, id) nodes per (snp, gene)."""
    ends = F.explode(F.array(
        F.struct(F.col("src_type").alias("type"), F.col("src").alias("id")),
        F.struct(F.col("dst_type").alias("type"), F.col("dst").alias("id")),
    ))
    return edges.select("snp", "gene", ends.alias("n")).select("snp", "gene", "n.type", "n.id").distinct()


def proof_graphs(proof_rows: DataFrame, frequency: DataFrame) -> DataFrame:
    """One JSON graph per proof with its frequency; arrays hold the few edges of one proof."""
    nodes = F.array_sort(F.array_distinct(F.flatten(F.transform("edges", lambda e: F.array(
        F.struct(e["src"].alias("id"), e["src_type"].alias("type")),
        F.struct(e["dst"].alias("id"), e["dst_type"].alias("type")),
    )))))
    links = F.array_sort(F.array_distinct(F.transform("edges", lambda e: F.struct(
        e["src"].alias("source"), e["dst"].alias("target"), e["pred"].alias("label")))))
    body = F.to_json(F.struct(
        nodes.alias("nodes"), links.alias("edges"), F.struct(F.col("prob").alias("value")).alias("prob")
    ))
    return proof_rows.join(frequency, ["snp", "gene", "rule"]).select("snp", "gene", "rule", "via", body.alias("graph"))


def uniform(seed: int, *parts: Column) -> Column:
    """Reproducible draw in [0, 1) from the row's own values, the same on every retry."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def draws_below(w: float, seed: int, *parts: Column) -> Column:
    """``uniform(seed, *parts) < w``, compared as hexadecimal text: the draw is the first eight digits over 2^32."""
    first_above = math.ceil(w * 2**32)
    if not 0 < first_above < 2**32:
        return F.lit(first_above > 0)
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])) < f"{first_above:08x}"


def sampled_proofs(relevant: DataFrame, samples: int, seed: int = 42) -> DataFrame:
    """(snp, gene, rule, prob): share of samples whose first successful rule it is.

    Rules fire once per (sample, rule, gene, snp). The rule flags of a pair sit in one row
    before the samples are laid out, so no sample rows are shuffled.
    """
    flags = rule_flags(relevant)
    first = F.lit(None).cast("string")
    for rule, w in reversed(list(RULE_WEIGHTS.items())):
        hit = (F.col(rule) == 1) & draws_below(w, seed, F.col("sample"), F.lit(rule), F.col("gene_key"), F.col("snp"))
        first = F.when(hit, F.lit(rule)).otherwise(first)
    return (
        flags.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
        .withColumn("rule", first).filter(F.col("rule").isNotNull())
        .groupBy("snp", "gene_key", "rule").agg((F.count("*") / F.lit(samples)).alias("prob"))
        .select("snp", F.col("gene_key").cast("string").alias("gene"), "rule", "prob")
    )


def expected_first(relevant: DataFrame) -> DataFrame:
    """Exact value of the sampled frequency: p_r times the misses of earlier rules."""
    flags, ahead, parts = rule_flags(relevant), F.lit(1.0), []
    for rule, w in RULE_WEIGHTS.items():
        fired = F.col(rule) == 1
        parts.append(F.struct(F.lit(rule).alias("rule"), F.when(fired, ahead * w).alias("prob")))
        ahead = ahead * F.when(fired, F.lit(1.0 - w)).otherwise(F.lit(1.0))
    return (
        flags.select("snp", F.col("gene_key").cast("string").alias("gene"), F.explode(F.array(*parts)).alias("x"))
        .select("snp", "gene", "x.rule", "x.prob").filter(F.col("prob").isNotNull())
    )
