"""Candidate genes: pages of genes meet the variants, pairs are laid out after the one shuffle by variant."""

import re

from pyspark.sql import functions as F

from locusloom.functions.running import paged
from locusloom.operators import evaluate as el
from locusloom.operators import evidence as ev
from locusloom.plans import catalog  # noqa: F401
from locusloom.plans.fixtures import Fixtures
from locusloom.plans.registry import JOBS

VARIANTS = [("rs1", 1, 600_000, 1), ("rs1", 1, 9_000_000, 3), ("RS1", 1, 600_000, 1), ("rs2", 2, 100, 7), ("rs3", 3, 5, 2), (None, 1, 1_000_000, 2)]
GENES = [
    (1, "g1", 1, 0, 1000), (1, "G1", 1, 0, 1000), (2, "g2", 1, 1_100_000, 1_101_000), (3, "g3", 1, 5_000_000, 8_600_000),
    (4, None, 2, 0, 90), (5, "g5", 5, 0, 10), (6, "g6", 1, 9_400_000, 9_300_000), (None, "g0", 2, 0, 90),
]
TADS = [(1, "a"), (5, "a"), (1, "b"), (8, "b"), (2, None), (None, "a"), (3, "c"), (6, "c"), (6, "c")]
CLOSEST = [("rs1", 1), ("rs1", 3), ("RS1", 1), ("rs2", 7), ("rs3", 2), (None, 2), ("rs4", None)]


def _tables(spark):
    return (
        spark.createDataFrame(VARIANTS, "snp string, chr int, bp long, gene_key long"),
        spark.createDataFrame(GENES, "gene_key long, gene_id string, chr int, g_start long, g_end long"),
        spark.createDataFrame(CLOSEST, "snp string, gene_key long"),
        spark.createDataFrame(TADS, "gene_key long, tad_id string"),
    )


def _domain():
    found = set(CLOSEST)
    return found | {(s, g) for s, own in CLOSEST for k, t in TADS if k is not None and k == own and t for g, u in TADS if u == t}


def _all():
    near = {
        (s, g) for s, c, bp, _ in VARIANTS for g, _, on, a, b in GENES
        if on == c and (abs(bp - a) <= 500_000 or abs(bp - b) <= 500_000) and not (b - a <= 1_000_000 and not a - 500_000 <= bp <= b + 500_000)}
    return _domain() | near


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_candidates_equal_all_pairs_with_nulls_and_copies(spark):
    variants, genes, closest, tads = _tables(spark)
    assert _rows(ev.in_tad_with(closest, tads)) == sorted(_domain(), key=repr)
    assert _rows(ev.candidate_genes(variants, genes, closest, tads)) == sorted(_all(), key=repr)
    want = {}
    for snp, key in _all():
        for other, name, *_ in GENES:
            if key is not None and other == key:
                want.setdefault(snp, set()).add(name)
    sets = [(s, ",".join(sorted({n.upper() for n in v if n})), len({n for n in v if n})) for s, v in want.items()]
    for pairs in (ev.candidate_genes(variants, genes, closest, tads), ev.candidate_genes(variants, genes, closest, tads, "gene_id")):
        assert _rows(ev.candidate_sets(pairs, genes)) == sorted(sets, key=repr)


def test_crowded_domains_and_bins_come_in_pages(spark):
    n = 2500
    genes = spark.range(n).select(F.col("id").alias("gene_key"), F.lit(1).alias("chr"), F.col("id").alias("g_start"), (F.col("id") + 1).alias("g_end"))
    sizes = [len(r.items) for r in paged(genes, ["chr"], ["gene_key"], "items", 100).collect()]
    assert sum(sizes) == n and max(sizes) < 200 and len(sizes) == n / 100
    variants = spark.range(3).select(F.concat(F.lit("rs"), "id").alias("snp"), F.lit(1).alias("chr"), F.col("id").alias("bp"))
    closest, tads = variants.select("snp", F.lit(7).cast("long").alias("gene_key")), genes.select((F.col("gene_key") + 1000).alias("gene_key"), F.lit("t").alias("tad_id"))
    tads = tads.union(spark.createDataFrame([(7, "t")], "gene_key long, tad_id string"))
    assert ev.candidate_genes(variants, genes, closest, tads).groupBy("snp").count().select("count").distinct().collect() == [(n + 1000,)]


def test_pairs_are_laid_out_after_the_last_shuffle(spark):
    variants, genes, closest, tads = _tables(spark)
    sets = ev.candidate_sets(ev.candidate_genes(variants, genes, closest, tads, "gene_id"), genes)
    for df in (ev.in_tad_with(closest, tads), ev.candidate_genes(variants, genes, closest, tads), sets):
        plan = df._jdf.queryExecution().executedPlan().toString()
        above, laid_out, _ = plan.partition("Generate explode(__genes")
        assert laid_out and "Exchange" not in above.split("Initial Plan")[-1], plan


def test_truth_counts_equal_names_once_and_does_not_shuffle_pairs(spark):
    predicted = [("rs1", "G1"), (" RS1", "g1 "), ("RS1", "g2"), ("rs1", None), ("rs1 ", None), ("rs2", "g1"), (None, "g1")]
    gold = [(" RS1", "g1"), (" RS1", "g1"), ("rs1", "G2"), ("rs2", "g2"), ("rs3", "g1"), ("rs1", None), (None, "g1")]
    clean = lambda x: x and x.strip(" ").lower()
    have = {(clean(s), clean(g)) for s, g in predicted}
    want = [
        (clean(s), clean(g), int(None not in (s, g) and (clean(s), clean(g)) in have), sum(s is not None and x == clean(s) for x, _ in have)) for s, g in gold]
    pairs = spark.createDataFrame(predicted, "snp string, gene string")
    assert _rows(el.truth_membership(spark.createDataFrame(gold, "snp string, gene string"), pairs)) == sorted(want, key=repr)
    found = ev.candidate_genes(*_tables(spark)).select("snp", F.col("gene_key").cast("string").alias("gene"))
    plan = el.truth_membership(pairs, found)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(snp#\d+, gene#", plan), plan
    assert el.truth_membership(pairs, found).count() == len(predicted)


def test_variants_of_both_rules_are_computed_once(spark, sf_dir):
    for name in ("candidate_genes", "candidate_sets", "truth_membership"):
        plan = JOBS[name](Fixtures(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
        assert "l_orderkey" not in plan, name
