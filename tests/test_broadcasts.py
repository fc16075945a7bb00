"""No join may build in the driver what its estimate from a small file makes look small."""

from pyspark.sql import functions as F

from locusloom.functions.running import salted_join
from locusloom.operators import evidence as ev
from locusloom.operators import intervals as iv
from locusloom.operators import ontology as on
from locusloom.plans import variant_gene as vg

N = 200


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def _genes(spark):
    k = F.col("id")
    return spark.range(N).select(
        k.alias("gene_key"), F.concat(F.lit("G"), k.cast("string")).alias("gene_id"), F.lit(1).alias("chr"), (k * 5000).alias("g_start"), (k * 5000 + 1000).alias("g_end"))


def _variants(spark):
    k = F.col("id")
    return spark.range(3 * N).select(
        F.concat(F.lit("rs"), k.cast("string")).alias("snp"), F.lit(1).alias("chr"), (k * 1700).alias("bp"), (k % N).alias("gene_key"))


def _tads(spark):
    return spark.range(N).select(F.col("id").alias("gene_key"), F.floor(F.col("id") / 20).cast("string").alias("tad_id"))


def test_copies_of_an_exploded_side_are_not_broadcast(spark):
    small = spark.range(N).select("id", (F.col("id") * 2).alias("twice"))
    out = salted_join(spark.range(5 * N), small, ["id"])
    assert _broadcasts(out) == 0 and out.count() == N
    ranges = small.select(F.lit(1).alias("chr"), "id", F.col("id").alias("lo"), (F.col("id") + 2).alias("hi"))
    points = spark.range(N).select(F.lit(1).alias("chr"), F.col("id").alias("at"))
    met = iv.range_join(points, ranges, "at", "lo", "hi", 4)
    assert _broadcasts(met) == 0 and met.count() == 3 * N - 3


def test_co_expressed_genes_are_not_broadcast(spark):
    links = _genes(spark).select("gene_key", F.explode(F.array(F.col("gene_key") - 2, F.col("gene_key") + 2)).alias("with_key"))
    out = ev.coexpressed_relevant(_variants(spark).select("snp", "gene_key"), links)
    assert _broadcasts(out) == 0 and out.count() == 6 * N - 12


def test_gene_tables_are_not_broadcast(spark):
    genes, variants, tads = _genes(spark), _variants(spark), _tads(spark)

    class Tables:
        pass

    fx = Tables()
    fx.genes, fx.variants, fx.tads = genes, variants, tads
    near = vg.closest(fx)
    assert _broadcasts(near) == 0 and near.count() == 3 * N
    domain = ev.in_tad_with(near, tads)
    assert _broadcasts(domain) == 0 and domain.count() == 3 * N * 20
    sets = ev.candidate_sets(vg.candidates(fx), genes)
    assert _broadcasts(sets) == 0 and sets.count() == 3 * N


def test_ontology_tables_are_not_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(on, "cut_lineage", lambda df: plans.append(_broadcasts(df)) or df.localCheckpoint())
    edges = spark.range(1, N).select(F.col("id").alias("child"), F.floor(F.col("id") / 3).cast("long").alias("parent"))
    closure = on.ancestors(edges)
    want = sum(1 + next(d for d in range(9) if k // 3**d == 0) for k in range(N))
    assert closure.count() == want and sum(plans) == 0
    members = on.term_members(spark.range(N).select(F.col("id").alias("gene"), F.col("id").alias("term")), closure)
    assert _broadcasts(members) == 0 and members.count() == want
    listed = spark.range(0, N, 3).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("descendant"), F.col("id").alias("ord"))
    tissues = spark.range(2 * N).select(F.col("id").cast("string").alias("tissue"), F.col("id").alias("source_id"))
    mapped = on.map_tissues(tissues, on.descendant_map(listed), closure)
    assert _broadcasts(mapped) == 0 and mapped.count() == 2 * N
