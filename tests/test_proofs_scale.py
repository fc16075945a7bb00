from pyspark.sql import functions as F

from locusloom.operators import proofs as pf
from locusloom.plans.fixtures import Fixtures
from locusloom.plans import variant_gene


def test_draws_compared_as_text_equal_draws_as_numbers(spark):
    for w in (0.0, 1e-9, 0.0176, 0.34, 0.5, 1 - 2**-33, 1.0, 1.5):
        n = spark.range(500).where((pf.uniform(42, F.col("id"), F.lit("r")) < w) != pf.draws_below(w, 42, F.col("id"), F.lit("r"))).count()
        assert n == 0
    first = spark.range(1).select(pf.uniform(7, F.col("id")).alias("x")).head().x
    same = spark.range(1).select(pf.draws_below(first, 7, F.col("id")), pf.draws_below(first + 2**-32, 7, F.col("id"))).head()
    assert tuple(same) == (False, True)


def _physical(df):
    plan = df._jdf.queryExecution().toString()
    return plan[plan.index("== Physical Plan =="):]


def test_edges_and_nodes_of_a_pair_are_told_apart_without_another_shuffle(spark):
    edge = lambda p, a, b: (p, "snp", a, "gene", b)
    rows = [("s1", "1", "r", "e1", [edge("r", "s1", "1"), edge("x", "s1", "e1")]), ("s1", "1", "r", "e2", [edge("r", "s1", "1"), edge("x", "s1", "e2")]),
            ("s1", "2", "r", "e1", [edge("r", "s1", "2")]), (None, "1", "r", "", [edge("r", None, "1")]), (None, "1", "r", "", [edge("r", None, "1")])]
    df = spark.createDataFrame(rows, "snp string, gene string, rule string, via string, edges array<struct<pred string, src_type string, src string, dst_type string, dst string>>")
    edges = pf.proof_edges(df)
    nodes = pf.proof_nodes(edges)
    assert _physical(nodes).count("Exchange") == 1
    assert {tuple(r) for r in edges.collect()} == {(r[0], r[1], *e) for r in rows for e in r[4]} and edges.count() == 5
    want = {(r[0], r[1], *n) for r in rows for e in r[4] for n in (e[1:3], e[3:5])}
    assert {tuple(r) for r in nodes.collect()} == want and nodes.count() == len(want)


def test_variants_of_a_proof_are_computed_once(spark, sf_dir):
    fx = Fixtures(spark, sf_dir)
    whole = {tuple(r) for r in fx.evidence.collect()}
    kept = variant_gene._links_once(Fixtures(spark, sf_dir))
    assert "lineitem" not in _physical(kept.evidence) and {tuple(r) for r in kept.evidence.collect()} == whole
