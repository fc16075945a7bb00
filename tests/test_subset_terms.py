from locusloom.operators import enrichment as en


def test_sets_given_by_module_equal_sets_given_by_variant(spark):
    terms = [("t1", "a"), ("t1", "b"), ("t2", "b"), ("t2", "b"), ("t3", "a"), ("t3", "d"), ("t4", None), ("t4", "a"), ("t5", "z")]
    genes = [(1, "a"), (1, "b"), (1, "a"), (2, "d"), (2, None), (3, "q"), (None, "z")]
    member = [("s1", 1), ("s1", 1), ("s2", 1), ("s2", 2), ("s3", 2), ("s4", 3), ("s5", None), (None, 1), (None, 2), ("s6", 9)]
    significant = spark.createDataFrame(terms, "term string, gene string")
    modules = spark.createDataFrame(member, "snp string, module int")
    coexpressed = spark.createDataFrame(genes, "module int, gene string")
    got = [tuple(r) for r in en.subset_terms(significant, coexpressed, modules).collect()]
    flat = [tuple(r) for r in en.subset_terms(significant, modules.join(coexpressed, "module").select("snp", "gene")).collect()]
    want = {("s1", "t1"), ("s1", "t2"), ("s2", "t1"), ("s2", "t2"), ("s2", "t3"), (None, "t1"), (None, "t2"), (None, "t3")}
    assert set(got) == set(flat) == want and len(got) == len(flat) == len(want)
