"""Members of a term: ancestors travel as pages, links are copied only where a step climbs them."""

from pyspark.sql import functions as F

from locusloom.operators import ontology as on

LINKS = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("e", "d"), ("d", "r"), ("b", "r"), ("e", None), (None, "r"), ("a", "b")]


def _paths():
    """Shortest steps up between all nodes, the links as they are given."""
    up = {n: {p for c, p in LINKS if c == n and n is not None} for n in {x for link in LINKS for x in link}}
    out = {}
    for node in up:
        seen, front, depth = {node: 0}, {node}, 0
        while front:
            depth += 1
            front = {p for n in front for p in up.get(n, ()) if p not in seen}
            seen |= dict.fromkeys(front, depth)
        out |= {(node, a): d for a, d in seen.items()}
    return out


def test_members_equal_shortest_paths_with_copies_cycles_and_nulls(spark):
    closure = on.ancestors(spark.createDataFrame(LINKS, "child string, parent string"))
    paths = _paths()
    assert {(r.node, r.ancestor): r.depth for r in closure.collect()} == paths and closure.count() == len(paths)
    base = [(1, "a"), (1, "a"), (1, "e"), (2, "c"), (None, "d"), (None, "d"), (3, None), (4, "x")]
    want = {}
    for gene, term in base:
        for (node, up), depth in paths.items():
            if node == term and term is not None:
                want[gene, up] = min(depth, want.get((gene, up), depth))
    members = on.term_members(spark.createDataFrame(base, "gene long, term string"), closure)
    assert {(r.gene, r.term): r.depth for r in members.collect()} == want and members.count() == len(want)


def test_a_step_copies_the_links_it_climbs_and_members_meet_pages(spark, monkeypatch):
    copied, joined = [], on.salted_join

    def seen(frontier, links, keys):
        copied.append(links.count())
        return joined(frontier, links, keys)

    monkeypatch.setattr(on, "salted_join", seen)
    edges = spark.range(1, 300).select(F.col("id").alias("child"), F.floor(F.col("id") / 3).cast("long").alias("parent"))
    closure = on.ancestors(edges)
    assert copied == [299, 99, 33, 11, 3, 1, 0]
    members = on.term_members(spark.range(50).select(F.col("id").alias("gene"), F.col("id").alias("term")), closure)
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline(__ways" in plan and members.count() == closure.filter("node < 50").count()
