from locusloom.operators import evidence as ev


def test_ranks_of_repeated_rows_and_paged_targets(spark, monkeypatch):
    monkeypatch.setattr(ev, "_TARGETS", 2)
    hits = [("t1", "s1", -0.5, "loss"), ("t1", "s1", -0.5, "loss"), ("t1", "s1", 0.5, "gain"), ("t2", "s1", 0.7, "gain"), ("t2", "s2", None, "gain"),
            ("t1", "s2", 0.1, "gain"), ("t2", "s1", 0.9, "none"), ("t1", None, 0.2, "gain"), (None, "s2", 0.3, "gain")]
    regulates = [("t1", g) for g in range(7)] + [("t2", 0), ("t2", 0), ("t2", None)]
    got = ev.rank_tfs(spark.createDataFrame(hits, "tf string, snp string, score double, effect string"),
                      spark.createDataFrame(regulates, "tf string, gene_key int"))
    plan = got._jdf.queryExecution().toString()
    rows = {(t, s, x, g) for t, s, x, e in hits if e in ("loss", "gain") and t for f, g in regulates if f == t}
    want = []
    for key in {(s, g) for _, s, _, g in rows}:
        mine = sorted((r for r in rows if (r[1], r[3]) == key), key=lambda r: (r[2] is None, -abs(r[2] or 0), r[0], r[2] or 0))
        want += [(*key, t, None if x is None else abs(x), i + 1) for i, (t, _, x, _) in enumerate(mine)]
    order = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)
    physical = plan[plan.index("== Physical Plan =="):]
    after = physical[:physical.index("Generate inline")]
    assert "Exchange" not in after  # no row per variant, factor and gene is shuffled
