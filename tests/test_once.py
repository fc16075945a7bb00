"""Steps that read their input twice or more compute it once."""

import itertools

from pyspark.sql import functions as F

from locusloom.operators import finemap as fm
from locusloom.operators import harmonise as hz


def _counted(spark, rows, columns, name, kind):
    """The rows, and an accumulator that counts how often one of them is computed, seen by column ``name``."""
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    touch = F.udf(look, kind)
    return spark.createDataFrame(rows, columns).withColumn(name, touch(name)), seen


def test_credible_sets_compute_their_statistics_once(spark):
    rows = [(f"r{i % 3}", f"v{i:03d}", (i * 7 % 11) / 3.0, 0.05 + i % 5 / 50) for i in range(60)]
    stats, seen = _counted(spark, rows, "region_id string, id string, z double, se double", "se", "double")
    sets = fm.credible_set(fm.abf_pips(stats, ["region_id"]), ["region_id"], [F.round("lbf", 9).desc(), F.col("id")])
    found = {(r.region_id, r.id) for r in sets.collect()}
    assert seen.value == len(rows)

    import math

    want = set()
    lbf = lambda z, se: 0.5 * math.log(se**2 / (se**2 + 0.04)) + 0.5 * z**2 * 0.04 / (se**2 + 0.04)
    for region, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        ranked = sorted(((round(lbf(z, se), 9), id_) for _, id_, z, se in group), key=lambda x: (-x[0], x[1]))
        total, before = sum(math.exp(b) for b, _ in ranked), 0.0
        for b, id_ in ranked:
            if before < 0.95:
                want.add((region, id_))
            before += math.exp(b) / total
    assert found == want


def test_first_rows_by_key_take_one_pass_and_keep_rows_without_a_key(spark):
    rows = [(None if i % 4 == 0 else f"rs{i % 10}", None if i % 5 == 0 else i % 3, i / 100.0) for i in range(40)] * 2
    df, seen = _counted(spark, rows, "snp string, pos int, p double", "snp", "string")
    out = hz.first_by_key(df, ["snp", "pos"], [F.col("p")])
    assert out.columns == df.columns
    got = sorted((r.snp or "", -1 if r.pos is None else r.pos, r.p) for r in out.collect())
    assert seen.value == len(rows)
    whole = [r for r in rows if r[0] is not None and r[1] is not None]
    want = [(k[0], k[1], min(r[2] for r in whole if r[:2] == k)) for k in {r[:2] for r in whole}]
    want += [(r[0] or "", -1 if r[1] is None else r[1], r[2]) for r in rows if r[0] is None or r[1] is None]
    assert got == sorted(want)
