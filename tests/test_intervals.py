"""Range joins and two-level windows against plain brute force."""

import random

import pytest
from pyspark.sql import functions as F

from locusloom.functions.running import numbered, running
from locusloom.operators import intervals as iv


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    points = [(i, rng.choice([1, 2]), rng.choice([500, rng.randrange(5000)])) for i in range(300)]
    features = [(i, rng.choice([1, 2]), s, s + rng.choice([10, 900])) for i, s in enumerate(rng.randrange(5000) for _ in range(60))]
    return points, features


@pytest.mark.parametrize("spanning", [False, True])
def test_within_k_distance(spark, rows, spanning):
    points, features = rows
    p = spark.createDataFrame(points, "id int, chr int, pos bigint")
    f = spark.createDataFrame(features, "fid int, chr int, s bigint, e bigint")
    got = sorted((r.id, r.fid) for r in iv.within_k_distance(p, f, 100, "pos", "s", "e", spanning).collect())
    want = sorted(
        (i, j) for i, c, x in points for j, d, s, e in features
        if c == d and (abs(x - s) <= 100 or abs(x - e) <= 100 or (spanning and s <= x <= e)))
    assert got == want and len(got) == len(set(got))


def test_contained_in_is_strict(spark):
    inner = spark.createDataFrame([(1, 1, 10, 20), (2, 1, 5, 20), (3, 1, 11, 30), (4, 2, 10, 20)], "a int, chr int, s bigint, e bigint")
    outer = spark.createDataFrame([(9, 1, 5, 30)], "b int, chr int, os bigint, oe bigint")
    assert [r.a for r in iv.contained_in(inner, outer, "s", "e", "os", "oe").collect()] == [1]


def test_merge_intervals(spark, rows):
    _, features = rows
    f = spark.createDataFrame(features, "fid int, chr int, s bigint, e bigint")
    got = sorted(tuple(r) for r in iv.merge_intervals(f, ["chr"], "s", "e", width=300).select("chr", "s", "e").collect())
    want = []
    for c in (1, 2):
        cur = None
        for s, e in sorted((s, e) for _, d, s, e in features if d == c):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
            else:
                cur = [s, e]
                want.append((c, cur))
    assert got == sorted((c, a, b) for c, (a, b) in want)


@pytest.mark.parametrize("how,exclusive", [("sum", False), ("sum", True), ("max", True), ("min", False)])
def test_running_equals_one_window(spark, how, exclusive):
    from pyspark.sql import Window

    rng = random.Random(3)
    df = spark.createDataFrame([(i % 2, i, rng.random(), rng.randrange(100)) for i in range(400)], "k int, id int, x double, v int").cache()
    got = running(df, ["k"], F.floor(F.col("x") * 16), [F.col("x"), F.col("id")], F.col("v"), "out", how=how, exclusive=exclusive)
    w = Window.partitionBy("k").orderBy("x", "id").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    plain = df.withColumn("out", getattr(F, how)("v").over(w))
    if how == "sum":
        plain = plain.fillna(0, ["out"])
    key = lambda d: sorted((r.k, r.id, -1 if r.out is None else r.out) for r in d.collect())
    assert key(got) == key(plain)


def test_numbered_without_keys(spark):
    df = spark.range(100).withColumn("id", 99 - F.col("id"))
    got = {r.id: r.n for r in numbered(df, [], F.floor(F.col("id") / 7), [F.col("id")], "n").collect()}
    assert got == {i: i + 1 for i in range(100)}


def test_region_members_need_two_rows(spark):
    leads = spark.createDataFrame([("a", 1, 5_000_000), ("b", 1, 90_000_000)], "region_id string, chr int, center bigint")
    stats = spark.createDataFrame([(1, 3_000_000), (1, 7_000_000), (1, 7_000_001), (1, 90_000_000)], "chr int, bp bigint")
    got = sorted(r.bp for r in iv.region_members(leads, stats).collect())
    assert got == [3_000_000, 7_000_000]
