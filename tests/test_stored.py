"""Stored tables: read-back after changes, untouched files, repeated changes; pattern look-up against plain search."""

import random

from pyspark.sql import functions as F

from locusloom.operators import retrieval as rt
from locusloom.sources.stored import StoredTable


def version():
    return [F.col("at").desc(), F.col("state")]


def _files(table):
    return {f.rsplit("/", 2)[1]: f for f in table._stored().inputFiles()}


def _rows(table):
    return sorted(map(tuple, table.read().collect()))


def test_changes_touch_their_buckets_only(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "runs"), "id long, state string, at long", ["id"], buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, "id long, state string, at long")
    assert _rows(table) == [] and table.commits() == []
    assert table.upsert(frame([(i, "new", 1) for i in range(40)]), version(), "a")
    before = _files(table)
    assert len(before) > 4
    assert table.upsert(frame([(3, "done", 2), (3, "late", 0), (4, "old", 0)]), version(), "b")
    want = {i: (i, "new", 1) for i in range(40)} | {3: (3, "done", 2)}
    assert _rows(table) == sorted(want.values())
    hit = {f"bucket={r[0]}" for r in table._bucketed(frame([(3, "", 0), (4, "", 0)])).select("bucket").collect()}
    after = _files(table)
    assert {b for b in before if before[b] != after[b]} == hit
    assert not table.upsert(frame([(3, "again", 9)]), version(), "b")  # a repeated change does nothing
    assert table.replace(frame([(5, "x", 7), (5, "y", 8), (99, "z", 1)]), ["id"], "c")
    del want[5]
    assert _rows(table) == sorted([*want.values(), (5, "x", 7), (5, "y", 8), (99, "z", 1)])
    assert table.commits() == ["a", "b", "c"]


def test_a_stream_writes_every_batch_once(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "runs"), "id long, state string, at long", ["id"], buckets=4)
    write = table.sink(version())
    batch = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, state string, at long")
    write(batch, 0)
    write(batch, 0)
    write(spark.createDataFrame([(1, "c", 2)], "id long, state string, at long"), 1)
    assert _rows(table) == [(1, "c", 2), (2, "b", 1)] and len(table.commits()) == 2


def test_pattern_look_up_equals_plain_search(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abÉßx. ") for _ in range(rng.randint(1, 6)))
    texts = [(i, None if i == 3 else "".join(word() for _ in range(12)).upper() if i % 2 else "".join(word() for _ in range(12))) for i in range(60)]
    patterns = [(f"p{i}", word()) for i in range(80)] + [("none", None), ("empty", ""), ("twice", "ab"), ("twice", "ab")]
    monkeypatch.setattr(rt, "CHUNK_BYTES", 400)
    low = {r.t: r.l for r in spark.createDataFrame([(t,) for _, t in texts + patterns if t], "t string").select("t", F.lower("t").alias("l")).collect()}
    want = sorted((i, p) for i, t in texts for p, x in patterns if t and x and low[x] in low[t])
    got = rt.contains_pairs(spark.createDataFrame(texts, "i long, t string"), spark.createDataFrame(patterns, "p string, x string"), "i", "t", "p", "x")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    none = rt.contains_pairs(spark.createDataFrame(texts, "i long, t string"), spark.createDataFrame([], "p string, x string"), "i", "t", "p", "x")
    assert none.count() == 0
