import re

import pytest
from pyspark.sql import functions as F

from locusloom.llm import mixing


def plain_targets(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not above:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in above:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= above
    return out


def test_targets_and_words_taken(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").drop("n_chars")
    rows = mixing.mix(docs).collect()
    texts = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == len(texts)
    sizes = {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id].text or ""))
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want, taken = plain_targets(sizes), {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= 0.02 * want[source] + 20
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


def test_rates_solve_the_dual(spark):
    cells = spark.createDataFrame([("0a", 10, 5), ("0a", 100, 5), ("0a", 1000, 1), ("0b", 3, 4)], "key string, size long, n long")
    wanted = spark.createDataFrame([("0a", 1550, 900.0), ("0b", 12, 24.0)], "key string, source_size long, target double")
    solved = {r.key: r for r in mixing.multipliers(cells, wanted, 2.0).collect()}
    assert set(solved) == {"0a"}  # a full source needs no multiplier
    from math import exp

    got = sum(n * s * min(2.0, exp(solved["0a"].k * s / solved["0a"].scale)) for s, n in ((10, 5), (100, 5), (1000, 1)))
    assert got == pytest.approx(900, rel=1e-6)


def test_odd_rows(spark, documents, odd_rows):
    rows = mixing.mix(documents(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    assert {r.taken for r in rows if r.doc_id in (1, 2, 3)} == {0}
    again = mixing.mixture(documents(odd_rows))
    assert again.columns == ["doc_id", "text", "lang", "source", "n_chars", "line"]
    assert taken_rows(documents(odd_rows)) == copied_rows(documents(odd_rows))
    assert mixing.mix(documents([])).count() == 0


def taken_rows(docs):
    return sorted((tuple(r) for r in mixing.mixture(docs).collect()), key=str)


def copied_rows(docs):
    """Every row as often as its copies say; ``also`` carries a place that only the test knows."""
    numbered = docs.coalesce(1).withColumn("place", F.monotonically_increasing_id())
    whole = F.xxhash64(*docs.columns)
    copies = {}
    for r in mixing.mixed_copies(docs.withColumn("whole", whole), also=("whole",)).collect():
        copies.setdefault(r.whole, []).append(r.copies)
    out = []
    for r in numbered.withColumn("whole", whole).collect():
        out += [tuple(r[c] for c in docs.columns)] * copies[r.whole].pop()
    return sorted(out, key=str)


def test_rows_equal_in_id_and_text_stay_apart(spark):
    rows = [("1", "a b c d", "A", 1), ("1", "a b c d", "B", 2), ("1", "a b c d", "B", 3), ("2", "a b c d e f", "A", 4), ("3", "a b c d e", "B", 5), ("3", "a b c d e", "B", 5), (None, "x y", "A", 6), (None, "x y", "A", 7)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, place2 int")
    got = taken_rows(docs)
    assert got == copied_rows(docs)
    assert all(got.count(r) <= 2 * rows.count(r) for r in rows) and set(got) <= set(rows)
