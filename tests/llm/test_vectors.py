import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusloom.llm import embedding_dedup, topk

ODD = [
    (0, [1.0, 0.0, 0.0, 0.0]), (1, None), (2, [float("nan"), 0.0, 0.0, 0.0]), (3, [None, 1.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0, 0.0]),
    (5, [2.0, 0.1, 0.0, 0.0]), (6, [1.0, 0.0, 0.0, 0.0]), (6, [0.0, 1.0, 0.0, 0.0]), (7, [1.0, 0.0]), (50, [1.0, 0.0, 0.0, 0.0]),
    (100, [0.0, float("inf"), 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (150, [-3.0, 0.5, 0.0, 0.0]), (8, []),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, q string")


def plain_topk(rows, every=50, k=5):
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in use:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in use if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def clouds(seed, n, dim):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    rows = centre[rng.integers(0, 6, n)] + rng.normal(scale=rng.choice([0.02, 0.2, 1.0], n)[:, None], size=(n, dim))
    rows *= rng.choice([0.1, 1.0, 1.0, 5.0], n)[:, None]
    rows[n // 2 : n // 2 + n // 10] = rows[0]
    return [(int(i), [float(x) for x in row]) for i, row in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_topk_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "GROUP", 150)
    monkeypatch.setattr(topk, "SLOT", 9)
    monkeypatch.setattr(topk, "BUCKET", 32)
    rows = clouds(seed, 1000, 8)
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == plain_topk(rows)


@pytest.mark.parametrize("dim", [1, 2, 16])
def test_topk_with_a_dominant_coordinate(dim):
    """Coordinates beyond the threshold, over many small buckets of varying length."""
    rng = np.random.default_rng(dim)
    rows = rng.normal(scale=0.3, size=(3000, dim))
    rows[:, 0] += rng.choice([-1.0, 1.0], 3000)
    rows = np.floor(256 * rows * rng.uniform(0.1, 4.0, 3000)[:, None])
    ids = np.arange(3000)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(topk, "BUCKET", 16)
        got = topk.search(rows[:40], ids[:40], np.full(40, -np.inf), rows, ids, 5)
    for q in range(40):
        score = (rows[q] @ rows.T).astype(int)
        assert got[q] == sorted((-int(s), int(i)) for i, s in zip(ids, score, strict=True) if i != q)[:5]


def test_topk_odd_rows(spark):
    got = topk.top_k(frame(spark, ODD), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == plain_topk(ODD)
    assert topk.top_k(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    huge = [(0, [1e17, 1e17]), (1, [1e17, 1.0]), (2, [-1e17, -1e17])]
    assert [r.score for r in topk.top_k(frame(spark, huge), F.col("vec_id") == 0).collect()] == [2**63 - 1, -(2**63)]


def plain_links(rows, cosine=0.9):
    use = [(n, np.array(v, float)) for n, (i, v) in enumerate(rows)
           if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(use)):
        for b in range(a):
            (i, x), (j, y) = use[a], use[b]
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), math.inf), math.inf if name is None else name)
    return sorted((name, links[i], least[find(i)], name == least[find(i)]) for i, (name, _) in enumerate(rows) if name is not None)


@pytest.mark.parametrize(("seed", "dim"), [(3, 16), (4, 3), (5, 9)])
def test_dedup_matches_brute_force(spark, monkeypatch, seed, dim):
    monkeypatch.setattr(embedding_dedup, "TILE", 60)
    monkeypatch.setattr(embedding_dedup, "STRIP", 16)
    monkeypatch.setattr(embedding_dedup, "VERIFY", 50)
    rows = clouds(seed, 500, dim)
    got = embedding_dedup.near_duplicates(frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == plain_links(rows)


def test_dedup_odd_rows(spark):
    got = [tuple(r) for r in embedding_dedup.near_duplicates(frame(spark, ODD)).collect()]
    assert (None, 0, None, False) in got
    assert sorted(r for r in got if r[0] is not None) == plain_links(ODD)
    assert embedding_dedup.near_duplicates(frame(spark, [])).count() == 0
