"""Hard negatives against every score."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusloom.llm import hard_negatives
from locusloom.llm.hard_negatives import Tile


def plain(rows, every=50, positives=5, negatives=3, low=50, high=95):
    use = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows
           if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for i, label, v in use:
        if i % every:
            continue
        scored = [(-cut(sum(a * b for a, b in zip(v, w, strict=True))), j, m) for j, m, w in use if j != i and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted(x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)[:negatives]
            out += [(i, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, m, v, 7) for i, m, v in rows], "vec_id long, label int, embedding array<double>, rank int")
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, F.col("label")).collect()))


def clouds(seed, n, dim):
    rng = np.random.default_rng(seed)
    label = rng.choice(6, n, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05])
    rows = rng.normal(size=(6, dim))[label] * 0.5 + rng.normal(scale=0.4, size=(n, dim)) + 0.3
    rows *= rng.choice([0.1, 1.0, 1.0, 4.0], n)[:, None]
    rows[n // 2 : n // 2 + n // 10] = rows[0]
    return [(int(i), int(m), [float(x) for x in r]) for i, (m, r) in enumerate(zip(label, rows, strict=True))]


@pytest.mark.parametrize(("seed", "dim", "tile", "slot"), [(1, 8, 150, 7), (2, 13, 64, 30), (3, 1, 90, 9), (4, 3, 4000, 4000)])
def test_matches_every_score(spark, monkeypatch, seed, dim, tile, slot):
    for name, size in (("TILE", tile), ("SLOT", slot), ("BLOCK", 40), ("STRIP", 5)):
        monkeypatch.setattr(hard_negatives, name, size)
    rows = clouds(seed, 1000, dim)
    expected = plain(rows)
    assert len(expected) > 50
    assert mined(spark, rows) == expected


ODD = [
    (0, 1, [1.0, 0.5, 0.0, 0.2]), (50, 1, [0.9, 0.4, 0.1, 0.2]), (1, 1, [1.0, 0.5, 0.0, 0.2]), (1, 1, [1.0, 0.5, 0.0, 0.2]), (2, 2, [0.6, 0.3, 0.0, 0.1]),
    (2, 2, [0.6, 0.3, 0.0, 0.1]), (3, None, [0.7, 0.3, 0.0, 0.1]), (None, 2, [0.7, 0.3, 0.0, 0.1]), (4, 2, None), (5, 2, [None, 1.0, 0.0, 0.0]),
    (6, 2, [float("nan"), 1.0, 0.0, 0.0]), (7, 2, []), (8, 2, [0.8, 0.2]), (100, 1, [0.8, 0.2]), (9, 1, [0.9, 0.3]), (150, 3, [-1.0, 0.0, 0.0, 0.0]),
    (10, 3, [1.0, 0.0, 0.0, 0.0]), (200, 4, [0.0, 0.0, 0.0, 0.0]), (11, 4, [0.0, 0.0, 0.0, 0.0]), (50, 2, [0.9, 0.4, 0.1, 0.2]), (0, 1, [1.0, 0.5, 0.0, 0.2]),
]


def test_odd_rows(spark):
    assert mined(spark, ODD) == plain(ODD)
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0, 2.0])]) == []


def test_huge_components(spark):
    rows = [(0, 1, [1e17, 1e17]), (1, 1, [1e17, 1.0]), (2, 2, [1e17, -2e16]), (3, 2, [1.0, 1.0]), (50, 1, [1e38, 5.0]), (4, 2, [0.0, 1.0]), (5, 1, [0.0, 1.0])]
    assert mined(spark, rows) == plain(rows)


@pytest.mark.parametrize("dim", [1, 2, 7, 64])
def test_bounds_hold_at_every_level_and_open_less(dim):
    rng = np.random.default_rng(dim)
    rows = np.floor(256 * (rng.normal(size=(300, dim)) * rng.uniform(0.01, 3, (300, 1)) + rng.normal(size=dim)))
    means, devs = hard_negatives.summaries(rows)
    size = np.sqrt((rows**2).sum(axis=1))
    raw = {"dim": dim, "kind_a": "<f8", "ids_a": np.arange(300).tobytes(), "labels_a": np.zeros(300, "<i8").tobytes(),
           "sizes_a": size.tobytes(), "vecs_a": rows.tobytes(), "means_a": means.tobytes(), "devs_a": devs.tobytes()}
    tile = Tile(raw, "a")
    exact = rows @ rows.T
    left = []
    for upto in range(1, len(tile.levels) + 1):
        part = tile.block(0, 300)
        part.levels = tile.levels[:upto]
        for need, cap in ((exact.max() / 3, exact.max()), (exact.min(), exact.min() / 3)):
            open_ = hard_negatives.reachable(part, part, np.full(300, need), np.full(300, cap), np.ones((300, 300), bool))
            assert open_[(exact >= need) & (exact <= cap)].all()
            left.append(open_.sum())
    assert left[-2] <= left[0] and left[-1] <= left[1]
