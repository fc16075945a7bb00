import numpy as np
import pytest

from locusloom.functions.session import BATCH
from locusloom.operators import finemap as fm
from locusloom.operators import finemap_large as tiled
from tests.test_statistics import _panel

KW = dict(key_type="int", id_type="bigint")


def _banded(spark, m=40, band=4, skip=7):
    """Statistics at every place but ``skip``, and a matrix with few pairs a row that has a negative eigenvalue."""
    u = _panel(m, 40, 5)
    r, z = u @ u.T, 8 * (u @ u[m // 3]) + 0.1
    pairs = [(1, i, j, 0.9 if j == i + 1 else float(r[i, j])) for i in range(m) for j in range(i + 1, min(i + band, m))]
    stats = [(1, i, i, float(z[i]), 5000) for i in range(m) if i != skip]
    return (spark.createDataFrame(stats, "region_id int, place long, id bigint, z double, n bigint"),
            spark.createDataFrame(pairs, "region_id int, i long, j long, r double"), pairs, skip)


def test_tiles_of_a_matrix_grow_with_its_pairs(spark):
    stats, pairs, given, skip = _banded(spark)
    kept = [p for p in given if skip not in p[1:3]]
    one, many = (tiled.matrix_tiles(stats, pairs, b).collect() for b in (32 << 20, 24 * 30))
    assert len(one) == 1 and len(many) > 5 and all(t.tiles == len(many) for t in many)
    for tiles in (one, many):
        assert sum(len(t.matrix) for t in tiles) == 2 * len(kept)
        assert sorted(p for t in tiles for p in t.at) == [i for i in range(40) if i != skip]
    assert max(len(t.matrix) for t in many) <= 30 + 6


@pytest.mark.parametrize("tile_bytes", [1, 32 << 20])
def test_fit_by_entries_equals_fit_of_the_whole_matrix(spark, monkeypatch, tile_bytes):
    stats, pairs, given, skip = _banded(spark)
    at = np.array([i for i in range(40) if i != skip])
    r = np.eye(40)
    for _, i, j, x in given:
        r[i, j] = r[j, i] = x
    r = r[np.ix_(at, at)]
    assert np.linalg.eigvalsh(r)[0] < -0.01
    tile = tiled.matrix_tiles(stats, pairs, 32 << 20).head()
    monkeypatch.setattr(fm, "TILE_BYTES", tile_bytes)
    block = tiled._whole_block(tile)
    assert isinstance(block.rows, fm.Entries) == (tile_bytes == 1)
    z = np.array(tile.z)
    got, want = fm.fit_block(block, 5000, 2), fm.single_effects_of_matrix(z, r, 5000, 2)
    assert got.pip == pytest.approx(want.pip, abs=1e-9) and got.elbo == pytest.approx(want.elbo, abs=1e-6)
    sets = lambda fit, u: [s.tolist() for s in fm.credible_sets(fit, u, 0.95, 0.0, True)]
    assert sets(got, block.rows) == sets(want, r)


def test_a_task_gets_its_tiles_in_bounded_batches(spark):
    old = {k: spark.conf.get(k) for k in BATCH}
    try:
        for k in BATCH:
            spark.conf.unset(k)
        u = _panel(6, 40, 5)
        rows = [(1, i, float(i), 5000, u[i].tolist()) for i in range(6)]
        fm.susie_finemap(spark.createDataFrame(rows, "region_id int, id bigint, z double, n bigint, u array<double>"), 1, **KW)
        assert {k: spark.conf.get(k) for k in BATCH} == BATCH
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
