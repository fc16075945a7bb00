"""One fit at every size: a region in many tiles against the same region in one, from genotypes and from a matrix."""

import numpy as np
import pytest

from locusloom.operators import alignment
from locusloom.operators import finemap as fm
from locusloom.operators import finemap_large as tiled
from locusloom.operators import signals as sg
from tests.test_statistics import _panel

KW = dict(key_type="int", id_type="bigint")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """The many small passes of these tests are about order of work, not spread."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def _region(m, seed, region=1, shift=0):
    u = _panel(m, 40, seed)
    z = 12 * (u @ u[m // 4]) + 10 * (u @ u[m - 10])
    return u, z, [(region, shift + i, float(z[i]), 5000, u[i].tolist()) for i in range(m)]


def _members(spark, rows):
    return spark.createDataFrame(rows, "region_id int, id bigint, z double, n bigint, u array<double>")


def _equal(near, far):
    near, far = ({(r.region_id, r.id): r for r in df.collect()} for df in (near, far))
    assert near.keys() == far.keys()
    for key, a in near.items():
        b = far[key]
        assert (a.cs, a.effects, a.converged) == (b.cs, b.effects, b.converged)
        assert (a.pip, a.elbo) == pytest.approx((b.pip, b.elbo), abs=1e-6)


def test_many_tiles_equal_one_tile_with_the_number_of_effects_chosen(spark):
    rows = _region(32, 11)[2] + _region(16, 12, region=2, shift=100)[2] + _region(5, 13, region=3, shift=200)[2]
    df = _members(spark, rows)
    near, far = fm.susie_finemap(df, grid=(1, 2), **KW), fm.susie_finemap(df, grid=(1, 2), tile_bytes=6 * 42 * 8, **KW)
    assert tiled.genotype_tiles(df, 6 * 42 * 8).filter("region_id = 1").count() > 5
    _equal(near, far)
    best = {r.region_id: r for r in near.select("region_id", "effects", "converged").distinct().collect()}
    assert best[1].effects >= 2 and all(r.converged for r in best.values())


def _pairs(r, region=1):
    return [(region, i, j, float(r[i, j])) for i in range(len(r)) for j in range(i + 1, len(r))]


def test_fit_from_a_matrix_equals_fit_from_genotypes(spark):
    u, z, rows = _region(12, 21)
    stats = spark.createDataFrame([(1, i, i, float(z[i]), 5000) for i in range(12)], "region_id int, place long, id bigint, z double, n bigint")
    pairs = spark.createDataFrame(_pairs(u @ u.T), "region_id int, i long, j long, r double")
    _equal(fm.susie_finemap(_members(spark, rows), 2, **KW), fm.susie_finemap_matrix(stats, pairs, 2, **KW))
    whole, cut = (fm.susie_finemap_matrix(stats, pairs, 1, tile_bytes=b, **KW) for b in (32 << 20, 6 * 16 * 8))
    _equal(whole, cut)


def test_a_matrix_with_a_negative_eigenvalue_is_lifted_at_every_size(spark):
    r = np.array(_panel(9, 60, 3) @ _panel(9, 60, 3).T)
    r[0, 1] = r[1, 0] = 0.95
    r[0, 2] = r[2, 0] = -0.95
    r[1, 2] = r[2, 1] = 0.95
    assert np.linalg.eigvalsh(r)[0] < -0.1 and fm.psd_repair(r)[0, 0] == pytest.approx(1 + 1e-6)
    good = _panel(9, 60, 4) @ _panel(9, 60, 4).T
    stats = spark.createDataFrame([(k, i, i, float(i % 5), 500) for k in (1, 2) for i in range(9)], "region_id int, place long, id bigint, z double, n bigint")
    pairs = spark.createDataFrame(_pairs(r) + _pairs(good, 2), "region_id int, i long, j long, r double")
    tiles = tiled.matrix_tiles(stats, pairs, 4 * 11 * 8)
    regions = tiles.select("region_id", "n", "rows", "width").distinct()
    lifts = {x.region_id: x.lift for x in tiled._lifts(tiles, regions, lambda df: df, "int").collect()}
    assert lifts == {1: 1e-6, 2: 0.0}


def test_fit_of_aligned_rows_and_columns(spark):
    """Half of the variants are in the statistics, some with their alleles turned: the fit is that of the cut matrix."""
    u, z, _ = _region(30, 31)
    keep = [i for i in range(30) if i % 3 != 1]
    turned = {i for i in keep if i % 4 == 0}
    panel = spark.createDataFrame([(1, 1, 100 * i, "A", "C") for i in range(30)], "region_id int, chr int, bp long, a1 string, a2 string")
    stats = spark.createDataFrame(
        [(1, 1, 100 * i, *(("C", "A") if i in turned else ("A", "C")), float(-z[i] if i in turned else z[i]), 5000) for i in keep],
        "region_id int, chr int, bp long, a1 string, a2 string, z double, n long")
    pairs = spark.createDataFrame([(1, i, j, float((u @ u.T)[i, j])) for i in range(30) for j in range(30)], "region_id int, i long, j long, r double")
    placed = alignment.align_to_panel(stats, panel, ["z", "n"])
    cut = alignment.aligned_matrix(pairs, placed)
    got = {r.id: r.pip for r in fm.susie_finemap_matrix(placed, cut, 2, key_type="int", id_type="string").collect()}
    sign = np.array([-1 if i in turned else 1 for i in keep])
    part = u[keep]
    fit = fm.single_effects_of_matrix(z[keep] * sign, (part @ part.T) * np.outer(sign, sign), 5000, 2)
    assert [got[f"1:{100 * i}:C:A"] for i in keep] == pytest.approx(fit.pip.tolist(), abs=1e-9)


def test_signals_do_not_depend_on_the_tiles(spark):
    u, z, _ = _region(50, 41)
    rows = [(1, i, float(z[i]), 0.3, u[i].tolist()) for i in range(50)] + [(2, 100, 9.0, 0.3, u[0].tolist())]
    df = spark.createDataFrame(rows, "region_id int, id bigint, z double, frq double, u array<double>")
    whole, cut = (sorted(map(tuple, sg.select_signals(df, tile_bytes=b).collect())) for b in (32 << 20, 5 * 42 * 8))
    assert [r[:2] for r in whole] == [r[:2] for r in cut] and len(whole) >= 2
    assert np.allclose([r[2:5] for r in whole], [r[2:5] for r in cut])
