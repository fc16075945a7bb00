"""Numerics with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusloom.functions import stats
from locusloom.operators import enrichment as en
from locusloom.operators import evaluate as ev
from locusloom.operators import finemap as fm
from locusloom.operators import heritability as h2
from locusloom.operators import ld
from locusloom.operators import learning as le
from locusloom.operators import signals as sg


def test_bh_on_five_values(spark):
    p = [0.01, 0.04, 0.03, None, 0.01]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(p)], "k string, id int, p double")
    got = {r.id: r.q for r in en.benjamini_hochberg(df, ["k"], "p", "q").collect()}
    assert got == pytest.approx({0: 0.025, 4: 0.025, 2: 0.05, 1: 0.05, 3: 1.0})


def test_hypergeometric_tail(spark):
    def tail(*xkmn):
        df = spark.createDataFrame([xkmn], "x long, k long, m long, n long")
        return df.select(stats.over_representation_p(*[F.col(c) for c in "xkmn"])).head()[0]

    # 2 of 3 drawn from 10 with 4 marked: (6*6 + 4) / 120
    assert tail(2, 3, 4, 10) == pytest.approx(40 / 120)
    assert tail(0, 3, 4, 10) == 1.0
    exact = sum(math.comb(400, i) * math.comb(9600, 100 - i) for i in range(12, 101)) / math.comb(10000, 100)
    assert tail(12, 100, 400, 10000) == pytest.approx(exact, rel=1e-9)


def test_correlation_p():
    # t = r sqrt(df / (1 - r^2)); for df = 2 the tail is 1 - |r| exactly, for df = 1 arccos
    assert stats.correlation_p([0.5, -0.9], [4, 4]) == pytest.approx([0.5, 0.1], rel=1e-8)
    assert stats.correlation_p([0.5], [3]) == pytest.approx([2 / math.pi * math.acos(0.5)], rel=1e-8)
    assert stats.correlation_p([0.0, 1.0], [10, 10]) == pytest.approx([1.0, 0.0])
    # large n: close to the normal tail of r sqrt(n)
    r, n = 0.02, 10_000
    assert stats.correlation_p([r], [n])[0] == pytest.approx(math.erfc(r * math.sqrt(n) / math.sqrt(2)), rel=0.01)


def test_abf_three_variants(spark):
    df = spark.createDataFrame([("r", i, z, 0.1) for i, z in enumerate([5.0, 1.0, 0.0])], "region_id string, id int, z double, se double")
    got = {r.id: r.pip for r in fm.abf_pips(df, ["region_id"]).collect()}
    bf = [math.exp(0.5 * math.log(0.01 / 0.05) + 0.5 * z * z * 0.8) for z in (5.0, 1.0, 0.0)]
    assert got == pytest.approx({i: b / sum(bf) for i, b in enumerate(bf)})


def test_abf_survives_huge_scores(spark):
    df = spark.createDataFrame([("r", 0, 90.0, 0.01), ("r", 1, 89.0, 0.01)], "region_id string, id int, z double, se double")
    pips = [r.pip for r in fm.abf_pips(df, ["region_id"]).collect()]
    assert sum(pips) == pytest.approx(1.0) and max(pips) > 0.999


def test_credible_set_reaches_coverage(spark):
    df = spark.createDataFrame([("r", i, p) for i, p in enumerate([0.5, 0.3, 0.15, 0.04, 0.01])], "region_id string, id int, pip double")
    got = sorted(r.id for r in fm.credible_set(df, ["region_id"], [F.col("pip").desc(), F.col("id")], 0.9).collect())
    assert got == [0, 1, 2]


def _panel(m, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(m, n))
    for i in range(1, m):
        x[i] = 0.7 * x[i - 1] + 0.7 * x[i]
    u = x - x.mean(1, keepdims=True)
    return u / np.linalg.norm(u, axis=1, keepdims=True)


def test_single_effects_find_the_causal_variants():
    u = _panel(80, 300, 1)
    z = 12 * (u @ u[20]) + 10 * (u @ u[60])
    fit = fm.single_effects(z, u, 5000, 5)
    assert fit.converged and set(np.nonzero(fit.pip > 0.5)[0]) == {20, 60}
    sets = fm.credible_sets(fit, u, 0.95, 0.5)
    assert {20} <= set(np.concatenate(sets)) and len(sets) == 2
    assert np.allclose(fit.alpha.sum(1), 1)
    count, best = fm.choose_effects(z, u, 5000, range(1, 6))
    assert count >= 2 and best.elbo >= fm.single_effects(z, u, 5000, 1).elbo


def test_no_effect_gives_no_set():
    u = _panel(40, 200, 2)
    fit = fm.single_effects(np.zeros(40), u, 5000, 3)
    assert fit.v.max() == 0 and not fm.credible_sets(fit, u, 0.95, 0.5)


def test_psd_repair():
    r = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    assert fm.psd_repair(r)[0, 0] == pytest.approx(1 + 1e-6)
    assert fm.psd_repair(np.eye(2))[0, 0] == 1.0


def test_bad_region_gives_no_rows(spark):
    u = _panel(6, 30, 3)
    rows = [(1, i, 1.0, 100, u[i].tolist()) for i in range(3)] + [(2, i, float("nan") if i == 4 else 1.0, 100, u[i].tolist()) for i in range(3, 6)]
    df = spark.createDataFrame(rows + [(3, 9, 1.0, 100, u[0].tolist())], "region_id int, id bigint, z double, n bigint, u array<double>")
    out = fm.susie_finemap(df, 2, key_type="int", id_type="bigint").select("region_id").distinct().collect()
    assert [r.region_id for r in out] == [1]


def test_fallback_takes_high_pip_or_best_ten(spark):
    rows = [("a", i, 0.2 if i < 2 else 0.01) for i in range(20)] + [("b", i, 0.05 + i / 1000) for i in range(20)]
    df = spark.createDataFrame(rows, "region_id string, id int, pip double")
    got = fm.fallback_set(df).groupBy("region_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert {r.region_id: r.ids for r in got} == {"a": [0, 1], "b": list(range(10, 20))}


@pytest.mark.parametrize("tile_rows", [4, 256])
def test_ld_pairs_and_scores_match_brute_force(spark, tile_rows):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 12))
    pos = [int(p) for p in rng.integers(0, 60, 30)]
    rows = [(int(i % 2), i, pos[i], x[i].tolist(), [1.0, float(i % 3 == 0)]) for i in range(30)]
    df = spark.createDataFrame(rows, "region int, id bigint, pos bigint, x array<double>, annot array<double>")
    r = np.corrcoef(x)
    near = lambda i, j: i % 2 == j % 2 and abs(pos[i] - pos[j]) <= 20
    want = {(i, j): r[i, j] for i in range(30) for j in range(i + 1, 30) if near(i, j)}
    got = {(g.i, g.j): g.r for g in ld.ld_pairs(df, 20, tile_rows=tile_rows).collect()}
    assert got == pytest.approx(want)
    adj = r**2 - (1 - r**2) / 10
    scores = {(i, c): sum(adj[i, j] * (1.0 if c == 0 else float(j % 3 == 0)) for j in range(30) if near(i, j)) for i in range(30) for c in (0, 1)}
    out = {(g.id, g.category): g.score for g in ld.ld_scores(df, 20, 2, tile_rows=tile_rows).collect()}
    assert out == pytest.approx(scores)


def test_cojo_selects_planted_signals_only(spark):
    u = _panel(60, 400, 8)
    z = 14 * (u @ u[10]) + 12 * (u @ u[45])
    rows = [(1, i, float(z[i]), 0.3, u[i].tolist()) for i in range(60)] + [(2, 100 + i, 1.0, 0.3, u[i].tolist()) for i in range(5)]
    rows.append((3, 200, 30.0, 0.001, u[0].tolist()))  # below the frequency limit
    df = spark.createDataFrame(rows, "region_id int, id bigint, z double, frq double, u array<double>")
    got = sorted((r.region_id, r.id) for r in sg.select_signals(df).collect())
    assert got == [(1, 10), (1, 45)]


def test_conditional_z_of_a_copy_is_dropped():
    u = _panel(5, 50, 4)
    zc = sg.conditional_z(np.array([9.0, 9.0]), u[[0, 0]], np.array([9.0]), u[[0]])
    assert np.isnan(zc).all()


def test_em_closed_form_when_one_rule_fires(spark):
    rows = [(0, 1, 0, True)] * 30 + [(0, 1, 0, False)] * 70 + [(0, 0, 1, True)] * 5 + [(0, 0, 1, False)] * 15
    df = spark.createDataFrame(rows, "fold int, a int, b int, label boolean")
    w = le.learn_weights(le.firing_patterns(df, ["fold"], ["a", "b"]), "fold", ["a", "b"], eps=1e-9).head()
    assert (w.a, w.b) == pytest.approx((0.3, 0.25), abs=1e-4)


def test_auc_by_hand(spark):
    rows = [(0, 0.9, True), (0, 0.8, False), (0, 0.7, True), (0, 0.7, False)]
    df = spark.createDataFrame(rows, "fold int, score double, label boolean")
    a = ev.areas(ev.curve_points(df, ["fold"], "score", "label"), ["fold"]).head()
    assert a.auc_roc == pytest.approx(0.625)
    assert a.auc_pr == pytest.approx(0.5 * (0.5 + 0.5) / 2)


def test_precision_is_null_without_listed_replies(spark):
    df = spark.createDataFrame([("m", -1)], "model string, outcome int")
    r = ev.precision_recall(df, ["model"]).head()
    assert r.precision is None and r.recall == 0 and r.f1 is None


@pytest.mark.parametrize("baselines", [1, 4])
def test_jackknife_recovers_a_planted_coefficient(spark, baselines):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(4000):
        cell, base = rng.uniform(0, 10), rng.uniform(1, 20, baselines)
        chi2 = 1 + 1000 * (2e-3 * cell + 1e-4 * base.sum()) + rng.normal() * 0.5
        rows.append(("t", i, i // 200, float(chi2), [float(cell), *base.tolist(), 1.0], float(base.sum()), 1.0, 1000.0))
    df = spark.createDataFrame(rows, "cell_type string, id bigint, block int, chi2 double, x array<double>, l double, w double, n double")
    for rounds in (0, 2):
        r = h2.cell_type_coefficients(h2.weighted_sums(df, baselines, rounds)).head()
        assert r.coefficient == pytest.approx(2e-3, abs=4 * r.std_error) and r.p_value < 1e-6


def test_weights_follow_the_fit(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.uniform(0, 9, 300), rng.uniform(1, 9, 300), rng.uniform(1, 9, 300), np.ones(300)])
    y = x @ [0.5, 0.2, 0.1, 1.0] + rng.normal(size=300) * 0.3
    l, w = x[:, 1:3].sum(axis=1), 1 / x[:, 1]  # noqa: E741
    df = spark.createDataFrame([("t", i, i // 30, float(y[i]), x[i].tolist(), float(l[i]), float(w[i]), 1.0) for i in range(300)],
                               "cell_type string, id bigint, block int, chi2 double, x array<double>, l double, w double, n double")
    coef = np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w * y))
    want = 1 / (l * np.maximum(x @ coef, 1) ** 2)
    got = {r.id: r.w for r in h2.reweighted(df, h2.block_sums(df, 2)).collect()}
    assert np.allclose([got[i] for i in range(300)], want, rtol=1e-8)
