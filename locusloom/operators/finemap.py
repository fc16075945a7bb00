"""Fine-mapping: Bayes-factor credible sets as SQL, sum-of-single-effects per region."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.functions.columns import log_p
from locusloom.functions.running import numbered, running, salted_join, top_k
from locusloom.functions.session import saved

PRIOR_SD = 0.2
COVERAGE, MIN_ABS_CORR = 0.95, 0.5
L_GRID = tuple(range(1, 21))
TILE_BYTES = 32 << 20  # genotypes or correlations that one task holds at a time


def region_batches(leads: DataFrame, size: int = 5) -> DataFrame:
    """batch_id for fixed-size groups of regions in (chr, center) order."""
    ranked = numbered(leads, [], F.col("chr"), [F.col("chr"), F.col("center"), F.col("snp")], "__k")
    return ranked.withColumn("batch_id", F.floor((F.col("__k") - 1) / size).cast("long")).drop("__k")


def pip_bucket(pip: Column) -> Column:
    """Ordered bucket, 0 = highest probability; logarithmic, as most values are tiny."""
    return F.floor(-F.log10(F.greatest(pip, F.lit(1e-300))) * 20).cast("long")


def abf_pips(stats: DataFrame, keys: Sequence[str], prior_sd: float = PRIOR_SD) -> DataFrame:
    """Posterior inclusion probability per region under one causal variant.

    ``stats`` has ``z, se``. One partial aggregate sums the Bayes factors per (region, band
    of 50 log units), which cannot overflow; the few bands of a region then fold into its
    total, and that comes back through a salted join. The statistics are read twice, so they are computed once and saved.
    """
    keys = list(keys)
    v, w = F.col("se") * F.col("se"), F.lit(prior_sd * prior_sd)
    lbf = 0.5 * F.log(v / (v + w)) + 0.5 * F.col("z") * F.col("z") * w / (v + w)
    scored = saved(stats.withColumn("lbf", lbf), "scored")
    band = F.floor(F.col("lbf") / 50)
    bands = scored.groupBy(*keys, band.alias("__b")).agg(F.sum(F.exp(F.col("lbf") - 50 * band)).alias("__s"))
    top = bands.withColumn("__top", F.max("__b").over(Window.partitionBy(*keys)))
    total = top.groupBy(*keys, "__top").agg(F.sum(F.col("__s") * F.exp(50 * (F.col("__b") - F.col("__top")))).alias("__t"))
    joined = salted_join(scored, total, keys)
    return joined.withColumn("pip", F.exp(F.col("lbf") - 50 * F.col("__top")) / F.col("__t")).drop("__top", "__t")


def credible_set(pips: DataFrame, keys: Sequence[str], order: Sequence[Column], coverage: float = COVERAGE) -> DataFrame:
    """Smallest leading set reaching ``coverage``: rows whose running sum before them is below it. They are
    read twice, so they are computed once and saved."""
    out = running(saved(pips, "pips"), keys, pip_bucket(F.col("pip")), order, F.col("pip"), "__before", exclusive=True)
    return out.filter(F.col("__before") < coverage).drop("__before")


def padded_pip(members: DataFrame, pips: DataFrame, key: Sequence[str]) -> DataFrame:
    """Attach PIPs by key, 0.01 where there is none, clipped to [0, 1]."""
    joined = members.join(pips.select(*key, "pip"), list(key), "left")
    return joined.withColumn("pip", F.least(F.greatest(F.coalesce("pip", F.lit(0.01)), F.lit(0.0)), F.lit(1.0)))


def set_stats(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return members.groupBy(*keys).agg(F.count("*").alias("size"), F.min("pip").alias("min_pip"), F.max("pip").alias("max_pip"))


def fallback_set(pips: DataFrame, key: str = "region_id") -> DataFrame:
    """Variants with PIP > 0.1, or the ten best where a region has none; one set per region."""
    high = pips.filter(F.col("pip") > 0.1)
    without = pips.join(high.select(key).distinct(), key, "left_anti")
    best = top_k(without, [key], [F.col("pip").desc(), F.col("id")], 10)
    return high.unionByName(best).withColumn("cs", F.lit(1))


def run_summary(credible: DataFrame, regions: DataFrame) -> DataFrame:
    """Totals of a run: variants, high-confidence variants, largest set number, regions with and without result."""
    done = credible.select("region_id").distinct().withColumn("__ok", F.lit(1))
    marked = saved(regions.select("region_id").distinct().join(done, "region_id", "left"), "regions")
    totals = credible.agg(
        F.count("*").alias("total_variants"), F.count_if(F.col("pip") > 0.5).alias("high_confidence"),
        F.max("cs").alias("max_credible_set"), F.avg(F.abs("z")).alias("mean_abs_z"), F.max("n").alias("max_n"))
    return totals.select(
        "*", marked.agg(F.count_if(F.col("__ok") == 1).alias("k")).scalar().alias("regions_ok"),
        marked.agg(F.count_if(F.col("__ok").isNull()).alias("k")).scalar().alias("regions_failed"))


# Field names of the plot pack.
LOCUSZOOM_FIELDS = (
    "beta", "chromosome", "log_pvalue", "position", "ref_allele", "alt_allele", "ref_allele_freq", "variant",
    "posterior_prob", "is_member", "rs_id",
)


def locuszoom_rows(credible: DataFrame) -> DataFrame:
    """The eleven plot fields per variant."""
    return credible.select(
        "region_id", F.col("beta").cast("double").alias("beta"), F.col("chr").alias("chromosome"),
        log_p(F.col("p")).alias("log_pvalue"), F.col("bp").alias("position"),
        F.col("a2").alias("ref_allele"), F.col("a1").alias("alt_allele"), F.col("frq").alias("ref_allele_freq"),
        F.concat_ws(":", F.col("chr").cast("string"), F.col("bp").cast("string"), "a2", "a1").alias("variant"),
        F.col("pip").alias("posterior_prob"), (F.col("cs") != 0).alias("is_member"), F.coalesce("rs_id", F.lit("")).alias("rs_id"))


def locuszoom_pack(credible: DataFrame, page_rows: int = 1000) -> DataFrame:
    """Columnar arrays per (region, page) in position order; ``last_page`` marks the end."""
    from locusloom.operators.tables import paged

    rows = locuszoom_rows(credible)
    width = F.floor(F.col("position") / 100_000)
    pages = paged(rows, ["region_id"], width, [F.col("position"), F.col("variant")], F.struct(*LOCUSZOOM_FIELDS), "rows", page_rows)
    last = pages.groupBy("region_id").agg(F.max("page").alias("last_page"))
    arrays = [F.col("rows")[f].alias(f) for f in LOCUSZOOM_FIELDS]  # field of an array of structs = array
    return pages.join(last, "region_id").select("region_id", "page", "last_page", F.struct(*arrays).alias("data"))


# ---- sum of single effects ------------------------------------------------------------


ROUNDING = 1e-10  # a smallest eigenvalue above -ROUNDING counts as 0


def psd_lift(smallest: float, shift: float = 1e-6) -> float:
    """What to add to the diagonal of a correlation matrix with this smallest eigenvalue."""
    return shift if smallest < -ROUNDING else 0.0


def psd_repair(r: np.ndarray, shift: float = 1e-6) -> np.ndarray:
    """Lift the diagonal of a correlation matrix that has a negative eigenvalue."""
    return r + psd_lift(np.linalg.eigvalsh(r)[0], shift) * np.eye(len(r))


def adjusted_z(z: np.ndarray, n: float) -> np.ndarray:
    return np.sqrt((n - 1) / (z**2 + n - 2)) * z


def log_bf(bhat: np.ndarray, s2: float, v) -> np.ndarray:
    """ln Bayes factor of every variant under prior variance ``v``; 0 without one."""
    return 0.5 * np.log(s2 / (v + s2)) + 0.5 * bhat**2 / s2 * v / (v + s2) if v > 0 else np.zeros(len(bhat))


def evidence_parts(bhat2: np.ndarray, s2: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(maximum, sum relative to it) of the Bayes factors for each prior variance in ``v``."""
    slope = (0.5 / s2) * v / (v + s2)
    top = slope * bhat2.max()
    total = sum(np.exp(np.outer(bhat2[i : i + 4096], slope) - top).sum(axis=0) for i in range(0, len(bhat2), 4096))
    return 0.5 * np.log(s2 / (v + s2)) + top, total


def search_prior(evidence, rows: int) -> float:
    """Prior variance with the highest evidence on three grids, each between the neighbours of the best before; 0 when no
    value beats 'no effect'. ``evidence(x)``: ln sum of Bayes factors for each log variance in ``x``."""
    lo, hi = -14.0, 4.0
    for _ in range(3):
        grid = np.linspace(lo, hi, 13)
        fit = evidence(grid)
        k = int(np.argmax(fit))
        lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, 12)]
    return float(np.exp(grid[k])) if fit[k] > np.log(rows) else 0.0


class Effects:
    """What a fit of one region with a given number of effects remembers: per effect the vector that the others need
    (``fitted``), the sum of the others that it was fitted against (``others``), prior variance, normaliser and the terms
    of the evidence bound. It asks for sums over all variants and moves on by them, so the variants may lie anywhere."""

    def __init__(self, effects: int, width: int, n: float, rows: int, max_iter: int = 100, tol: float = 1e-3):
        self.n, self.rows, self.max_iter, self.tol = n, rows, max_iter, tol
        self.fitted, self.others = np.zeros((effects, width)), np.zeros((effects, width))
        self.v, self.lse = np.zeros(effects), np.zeros(effects)
        self.terms = np.zeros((effects, 4))
        self.round, self.k, self.last, self.elbo, self.converged, self.done = 0, 0, -np.inf, -np.inf, False, False

    @property
    def s2(self) -> float:
        return 1.0 / (self.n - 1)

    def against(self) -> tuple[np.ndarray, np.ndarray]:
        """Sum of all other effects, and of those already fitted in this round."""
        return self.fitted.sum(0) - self.fitted[self.k], self.fitted[: self.k].sum(0)

    def take(self, v: float, lse: float, sums: np.ndarray, vector: np.ndarray) -> None:
        """The posterior sums of effect ``k``: with bhat, squared size, target and the fit of the effects before it."""
        with_bhat, squared, with_target, with_before = sums
        loglik = -0.5 / self.s2 * (-2 * with_bhat + squared)
        self.others[self.k] = self.against()[0]
        self.fitted[self.k], self.v[self.k], self.lse[self.k] = vector, v, lse
        self.terms[self.k] = loglik - (lse - np.log(self.rows)), squared, with_target, with_before
        self.k += 1
        if self.k == len(self.v):
            kl, squared, with_target, with_before = self.terms.sum(0)
            rss = (self.n - 1) * (1 - 2 * with_target + 2 * with_before + squared)
            self.elbo = float(-self.n / 2 * np.log(2 * np.pi) - 0.5 * rss - kl)
            self.k, self.round = 0, self.round + 1
            self.converged = bool(abs(self.elbo - self.last) < self.tol)
            self.done = self.converged or self.round >= self.max_iter
            self.last = self.elbo


class Entries:
    """Rows of a correlation matrix by the entries that are given; the others are 0."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.value, self.shape = row, col, value, shape

    def __matmul__(self, vector: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * vector[self.col], self.shape[0])

    def dense(self) -> np.ndarray:
        out = np.zeros(self.shape)
        out[self.row, self.col] = self.value
        return out

    def lowest(self, rows: np.ndarray, cols: np.ndarray) -> float:
        """Smallest absolute value where these rows and columns meet, by masks."""
        inside = rows[self.row] & cols[self.col]
        every = np.count_nonzero(inside) == np.count_nonzero(rows) * np.count_nonzero(cols)
        return float(np.abs(self.value[inside]).min()) if every else 0.0


class Block:
    """Variants of one region: z-scores and either their unit genotype rows or their rows of the correlation matrix
    (``at`` then tells their places in it, ``lift`` what its diagonal gets)."""

    def __init__(self, z: np.ndarray, rows: np.ndarray, n: float, at: np.ndarray | None = None, lift: float = 0.0):
        self.rows, self.at, self.lift, self.s2 = rows, at, lift, 1.0 / (n - 1)
        self.target = adjusted_z(z, n) / np.sqrt(n - 1)  # marginal effects of standardised variants

    def times(self, vector: np.ndarray) -> np.ndarray:
        """The variants' rows of the correlation matrix times an effect, given by its vector."""
        out = self.rows @ vector
        return out if self.at is None else out + self.lift * vector[self.at]

    def vector(self, b: np.ndarray) -> np.ndarray:
        """The vector of an effect with weights ``b`` on these variants."""
        if self.at is None:
            return self.rows.T @ b
        out = np.zeros(self.rows.shape[1])
        out[self.at] = b
        return out

    def bhat(self, others: np.ndarray) -> np.ndarray:
        return self.target - self.times(others)

    def posterior(self, others: np.ndarray, before: np.ndarray, v: float) -> tuple[float, np.ndarray, np.ndarray]:
        """(maximum ln Bayes factor, sums relative to it: 1 and the four of :meth:`Effects.take`, vector)."""
        bhat = self.bhat(others)
        lbf = log_bf(bhat, self.s2, v)
        top = float(lbf.max())
        e, shrink = np.exp(lbf - top), v / (v + self.s2)
        b = e * shrink * bhat
        sums = [e.sum(), b @ bhat, (e * ((shrink * bhat) ** 2 + shrink * self.s2)).sum(), b @ self.target, b @ self.times(before)]
        return top, np.array(sums), self.vector(b)

    def alpha(self, others: np.ndarray, v: float, lse: float) -> np.ndarray:
        return np.exp(log_bf(self.bhat(others), self.s2, v) - lse)


class Fit:
    """Result of one region: effect probabilities, PIPs, evidence bound."""

    def __init__(self, alpha, v, elbo, converged):
        self.alpha, self.v, self.elbo, self.converged = alpha, v, elbo, converged

    @property
    def pip(self) -> np.ndarray:
        live = self.alpha[self.v > 1e-9]
        return np.clip(1 - np.prod(1 - live, axis=0), 0, 1)


def fit_block(block: Block, n: float, effects: int, max_iter: int = 100, tol: float = 1e-3) -> Fit:
    """Iterative Bayesian stepwise selection over the variants of one block, which hold the whole region."""
    rows = len(block.target)
    state = Effects(min(effects, rows), block.rows.shape[1], n, rows, max_iter, tol)
    while not state.done:
        others, before = state.against()
        bhat2 = block.bhat(others) ** 2

        def evidence(x: np.ndarray) -> np.ndarray:
            top, total = evidence_parts(bhat2, state.s2, np.exp(x))
            return top + np.log(total)

        v = search_prior(evidence, rows)
        top, sums, vector = block.posterior(others, before, v)
        state.take(v, top + np.log(sums[0]), sums[1:] / sums[0], vector / sums[0])
    alpha = np.array([block.alpha(w, v, lse) for w, v, lse in zip(state.others, state.v, state.lse, strict=True)])
    return Fit(alpha, state.v, state.elbo, state.converged)


def single_effects(z: np.ndarray, u: np.ndarray, n: float, effects: int, max_iter: int = 100, tol: float = 1e-3) -> Fit:
    """The fit from z-scores and unit genotype rows ``u``. R = u u' is never formed: R b = u (u' b)."""
    return fit_block(Block(z, u, n), n, effects, max_iter, tol)


def single_effects_of_matrix(z: np.ndarray, r: np.ndarray, n: float, effects: int, max_iter: int = 100, tol: float = 1e-3) -> Fit:
    """The fit from z-scores and their correlation matrix, lifted where it is not positive semidefinite."""
    return fit_block(Block(z, psd_repair(r), n, np.arange(len(z))), n, effects, max_iter, tol)


def purity(u: np.ndarray, members: np.ndarray, block: int = 512) -> float:
    """Smallest absolute correlation among the members, exact, block by block."""
    low, rows = 1.0, u[members]
    for i in range(0, len(rows), block):
        low = min(low, float(np.abs(rows[i:i + block] @ rows.T).min()))
    return low


def _lowest(r: np.ndarray | Entries, members: np.ndarray) -> float:
    """Smallest absolute correlation among the members."""
    if isinstance(r, Entries):
        mask = np.isin(np.arange(r.shape[0]), members)
        return r.lowest(mask, mask)
    return float(np.abs(r[np.ix_(members, members)]).min())


def credible_sets(fit: Fit, u: np.ndarray, coverage: float, min_abs_corr: float, matrix: bool = False) -> list[np.ndarray]:
    """Distinct pure sets, purest first; ``u``: genotype rows, or the correlation matrix, whole or by its entries, where
    ``matrix`` is set."""
    found: dict[tuple, float] = {}
    for a, v in zip(fit.alpha, fit.v):
        if v <= 1e-9:
            continue
        order = np.lexsort((np.arange(len(a)), -a))
        members = np.sort(order[: int(np.searchsorted(np.cumsum(a[order]), coverage * (1 - 1e-12))) + 1])
        p = round(_lowest(u, members) if matrix else purity(u, members), 9)  # equal sets stay equal
        if p >= min_abs_corr:
            found[tuple(members)] = p
    return [np.array(k) for k, _ in sorted(found.items(), key=lambda kv: -kv[1])]


def best_count(fits: Sequence[tuple]) -> tuple:
    """The (count, elbo, converged, ...) with the best evidence bound among those that converged to a finite one, the
    smaller count among equals; where none did, among the rest."""
    good = [f for f in fits if f[2] and np.isfinite(f[1])]
    return max(good or fits, key=lambda f: (f[1], -f[0]))


def choose_effects(z, u, n, grid: Sequence[int] = L_GRID) -> tuple[int, Fit]:
    """Number of effects with the best converged evidence bound over the whole grid; a region where no fit converges
    gets the best that did not, so that it stays in the result and is marked."""
    fits = [(k, single_effects(z, u, n, k)) for k in grid if k <= len(z)]
    count, _, _, fit = best_count([(k, f.elbo, f.converged, f) for k, f in fits])
    return count, fit


def susie_finemap(
    members: DataFrame, effects: int = -1, coverage: float = COVERAGE, min_abs_corr: float = MIN_ABS_CORR,
    key_type: str = "string", id_type: str = "string", tile_bytes: int = TILE_BYTES, grid: Sequence[int] = L_GRID,
) -> DataFrame:
    """(region_id, id, pip, cs, effects, elbo, converged) for every variant of every region; a fit that did not
    converge keeps its rows with ``converged`` false. ``effects`` -1: the count of ``grid`` with the best evidence bound.

    ``members(region_id, id, z, n, u)`` with unit genotype rows ``u``. cs 0 = in no set.
    Regions with a NaN or infinite value, or with fewer than two variants, give no rows.
    One algorithm at every size: variants lie in tiles of at most ``tile_bytes``, and a fit needs only sums over tiles.
    """
    from locusloom.operators import finemap_large as tiled

    tiles = tiled.genotype_tiles(members, tile_bytes)
    return tiled.fit_tiles(tiles, False, [effects] if effects > 0 else list(grid), coverage, min_abs_corr, key_type, id_type)


def susie_finemap_matrix(
    stats: DataFrame, pairs: DataFrame, effects: int = -1, coverage: float = COVERAGE, min_abs_corr: float = MIN_ABS_CORR,
    key_type: str = "string", id_type: str = "string", tile_bytes: int = TILE_BYTES, grid: Sequence[int] = L_GRID,
) -> DataFrame:
    """The same from a given correlation matrix: ``stats(region_id, place, id, z, n)`` with places from 0, ``pairs(region_id,
    i, j, r)`` by place. A pair given in one order counts in both, one that is not given is 0, the diagonal is 1. A matrix
    with a negative eigenvalue gets its diagonal lifted."""
    from locusloom.operators import finemap_large as tiled

    tiles = tiled.matrix_tiles(stats, pairs, tile_bytes)
    return tiled.fit_tiles(tiles, True, [effects] if effects > 0 else list(grid), coverage, min_abs_corr, key_type, id_type)


def final_sets(fitted: DataFrame) -> DataFrame:
    """Members of credible sets; regions without a set fall back to their best variants."""
    inside = fitted.filter(F.col("cs") > 0)
    without = fitted.join(inside.select("region_id").distinct(), "region_id", "left_anti")
    return inside.unionByName(fallback_set(without).select(*fitted.columns))
