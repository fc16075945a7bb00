"""Sum of single effects over tiles of variants.

A tile holds variants of one region with their unit genotype rows, or with their rows of the region's correlation matrix, in
bounded bytes. A fit of one region with one number of effects is a small state (:class:`finemap.Effects`) that asks for
sums over all variants: first the evidence of every prior variance that its search may look at, then the posterior sums
under the one it chose. Where one tile holds the whole region the sums are complete there and the fit runs to its end in
that task. Where a region has several tiles every pass puts the open questions of all numbers of effects to all its
tiles, adds the partial sums up and moves each fit on by itself; updates, stop rule and evidence bound are the same.

Regions of several tiles go in waves, so that the questions of one wave have a bounded size and are broadcast to the
tiles, which stay where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusloom.functions.running import running, salted_join
from locusloom.functions.session import bounded_batches, cut_lineage, release, saved
from locusloom.operators import finemap as fm
from locusloom.operators import ld

WAVE_BYTES = 64 << 20
ENTRY_BYTES = 24  # one entry of a correlation matrix: two places and a value
STEPS = 60  # Lanczos steps at most
_MATRIX = ("entry_row", "entry_col", "matrix")
_STATE = (
    "region_id {key}, effects int, n double, rows long, width long, lift double, phase int, vk double, k int, round int, last double, "
    "elbo double, converged boolean, done boolean, fitted array<double>, others array<double>, v array<double>, lse array<double>, terms array<double>, asked array<double>, before array<double>"
)
_ANSWER = "region_id {key}, effects int, top array<double>, sums array<double>"


def _prior_points() -> np.ndarray:
    """Every log variance that the three nested grids of the search can reach."""
    seen: set[float] = set()

    def look(lo: float, hi: float, depth: int) -> None:
        grid = np.linspace(lo, hi, 13)
        seen.update(np.round(grid, 9))
        if depth < 3:
            for k in range(13):
                look(grid[max(k - 1, 0)], grid[min(k + 1, 12)], depth + 1)

    look(-14.0, 4.0, 1)
    return np.array(sorted(seen))


POINTS = _prior_points()


# ---- tiles ----------------------------------------------------------------------------


def _health(rows: DataFrame, bad) -> DataFrame:
    """Regions with two variants or more and no value that is missing or not finite."""
    health = rows.groupBy("region_id").agg(F.count("*").alias("rows"), F.max("n").cast("double").alias("n0"), F.bool_or(bad).alias("bad"), F.max("size").alias("width"))
    return health.filter((F.col("rows") >= 2) & ~F.col("bad")).drop("bad")


def genotype_tiles(members: DataFrame, tile_bytes: int) -> DataFrame:
    """(region_id, tile, tiles, n, rows, width, ids, z, at, matrix) from ``members(region_id, id, z, n, u)``; ``at`` is null."""
    bad = F.isnan("z") | F.col("z").isNull() | (F.abs("z") == float("inf")) | F.exists("u", lambda v: F.isnan(v) | v.isNull())
    rows = members.select("region_id", "id", "z", "n", F.col("u").cast("array<double>").alias("u"), F.size("u").cast("long").alias("size"))
    shape = _health(rows, bad).withColumn("tiles", F.ceil(F.col("rows") * (F.col("width") + 2) * 8 / tile_bytes).cast("long"))
    placed = salted_join(rows.drop("n"), shape, ["region_id"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    packed = placed.groupBy("region_id", "tile", "tiles", "n0", "rows", "width").agg(F.sort_array(F.collect_list(F.struct("id", "z", "u"))).alias("r"))
    field = lambda c: F.transform("r", lambda x: x[c])
    return cut_lineage(packed.select(
        "region_id", "tile", "tiles", F.col("n0").alias("n"), "rows", "width", field("id").alias("ids"), field("z").alias("z"),
        *[F.lit(None).cast("array<long>").alias(c) for c in ("at", "entry_row", "entry_col")], F.flatten(field("u")).alias("matrix")))


def matrix_tiles(stats: DataFrame, pairs: DataFrame, tile_bytes: int) -> DataFrame:
    """The same from ``stats(region_id, place, id, z, n)`` and ``pairs(region_id, i, j, r)``: a tile holds whole rows of the
    matrix, ``at`` their places, as the entries that are given: ``matrix`` at the places ``entry_row, entry_col``. So tiles grow
    with the pairs, not with the square of a region."""
    bad = F.isnan("z") | F.col("z").isNull() | (F.abs("z") == float("inf"))
    rows = stats.select("region_id", F.col("place").cast("long").alias("place"), "id", "z", "n").withColumn("size", F.col("place") + 1)
    flat = pairs.filter("i <> j and r is not null and not isnan(r)").select("region_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "r")
    both = flat.unionByName(flat.select("region_id", F.col("j").alias("i"), F.col("i").alias("j"), "r")).groupBy("region_id", "i", "j").agg(F.max("r").alias("r"))
    entries = both.join(rows.select("region_id", F.col("place").alias("i")), ["region_id", "i"], "left_semi").join(
        rows.select("region_id", F.col("place").alias("j")), ["region_id", "j"], "left_semi")
    entries = saved(entries.select("region_id", F.col("i").alias("place"), "j", "r"), "entries")  # read twice
    held = rows.join(entries.groupBy("region_id", "place").agg(F.count("*").alias("__k")), ["region_id", "place"], "left")
    weight = (F.coalesce("__k", F.lit(0)) + 2) * ENTRY_BYTES
    order = running(held, ["region_id"], F.floor(F.col("place") / 1024), [F.col("place")], weight, "__before", exclusive=True)
    placed = saved(order.withColumn("tile", F.floor(F.col("__before") / tile_bytes)).drop("__before", "__k"), "placed")
    shape = _health(rows, bad).join(placed.groupBy("region_id").agg((F.max("tile") + 1).alias("tiles")), "region_id")
    packed = salted_join(placed.drop("n"), shape, ["region_id"]).groupBy("region_id", "tile", "tiles", "n0", "rows", "width").agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "z"))).alias("r"))
    cells = entries.join(placed.select("region_id", "place", "tile"), ["region_id", "place"]).groupBy("region_id", "tile").agg(
        F.collect_list(F.struct("place", "j", "r")).alias("cells"))  # at most ``tile_bytes`` and one row of the matrix
    field = lambda r, c: F.transform(r, lambda x: x[c])
    return cut_lineage(packed.join(cells, ["region_id", "tile"], "left").select(
        "region_id", "tile", "tiles", F.col("n0").alias("n"), "rows", "width", field("r", "id").alias("ids"), field("r", "z").alias("z"),
        field("r", "place").alias("at"), field("cells", "place").alias("entry_row"), field("cells", "j").alias("entry_col"), field("cells", "r").alias("matrix")))


def entries_of(row, columns: np.ndarray | None = None) -> fm.Entries:
    """Rows of the correlation matrix that a tile holds, with the diagonal; columns are places, or indices of ``columns``."""
    at = np.asarray(row.at, np.int64)
    from_, to, r = (np.zeros(0), np.zeros(0), np.zeros(0)) if row.matrix is None else (row.entry_row, row.entry_col, row.matrix)
    line = np.concatenate([np.searchsorted(at, np.asarray(from_, np.int64)), np.arange(len(at))])
    to, width = np.concatenate([np.asarray(to, np.int64), at]), int(row.width)
    if columns is not None:
        to, width = np.searchsorted(columns, to), len(columns)
    return fm.Entries(line, to, np.concatenate([np.asarray(r, float), np.ones(len(at))]), (len(at), width))


def block_of(row, lift: float = 0.0) -> fm.Block:
    z = np.asarray(row.z, float)
    if row.at is not None:
        return fm.Block(z, entries_of(row), float(row.n), np.asarray(row.at, np.int64), lift)
    return fm.Block(z, np.asarray(row.matrix, float).reshape(len(z), -1), float(row.n))


def _whole_block(row) -> fm.Block:
    """Block of a tile that holds its whole region; places without statistics are gaps and take no part."""
    if row.at is None:
        return block_of(row)
    z, n = np.asarray(row.z, float), float(row.n)
    every = np.arange(len(z))
    entries = entries_of(row, np.asarray(row.at, np.int64))
    if 8 * len(z) * (len(z) + 2) <= fm.TILE_BYTES:
        return fm.Block(z, fm.psd_repair(entries.dense()), n, every)
    return fm.Block(z, entries, n, every, fm.psd_lift(_smallest(entries)))


# ---- fits -----------------------------------------------------------------------------


def fit_tiles(tiles: DataFrame, square: bool, grid: Sequence[int], coverage: float, min_abs_corr: float, key_type: str, id_type: str) -> DataFrame:
    """(region_id, id, pip, cs, effects, elbo, converged); the number of effects is chosen from ``grid`` by the evidence bound."""
    bounded_batches(tiles.sparkSession)  # a task gets its tiles one by one
    schema = f"region_id {key_type}, id {id_type}, pip double, cs int, effects int, elbo double, converged boolean"

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                n, block = float(row.n), _whole_block(row)
                fits = [(k, f.elbo, f.converged, f) for k in _counts(grid, len(row.z)) for f in [fm.fit_block(block, n, k)]]
                count, elbo, converged, fit = fm.best_count(fits)
                cs = np.zeros(len(row.z), dtype=int)
                for i, found in enumerate(fm.credible_sets(fit, block.rows, coverage, min_abs_corr, square)):
                    cs[found] = i + 1
                yield pd.DataFrame({"region_id": row.region_id, "id": row.ids, "pip": fit.pip, "cs": cs, "effects": count, "elbo": elbo, "converged": converged})
                del block, fits, fit
        release()

    fitted = tiles.filter("tiles = 1").mapInPandas(whole, schema)
    several = tiles.filter("tiles > 1").select("region_id", "n", "rows", "width").distinct()
    several = cut_lineage(several.withColumn("bytes", F.col("width") * 16 * len(grid)))
    if several.isEmpty():
        return fitted
    before = F.sum("bytes").over(Window.orderBy(F.desc("bytes"), "region_id"))  # one row per region of several tiles
    waves = cut_lineage(several.withColumn("wave", F.floor(before / WAVE_BYTES)))
    for (wave,) in sorted(waves.select("wave").distinct().collect()):
        part = waves.filter(F.col("wave") == wave).drop("wave")
        fitted = fitted.unionByName(_fit_wave(tiles, part, square, grid, coverage, min_abs_corr, key_type, id_type))
    return fitted


def _counts(grid: Sequence[int], rows: int) -> list[int]:
    """Numbers of effects to try: those of the grid that the region has rows for, else the first."""
    return [k for k in grid if k <= rows] or [grid[0]]


def _fit_wave(tiles, regions, square, grid, coverage, min_abs_corr, key_type, id_type) -> DataFrame:
    size = regions.agg(F.sum("bytes")).head()[0]
    hint = F.broadcast if size <= 2 * WAVE_BYTES else (lambda df: df)  # a single region may be larger: then Spark joins as it sees fit
    mine = tiles.join(hint(regions.select("region_id")), "region_id", "left_semi")
    lifted = _lifts(mine, regions, hint, key_type) if square else regions.withColumn("lift", F.lit(0.0))

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                for count in _counts(grid, row.rows):
                    yield _dump(row.region_id, fm.Effects(min(count, int(row.rows)), int(row.width), float(row.n), int(row.rows)), row.lift, 0, 0.0)

    state_kind = _STATE.format(key=key_type)
    state = cut_lineage(lifted.select("region_id", "n", "rows", "width", "lift").mapInPandas(begin, state_kind))

    def answer(phase: int, vk: float, asked: np.ndarray, before: np.ndarray, block: fm.Block) -> tuple[np.ndarray, np.ndarray]:
        if phase == 0:
            return fm.evidence_parts(block.bhat(asked) ** 2, block.s2, np.exp(POINTS))
        top, sums, vector = block.posterior(asked, before, vk)
        return np.array([top]), np.concatenate([sums, vector])

    def move(key, before: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        row = next(before.itertuples(index=False))
        if row.done:
            return before
        state, (top, sums) = _load(row), _added(parts)
        if row.phase == 0:
            known = top + np.log(sums)
            v = fm.search_prior(lambda x: known[np.searchsorted(POINTS, np.round(x, 9))], state.rows)
            return _dump(row.region_id, state, row.lift, 1, v)
        state.take(row.vk, float(top[0] + np.log(sums[0])), sums[1:5] / sums[0], sums[5:] / sums[0])
        return _dump(row.region_id, state, row.lift, 0, 0.0)

    # two passes an update; every fit ends by its own stop rule. Each state is written: a checkpoint keeps what the plan knew, which doubles
    while not state.filter("not done").isEmpty():
        asked = state.filter("not done").select("region_id", "effects", "phase", "vk", "lift", "asked", "before")
        parts = _answers(mine, asked, hint, answer, key_type)
        state = saved(state.groupBy("region_id", "effects").cogroup(parts.groupBy("region_id", "effects")).applyInPandas(move, state_kind), "state")
    usable = F.col("converged") & ~F.isnan("elbo") & (F.abs("elbo") < float("inf"))
    order = Window.partitionBy("region_id").orderBy(F.desc(usable), F.desc("elbo"), "effects")  # one row per number of effects
    chosen = cut_lineage(state.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place"))
    return _sets(mine, chosen, hint, square, coverage, min_abs_corr, key_type, id_type)


def _dump(region, state: fm.Effects, lift: float, phase: int, vk: float) -> pd.DataFrame:
    asked, before = state.against()
    return pd.DataFrame({
        "region_id": [region], "effects": len(state.v), "n": state.n, "rows": state.rows, "width": state.fitted.shape[1], "lift": lift, "phase": phase, "vk": vk,
        "k": state.k, "round": state.round, "last": state.last, "elbo": state.elbo, "converged": state.converged, "done": state.done,
        "fitted": [state.fitted.ravel()], "others": [state.others.ravel()], "v": [state.v], "lse": [state.lse], "terms": [state.terms.ravel()], "asked": [asked], "before": [before]})


def _load(row) -> fm.Effects:
    state = fm.Effects(int(row.effects), int(row.width), float(row.n), int(row.rows))
    array = lambda x, *shape: np.array(x, float).reshape(shape)
    state.fitted, state.others = array(row.fitted, row.effects, row.width), array(row.others, row.effects, row.width)
    state.v, state.lse, state.terms = array(row.v, row.effects), array(row.lse, row.effects), array(row.terms, row.effects, 4)
    state.k, state.round, state.last, state.elbo = int(row.k), int(row.round), float(row.last), float(row.elbo)
    state.converged, state.done = bool(row.converged), bool(row.done)
    return state


def _added(parts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Partial sums that are relative to their own maxima, added up."""
    held = None
    for t, s in zip(parts["top"], parts["sums"], strict=True):
        held = _shifted(held, np.asarray(t, float), np.asarray(s, float))
    return held


def _shifted(held, top: np.ndarray, sums: np.ndarray):
    if held is None:
        return top, sums
    new = np.maximum(held[0], top)
    return new, held[1] * np.exp(held[0] - new) + sums * np.exp(top - new)


def _answers(tiles: DataFrame, asked: DataFrame, hint, answer, key_type: str) -> DataFrame:
    """Partial sums per (task, region, number of effects); a tile meets all questions of its region at once."""
    listed = asked.groupBy("region_id").agg(F.max("lift").alias("lift"), F.collect_list(F.struct("effects", "phase", "vk", "asked", "before")).alias("q"))
    field = lambda c: F.transform("q", lambda x: x[c])
    questions = listed.select("region_id", "lift", *[field(c).alias(c) for c in ("effects", "phase", "vk")], *[F.flatten(field(c)).alias(c) for c in ("asked", "before")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                block, many = block_of(row, row.lift), len(row.effects)
                asked, before = (np.asarray(x, float).reshape(many, -1) for x in (row.asked, row.before))
                for i in range(many):
                    key = (row.region_id, int(row.effects[i]))
                    held[key] = _shifted(held.get(key), *answer(int(row.phase[i]), float(row.vk[i]), asked[i], before[i], block))
        if held:
            yield pd.DataFrame([(r, e, t, s) for (r, e), (t, s) in held.items()], columns=["region_id", "effects", "top", "sums"])

    data = tiles.select("region_id", "n", "z", "at", "width", *_MATRIX)
    return data.join(hint(questions), "region_id").mapInPandas(run, _ANSWER.format(key=key_type))


def _lanczos(basis: np.ndarray, alpha: list, beta: list, product: np.ndarray, steps: int) -> tuple[np.ndarray, list, list, float, bool]:
    """One step with the product of the newest vector: vectors, diagonals, smallest eigenvalue so far, whether it is settled."""
    alpha = [*alpha, float(basis[-1] @ product)]
    rest = product - basis.T @ (basis @ product)
    rest -= basis.T @ (basis @ rest)  # twice, so that the vectors stay orthogonal
    size = float(np.linalg.norm(rest))
    least = float(np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))[0])
    settled = len(alpha) >= min(steps, len(product)) or size < 1e-10 or least < -fm.ROUNDING
    if not settled:
        basis, beta = np.vstack([basis, rest / size]), [*beta, size]
    return basis, alpha, beta, least, settled


def _start(width: int) -> np.ndarray:
    q = np.random.default_rng(7).normal(size=width)
    return q / np.linalg.norm(q)


def _smallest(entries: fm.Entries, steps: int = STEPS) -> float:
    """The smallest eigenvalue of a whole matrix by the same steps."""
    basis, alpha, beta, settled = _start(entries.shape[1])[None, :], [], [], False
    while not settled:
        basis, alpha, beta, least, settled = _lanczos(basis, alpha, beta, entries @ basis[-1], steps)
    return least


def _lifts(tiles: DataFrame, regions: DataFrame, hint, key_type: str, steps: int = STEPS) -> DataFrame:
    """``regions`` with ``lift``: what the diagonal gets, from the smallest eigenvalue by Lanczos steps. Each step is one
    product of all tiles with one vector per region; the vectors so far are kept, as their number is at most ``steps``."""
    kind = f"region_id {key_type}, effects int, basis array<double>, alpha array<double>, beta array<double>, smallest double, done boolean"

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame({"region_id": [row.region_id], "effects": 0, "basis": [_start(int(row.width))], "alpha": [[]], "beta": [[]], "smallest": 0.0, "done": False})

    def answer(phase: int, vk: float, asked: np.ndarray, before: np.ndarray, block: fm.Block) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(1), block.vector(block.times(asked))

    def move(key, held: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        row = next(held.itertuples(index=False))
        if row.done:
            return held
        product = np.sum([np.asarray(s, float) for s in parts["sums"]], axis=0)
        basis = np.asarray(row.basis, float).reshape(-1, len(product))
        basis, alpha, beta, least, settled = _lanczos(basis, list(row.alpha), list(row.beta), product, steps)
        return pd.DataFrame({"region_id": [row.region_id], "effects": 0, "basis": [basis.ravel()], "alpha": [alpha], "beta": [beta], "smallest": least, "done": settled})

    newest = F.slice("basis", -(F.size("basis") / (F.size("alpha") + 1)).cast("int"), (F.size("basis") / (F.size("alpha") + 1)).cast("int"))
    state = cut_lineage(regions.mapInPandas(begin, kind))
    while not state.filter("not done").isEmpty():
        none = F.lit(0.0)
        asked = state.filter("not done").select(
            "region_id", "effects", F.lit(0).alias("phase"), none.alias("vk"), none.alias("lift"), newest.alias("asked"), newest.alias("before"))
        parts = _answers(tiles, asked, hint, answer, key_type)
        state = saved(state.groupBy("region_id", "effects").cogroup(parts.groupBy("region_id", "effects")).applyInPandas(move, kind), "state")
    lift = F.when(F.col("smallest") < -fm.ROUNDING, 1e-6).otherwise(0.0)
    return regions.join(state.select("region_id", lift.alias("lift")), "region_id")


# ---- results --------------------------------------------------------------------------


def _sets(tiles, state, hint, square, coverage, min_abs_corr, key_type, id_type) -> DataFrame:
    """PIPs and credible sets of the chosen fits; a variant's probabilities come again from the state."""

    def probabilities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                block = block_of(row, row.lift)
                others = np.asarray(row.others, float).reshape(len(row.v), -1)
                alphas = np.array([block.alpha(w, v, lse) for w, v, lse in zip(others, row.v, row.lse, strict=True)]).T
                live = alphas[:, np.asarray(row.v) > 1e-9]
                place = row.at if row.at is not None else np.zeros(len(row.ids), np.int64)
                yield pd.DataFrame({"region_id": row.region_id, "id": row.ids, "place": place, "pip": np.clip(1 - np.prod(1 - live, axis=1), 0, 1), "alpha": alphas.tolist()})

    fits = state.select("region_id", "others", "v", "lse", "lift")
    per_variant = cut_lineage(tiles.select("region_id", "ids", "n", "z", "at", "width", *_MATRIX).join(hint(fits), "region_id").mapInPandas(
        probabilities, f"region_id {key_type}, id {id_type}, place long, pip double, alpha array<double>"))
    live = state.select("region_id", F.posexplode("v").alias("effect", "vk")).filter(F.col("vk") > 1e-9).select("region_id", "effect")
    spread = salted_join(per_variant.select("region_id", "id", "place", F.posexplode("alpha").alias("effect", "a")), live, ["region_id", "effect"])
    before = running(spread, ["region_id", "effect"], fm.pip_bucket(F.col("a")), [F.col("a").desc(), F.col("id")], F.col("a"), "before", exclusive=True)
    members = cut_lineage(before.filter(F.col("before") < coverage * (1 - 1e-12)).select("region_id", "effect", "id", "place"))
    lowest = _purity_of_matrix if square else _purity_of_genotypes
    purity = lowest(tiles, members, key_type).groupBy("region_id", "effect").agg(F.round(F.min("low"), 9).alias("purity"))
    mark = members.groupBy("region_id", "effect").agg(F.count("*").alias("k"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"))
    # sets of one region: at most one per effect
    pure = purity.filter(F.col("purity") >= min_abs_corr).join(mark, ["region_id", "effect"])
    single = pure.groupBy("region_id", "k", "h", "purity").agg(F.min("effect").alias("effect"))
    order = Window.partitionBy("region_id").orderBy(F.col("purity").desc(), "effect")
    named = single.withColumn("cs", F.row_number().over(order)).select("region_id", "effect", "cs")
    of_variant = members.join(named, ["region_id", "effect"]).groupBy("region_id", "id").agg(F.max("cs").alias("cs"))
    facts = state.select("region_id", "effects", "elbo", "converged")
    return salted_join(per_variant, facts, ["region_id"]).join(of_variant, ["region_id", "id"], "left").select(
        "region_id", "id", "pip", F.coalesce("cs", F.lit(0)).alias("cs"), "effects", "elbo", "converged")


def _purity_of_genotypes(tiles: DataFrame, members: DataFrame, key_type: str) -> DataFrame:
    """Smallest |r| per pair of member tiles; every pair counts: one position for all, so none lies outside the window."""
    width = F.col("width").cast("int")
    rows = tiles.select("region_id", width.alias("width"), "matrix", F.posexplode("ids").alias("k", "id")).select(
        "region_id", "id", F.slice("matrix", F.col("k") * F.col("width") + 1, F.col("width")).alias("u"))
    packed = members.join(rows, ["region_id", "id"]).select(F.struct("region_id", "effect").alias("region"), "id", F.lit(0).cast("long").alias("pos"), "u")
    pairs = ld.tile_pairs(ld.tiles(packed, [], 1), 0, [])

    def lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            low = [float(np.abs(np.asarray(a, float).reshape(len(i), -1) @ np.asarray(b, float).reshape(len(j), -1).T).min())
                   for a, i, b, j in zip(pdf["a_u"], pdf["a_ids"], pdf["b_u"], pdf["b_ids"])]
            yield pd.DataFrame({"region_id": pdf["region_id"], "effect": pdf["effect"], "low": low})

    flat = pairs.select("region.region_id", "region.effect", "a_ids", "a_u", "b_ids", "b_u")
    return flat.mapInPandas(lowest, f"region_id {key_type}, effect int, low double")


def _purity_of_matrix(tiles: DataFrame, members: DataFrame, key_type: str) -> DataFrame:
    """Smallest |r| per tile among the members' rows and columns; a set has at most as many places as the matrix has rows."""
    places = members.groupBy("region_id", "effect").agg(F.collect_list("place").alias("places"))

    def lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                inside, places = np.isin(np.asarray(row.at), np.asarray(row.places)), np.zeros(int(row.width), bool)
                places[np.asarray(row.places, np.int64)] = True
                if inside.any():
                    low = entries_of(row).lowest(inside, places)
                    yield pd.DataFrame({"region_id": [row.region_id], "effect": row.effect, "low": low})

    return tiles.select("region_id", "at", "width", *_MATRIX).join(places, "region_id").mapInPandas(lowest, f"region_id {key_type}, effect int, low double")
