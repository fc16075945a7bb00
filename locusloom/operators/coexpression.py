"""Correlation of seed genes with all genes over the cells that express the seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.functions.running import top_k
from locusloom.functions.stats import pearson_p


def expression_slice(matrix: DataFrame, obs: DataFrame, tissue: str | None = None, cell_type: str | None = None) -> DataFrame:
    """Sparse rows of the cells of one tissue / cell type; the filters reach the obs scan."""
    cells = obs
    if tissue is not None:
        cells = cells.filter(F.col("tissue") == tissue)
    if cell_type is not None:
        cells = cells.filter(F.col("cell_type") == cell_type)
    return matrix.join(cells.select("cell", "tissue"), "cell")


def first_cells(obs: DataFrame, n: int) -> DataFrame:
    """The reference's cell cap: first n cells per tissue by id. Off unless asked for."""
    return top_k(obs, ["tissue"], [F.col("cell")], n)


def expression_counts(expr: DataFrame) -> DataFrame:
    """Non-zero cells, all cells and percentage per (tissue, gene)."""
    cells = expr.groupBy("tissue").agg(F.count_distinct("cell").alias("cells"))
    hits = expr.groupBy("tissue", "gene").agg(F.count_if(F.col("value") != 0).alias("nonzero"))
    return hits.join(cells, "tissue").withColumn("percent", 100.0 * F.col("nonzero") / F.col("cells"))


def correlations(expr: DataFrame, seeds: DataFrame) -> DataFrame:
    """(tissue, seed, gene, n, r): Pearson r over the cells where the seed is non-zero.

    A gene absent from a cell counts as 0 there, so only sums over present cells are
    needed: one join on the cell and one partially aggregated groupBy. ``seeds(seed)`` is a
    short list of genes of interest.
    """
    x = F.col("value").cast("double")
    seed_cells = expr.join(seeds.select(F.col("seed").alias("gene")).distinct(), "gene", "left_semi").filter(x != 0)
    seed_cells = seed_cells.select("tissue", "cell", F.col("gene").alias("seed"), x.alias("x"))
    seed_sums = seed_cells.groupBy("tissue", "seed").agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    y = F.col("y")
    pair_sums = (
        seed_cells.join(expr.select("tissue", "cell", "gene", x.alias("y")), ["tissue", "cell"])
        .filter(F.col("gene") != F.col("seed"))
        .groupBy("tissue", "seed", "gene")
        .agg(F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.sum(F.col("x") * y).alias("sxy"))
    )
    n = F.col("n").cast("double")
    vx, vy = n * F.col("sxx") - F.col("sx") ** 2, n * F.col("syy") - F.col("sy") ** 2
    r = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)
    # relative floor: rounding noise of a constant column must not pass as variance
    varies = (vy > 1e-9 * n * F.col("syy")) & (vx > 1e-9 * n * F.col("sxx"))
    return (
        pair_sums.join(seed_sums, ["tissue", "seed"]).filter((F.col("n") >= 2) & varies)
        .select("tissue", "seed", "gene", "n", r.alias("r"))
    )


def significant_correlations(corr: DataFrame, alpha: float = 0.05) -> DataFrame:
    p = corr.withColumn("p", pearson_p("r", "n"))
    return p.filter(F.col("p").isNotNull() & ~F.isnan("p") & (F.col("p") < alpha))


def strongest(corr: DataFrame, k: int) -> DataFrame:
    """k highest and k lowest r per (tissue, seed); the two overlap below 2k genes."""
    top = top_k(corr, ["tissue", "seed"], [F.col("r").desc(), F.col("gene")], k, "rank").withColumn("side", F.lit("positive"))
    low = top_k(corr, ["tissue", "seed"], [F.col("r").asc(), F.col("gene").desc()], k, "rank").withColumn("side", F.lit("negative"))
    return top.unionByName(low)
