"""Cell-type heritability: weighted regression of chi-square on LD scores beside any number of baseline annotations, block jackknife."""

from __future__ import annotations

from math import erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.functions.running import numbered
from locusloom.functions.session import cut_lineage

MERGED_NAME = "all_merged_cCREs"


def snp_blocks(snps: DataFrame, blocks: int, width: int = 1_000_000) -> DataFrame:
    """Contiguous jackknife blocks of nearly equal size in (chr, pos) order."""
    total = snps.agg(F.count("*").alias("m")).scalar()
    bucket = F.struct("chr", F.floor(F.col("pos") / width).alias("b"))
    ranked = numbered(snps, [], bucket, [F.col("chr"), F.col("pos"), F.col("id")], "__k").withColumn("__m", total)
    return ranked.withColumn("block", F.floor((F.col("__k") - 1) * blocks / F.col("__m")).cast("int")).drop("__k", "__m")


def regression_rows(sumstats: DataFrame, base: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per (cell type, variant): chi-square, regressors ``x`` and weight.

    ``sumstats(id, z, n, block)``, ``base(id, scores array<double>)`` with one LD score per baseline annotation,
    ``cells(id, cell_type, score)``. ``x`` is the cell type's score, the baseline scores and 1. With l the sum of the
    baseline scores, the weight is 1 / (max(l,1) (1 + max(l,1) n h / M)^2) with h from the mean chi-square.
    """
    total = F.aggregate("scores", F.lit(0.0), lambda s, v: s + v)
    joined = sumstats.join(base.select("id", "scores", total.alias("__l")), "id").withColumn("chi2", F.col("z") * F.col("z"))
    ratio = joined.agg(F.greatest((F.avg("chi2") - 1) / F.avg("__l"), F.lit(0.0)).alias("r")).scalar()  # n h / M
    l = F.greatest("__l", F.lit(1.0))  # noqa: E741
    weighted = joined.withColumn("__r", ratio).withColumn("w", 1 / (l * F.pow(1 + F.col("__r") * l, 2)))
    x = F.concat(F.array("__cell"), "scores", F.array(F.lit(1.0)))
    return weighted.join(cells.select("id", "cell_type", F.col("score").alias("__cell")), "id").select(
        "cell_type", "id", "block", "chi2", x.alias("x"), l.alias("l"), "w", (F.col("n") / 1.0).alias("n"))


def block_sums(rows: DataFrame, baselines: int = 1) -> DataFrame:
    """(cell_type, block, xx, xy, n_sum, rows): normal equations of every block, in one partially aggregated groupBy.

    ``xx`` is the upper triangle of the weighted products of ``x`` row by row, ``xy`` the products with chi-square;
    ``x`` holds ``baselines`` + 2 numbers.
    """
    k = baselines + 2
    x = [F.col("x")[i] for i in range(k)]
    xx = [F.sum(F.col("w") * x[i] * x[j]) for i in range(k) for j in range(i, k)]
    xy = [F.sum(F.col("w") * x[i] * F.col("chi2")) for i in range(k)]
    return rows.groupBy("cell_type", "block").agg(
        F.array(*xx).alias("xx"), F.array(*xy).alias("xy"), F.sum("n").alias("n_sum"), F.count("*").alias("rows"))


def _solve(upper: np.ndarray, xy: np.ndarray) -> np.ndarray:
    k = len(xy)
    xx = np.zeros((k, k))
    xx[np.triu_indices(k)] = upper
    return np.linalg.lstsq(xx + np.triu(xx, 1).T, xy, rcond=None)[0]


def reweighted(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """``rows`` weighted by each cell type's own fit: 1 / (l max(predicted chi-square, 1)^2)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        coef = _solve(np.stack(pdf["xx"]).sum(axis=0), np.stack(pdf["xy"]).sum(axis=0))
        return pd.DataFrame({"cell_type": pdf["cell_type"].iloc[:1], "__coef": [coef.tolist()]})

    fits = sums.groupBy("cell_type").applyInPandas(fit, "cell_type string, __coef array<double>")
    predicted = F.aggregate(F.zip_with("x", "__coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.join(fits, "cell_type").withColumn("w", 1 / (F.col("l") * F.pow(F.greatest(predicted, F.lit(1.0)), 2))).drop("__coef")


def weighted_sums(rows: DataFrame, baselines: int = 1, rounds: int = 0) -> DataFrame:
    """Block sums after ``rounds`` rounds of fitting and weighting anew; rows are kept in the shared folder between rounds."""
    if rounds:
        rows = cut_lineage(rows)
    for _ in range(rounds):
        rows = reweighted(rows, block_sums(rows, baselines))
    return block_sums(rows, baselines)


def cell_type_coefficients(sums: DataFrame) -> DataFrame:
    """(name, coefficient, std_error, p_value): delete-one-block jackknife per cell type.

    A group is the block sums of one cell type, as many rows as there are blocks.
    """
    def jackknife(pdf: pd.DataFrame) -> pd.DataFrame:
        xx, xy = np.stack(pdf["xx"]), np.stack(pdf["xy"])
        n_mean, b = pdf["n_sum"].sum() / pdf["rows"].sum(), len(pdf)
        all_xx, all_xy = xx.sum(axis=0), xy.sum(axis=0)
        whole = _solve(all_xx, all_xy)[0] / n_mean
        left = np.array([_solve(all_xx - xx[i], all_xy - xy[i])[0] / n_mean for i in range(b)])
        pseudo = b * whole - (b - 1) * left
        se = float(pseudo.std(ddof=1) / sqrt(b)) if b > 1 else float("nan")
        est = float(pseudo.mean())
        p = 0.5 * erfc(est / se / sqrt(2)) if se and se > 0 else None
        return pd.DataFrame([[pdf["cell_type"].iloc[0], est, se, p]], columns=["name", "coefficient", "std_error", "p_value"])

    return sums.groupBy("cell_type").applyInPandas(jackknife, "name string, coefficient double, std_error double, p_value double")


def completeness(finished: DataFrame, chromosomes: int = 22) -> DataFrame:
    """(cell_type, is_complete, missing): which chromosomes a cell type still lacks."""
    have = finished.filter(F.col("cell_type") != MERGED_NAME).groupBy("cell_type").agg(F.collect_set("chr").alias("__have"))
    missing = F.array_sort(F.array_except(F.sequence(F.lit(1), F.lit(chromosomes)), "__have"))
    return have.select("cell_type", (F.size(missing) == 0).alias("is_complete"), missing.alias("missing"))
