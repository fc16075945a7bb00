"""Independent signals per locus by stepwise conditional selection.

Each step is one pass over all loci: tiles of variants meet the few signals already selected in
their locus, get conditional z-scores, and every locus keeps its best one. A locus of any
size is spread over tiles; the number of passes is the largest number of signals in a locus.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusloom.functions.running import salted_join, top_k
from locusloom.functions.session import cut_lineage

COLLINEAR_R2 = 0.9
CONTEXT_BYTES = 32 << 20  # signals of all loci that are broadcast to the tiles; beyond, the tiles are shuffled to them


def p_to_z(p: float) -> float:
    return -NormalDist().inv_cdf(p / 2)


def conditional_z(z: np.ndarray, u: np.ndarray, zs: np.ndarray, us: np.ndarray, r2_limit: float = COLLINEAR_R2) -> np.ndarray:
    """z of each variant given the selected ones; nan where it is nearly their combination."""
    r = u @ us.T
    w = np.linalg.solve(us @ us.T, np.column_stack([zs, r.T]))
    left = 1 - np.einsum("ij,ji->i", r, w[:, 1:])
    out = np.full(len(z), np.nan)
    free = left > 1 - r2_limit
    out[free] = (z[free] - r[free] @ w[:, 0]) / np.sqrt(left[free])
    return out


def joint_z(zs: np.ndarray, us: np.ndarray) -> np.ndarray:
    inv = np.linalg.inv(us @ us.T)
    return inv @ zs / np.sqrt(np.diag(inv))


def _tiles(variants: DataFrame, tile_bytes: int) -> DataFrame:
    """(region_id, ids, z, u): the variants of a locus packed into tiles of bounded bytes, genotypes one after another."""
    shape = variants.groupBy("region_id").agg(F.ceil(F.count("*") * (F.max(F.size("u")) + 2) * 8 / tile_bytes).cast("long").alias("tiles"))
    placed = salted_join(variants, shape, ["region_id"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    packed = placed.groupBy("region_id", "tile").agg(F.collect_list(F.struct("id", "z", "u")).alias("r"))
    field = lambda c: F.transform("r", lambda x: x[c])
    return cut_lineage(packed.select("region_id", field("id").alias("ids"), field("z").alias("z"), F.flatten(field("u")).alias("u")))


def select_signals(
    variants: DataFrame, p_limit: float = 5e-8, maf: float = 0.01, id_type: str = "bigint", key_type: str = "int", tile_bytes: int = 32 << 20,
) -> DataFrame:
    """(region_id, id, z, joint_z, joint_p, step) of the independent signals of every locus.

    ``variants(region_id, id, z, frq, u)`` with unit genotype rows ``u``. A variant whose joint
    p falls below the limit is dropped again and not taken a second time.
    """
    z_limit = p_to_z(p_limit)
    tiles = _tiles(variants.filter(F.col("frq").between(maf, 1 - maf)).select("region_id", "id", "z", "u"), tile_bytes)
    chosen_schema = f"region_id {key_type}, id {id_type}, z double, u array<double>, step int, joint_z double, kept boolean"
    spark = variants.sparkSession
    chosen = spark.createDataFrame([], chosen_schema)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The best variant of every tile, given the signals of its locus."""
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                z, ids = np.asarray(row.z, float), np.asarray(row.ids)
                u = np.asarray(row.u, float).reshape(len(z), -1)
                if row.zs is None or not len(row.zs):
                    zc = z
                else:
                    zs = np.asarray(row.zs, float)
                    zc = conditional_z(z, u, zs, np.asarray(row.us, float).reshape(len(zs), -1))
                open_ = np.flatnonzero((np.abs(zc) > z_limit) & ~np.isin(ids, row.taken if row.taken is not None else []))
                if len(open_):
                    best = min(open_, key=lambda i: (-abs(zc[i]), ids[i]))
                    yield pd.DataFrame({"region_id": [row.region_id], "id": ids[best], "z": z[best], "u": [u[best]], "zc": zc[best]})

    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        """Joint z of the kept signals of one locus; the weakest go until all pass."""
        pdf = pdf.sort_values("step").reset_index(drop=True)
        keep = pdf["kept"].to_numpy(bool)
        joint = np.full(len(pdf), np.nan)
        while keep.any():
            at = np.nonzero(keep)[0]
            joint[at] = joint_z(pdf["z"].to_numpy(float)[at], np.vstack(pdf["u"].to_numpy()[at]))
            weakest = at[np.abs(joint[at]).argmin()]
            if abs(joint[weakest]) > z_limit:
                break
            keep[weakest] = False
        return pdf.assign(joint_z=joint, kept=keep)

    step = 0
    while True:  # every pass takes a variant of each open locus for good, so it ends
        step += 1
        if step == 1:
            none = F.lit(None)
            met = tiles.select("*", none.cast("array<double>").alias("zs"), none.cast("array<double>").alias("us"), F.array().cast(f"array<{id_type}>").alias("taken"))
        else:  # only loci that gained a signal in the last pass can gain another; a tile meets its locus's signals once
            context = chosen.groupBy("region_id").agg(F.max("step").alias("last"), F.array_sort(F.collect_list(F.struct("step", "kept", "id", "z", "u"))).alias("s"))
            held = F.filter("s", lambda x: x["kept"])
            context = context.filter(F.col("last") == step - 1).select(
                "region_id", F.transform(held, lambda x: x["z"]).alias("zs"), F.flatten(F.transform(held, lambda x: x["u"])).alias("us"), F.transform("s", lambda x: x["id"]).alias("taken"))
            size = chosen.agg(F.sum(F.size("u") * 8)).head()[0]
            met = tiles.join(F.broadcast(context) if size <= CONTEXT_BYTES else context, "region_id")
        scored = met.mapInPandas(score, f"region_id {key_type}, id {id_type}, z double, u array<double>, zc double")
        best = top_k(scored, ["region_id"], [F.abs("zc").desc(), F.col("id")], 1)
        new = cut_lineage(best.select("region_id", "id", "z", "u", F.lit(step).alias("step"), F.col("zc").alias("joint_z"), F.lit(True).alias("kept")))
        if new.isEmpty():
            return _finish(chosen)
        # a group here is the signals of one locus, never its variants
        chosen = cut_lineage(chosen.unionByName(new).groupBy("region_id").applyInPandas(prune, chosen_schema))


def _two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: erfc(abs(v) / sqrt(2)))


def _finish(chosen: DataFrame) -> DataFrame:
    p = F.pandas_udf(_two_sided, T.DoubleType())
    return chosen.filter("kept").select("region_id", "id", "z", "joint_z", p("joint_z").alias("joint_p"), "step")
