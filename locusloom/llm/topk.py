"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are range-partitioned by length into groups and, inside a task, into buckets of ``BUCKET`` vectors of falling
length. A query's k-th score so far, over its own length and the bucket's longest vector, is its local cosine threshold:
above 1 the bucket is skipped; from ``STEEP`` on its largest coordinates must lie in intervals that follow from
the threshold (coordinate pruning); below that only vectors long enough are looked at (length pruning). What is left
is verified by exact integer products. The longest group goes first and gives every query its threshold.

Queries go in slots of about ``SLOT`` rows, candidates in groups of about ``GROUP``; a task holds one of each.

Defined results: vectors that are null, hold null or non-finite components, or have a null id take no part; vectors of
another dimension are no candidates; a vector never finds a row of its own id; repeated rows are candidates each; a
repeated query answers for each of its rows; products beyond 64 bits are cut to the largest long; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusloom.llm.common import saved
from locusloom.llm.registry import query, table
from locusloom.llm.vectors import matrix, usable

BUCKET, SLOT, GROUP = 1024, 1024, 8192
STEEP, COORDINATES = 0.5, 3
_RESULT = "q long, query_id long, vec_id long, score long"


def packed(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, dim, length, vec): whole numbers floor(scale * x) as doubles, packed."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            with np.errstate(over="ignore"):
                flat = np.floor(scale * lists.values.to_numpy(zero_copy_only=False))
            flat = np.clip(flat, -1e300, 1e300)
            rows = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            top = [np.abs(r).max(initial=0) for r in rows]
            length = [m * np.sqrt(((r / m) ** 2).sum()) if m else 0.0 for r, m in zip(rows, top, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(length, pa.float64()), pa.array([r.astype("<f8").tobytes() for r in rows], pa.binary())],
                ["vec_id", "dim", "length", "vec"],
            )

    return rows.filter(usable(F.col("v")) & F.col("vec_id").isNotNull()).mapInArrow(pack, "vec_id long, dim long, length double, vec binary")


def products(queries: np.ndarray, rows: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of whole numbers; ``most`` bounds their size."""
    if most < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    whole = [np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (queries, rows)]
    return np.clip(whole[0] @ whole[1].T, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each query; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, [[] for _ in range(queries)]

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= edge
            scores, ids = scores[keep], ids[keep]
        order = np.lexsort((ids, -scores))[: self.k]
        self.rows[q] = sorted(self.rows[q] + [(-int(scores[i]), int(ids[i])) for i in order])[: self.k]

    def least(self, q: int) -> float:
        return -self.rows[q][-1][0] if len(self.rows[q]) == self.k else -np.inf


def search(queries: np.ndarray, ids: np.ndarray, floors: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[list[tuple]]:
    """The k best rows of each query that reach its floor, as (-score, id)."""
    length = np.sqrt((rows / max(np.abs(rows).max(initial=0), 1.0)) ** 2 @ np.ones(rows.shape[1])) * max(np.abs(rows).max(initial=0), 1.0)
    order = np.lexsort((row_ids, -length))
    rows, row_ids, length = rows[order], row_ids[order], length[order]
    reach = max(np.abs(queries).max(initial=0), 1.0)
    own = np.sqrt((queries / reach) ** 2 @ np.ones(queries.shape[1])) * reach
    best = Best(len(queries), k)
    for at in range(0, len(rows), BUCKET):
        part, part_ids, size = rows[at : at + BUCKET], row_ids[at : at + BUCKET], length[at : at + BUCKET]
        floor = np.maximum(floors, [best.least(q) for q in range(len(queries))]) - 0.5  # scores are whole numbers
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(floor > 0, floor / (own * size[0]), -1.0)
        local = np.where(np.isnan(local), -1.0, local)
        steep = (local >= STEEP) & (local <= 1 + 1e-9)
        if steep.any():
            unit = part / np.maximum(size, 1e-300)[:, None]
            sort = np.argsort(unit, axis=0, kind="stable")
            ranked = np.take_along_axis(unit, sort, axis=0)
            for q in np.flatnonzero(steep):
                direction, t = queries[q] / own[q], min(local[q], 1.0)
                axes = np.argsort(-np.abs(direction))[:COORDINATES]
                width = np.sqrt(max(0.0, 1 - t * t) * np.maximum(0.0, 1 - direction[axes] ** 2)) + 1e-9
                # a component beyond the threshold bounds its coordinate on one side only
                low = np.where(direction[axes] <= -t, -np.inf, direction[axes] * t - width)
                high = np.where(direction[axes] >= t, np.inf, direction[axes] * t + width)
                first = [np.searchsorted(ranked[:, f], a, "left") for f, a in zip(axes, low, strict=True)]
                last = [np.searchsorted(ranked[:, f], b, "right") for f, b in zip(axes, high, strict=True)]
                c = int(np.argmin(np.subtract(last, first)))
                found = sort[first[c] : last[c], axes[c]]
                inside = ((unit[found][:, axes] >= low) & (unit[found][:, axes] <= high)).all(axis=1)
                found = found[inside & (part_ids[found] != ids[q])]
                if len(found):
                    score = products(queries[q : q + 1], part[found], own[q] * size[0])[0]
                    good = score > floor[q]
                    best.offer(q, score[good], part_ids[found][good])
        flat = np.flatnonzero(local < STEEP)
        if len(flat):
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(floor[flat] > 0, floor[flat] / own[flat] * (1 - 1e-12), -1.0)
            upto = np.searchsorted(-size, -need, side="right")
            score = products(queries[flat], part[: upto.max(initial=0)], own[flat].max() * size[0])
            for i, q in enumerate(flat):
                good = (score[i, : upto[i]] > floor[q]) & (part_ids[: upto[i]] != ids[q])
                if good.any():
                    best.offer(q, score[i, : upto[i]][good], part_ids[: upto[i]][good])
    return best.rows


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of every row for which ``is_query`` (a Column of vec_id) holds."""
    rows = saved(packed(vectors, id_col, vector_col, scale), "packed")
    n = rows.count()
    groups, slots = -(-n // GROUP) or 1, -(-rows.filter(is_query).count() // SLOT) or 1
    candidates = saved(
        rows.repartitionByRange(groups, "dim", F.desc("length"), "vec_id").withColumn("group", F.spark_partition_id()), "groups"
    )
    queries = saved(rows.filter(is_query).select(
        F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), "dim", F.col("length").alias("own"), F.col("vec").alias("query")
    ).withColumn("slot", F.pmod(F.xxhash64("q"), F.lit(slots)).cast("int")), "queries")
    edges = saved(candidates.groupBy("dim", "group").agg(F.max("length").alias("most")), "edges")
    longest = edges.groupBy("dim").agg(F.max_by("group", F.struct("most", -F.col("group"))).alias("group"))

    def answer(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("q", "query_id", "vec_id", "score")})
        found = search(
            matrix(asked["query"], key[0]), asked["query_id"].to_numpy(), asked["floor"].fillna(-np.inf).to_numpy(float),
            matrix(held["vec"], key[0]), held["vec_id"].to_numpy(), k,
        )
        out = [(q, i, v, -s) for q, i, best in zip(asked["q"], asked["query_id"], found, strict=True) for s, v in best]
        return pd.DataFrame(out, columns=["q", "query_id", "vec_id", "score"])

    def meet(asked: DataFrame, held: DataFrame) -> DataFrame:
        spread = held.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        keys = ("dim", "group", "slot")
        return asked.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(answer, _RESULT)

    start = queries.join(longest, "dim").withColumn("floor", F.lit(None).cast("double"))
    first = saved(meet(start, candidates.join(longest, ["dim", "group"], "left_semi")), "first")
    floor = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    later = queries.join(floor, "q", "left").join(edges.join(longest, ["dim", "group"], "left_anti"), "dim").filter(
        F.col("floor").isNull() | (F.col("own") * F.col("most") >= F.col("floor") - 0.5)
    ).drop("most")
    rest = meet(later, candidates.join(longest, ["dim", "group"], "left_anti"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return first.union(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


_SQL = """
with v as (
    select vec_id, [floor(256 * x::double) for x in embedding] as v from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
p as (
    select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
    from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 5"""


@query("op4_topk", _SQL)
def _topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)
