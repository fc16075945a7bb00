"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine >= c lie within squared distance 2 - 2c. After a fixed random rotation the coordinates are split
into ``BLOCKS`` blocks; of a linked pair, at least one block holds no more than its proportional share of that distance.
Each block is range-joined under its share: vectors are sorted along the block's first coordinate into tiles of
``TILE`` vectors, tiles whose intervals are within reach meet, and a task screens one pair of tiles by the block's
distances. Candidates are verified by the exact cosine; a pair that several blocks find counts in the first of them.

Equal vectors are one class with a count and meet others once. A task returns link counts and a spanning forest of what
it links, never the pairs; a union-find over the forests gives the components.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null id, link with
nothing (component: their own id); vectors of another dimension do not link; repeated rows link with each other; rows that
share an id link by their own vectors; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import bounded_batches, components, local_components, release, saved
from locusloom.llm.registry import query, table
from locusloom.llm.vectors import matrix, usable

BLOCKS, TILE, STRIP, VERIFY = 4, 8192, 512, 50_000


@cache
def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))[0]


def blocks_of(dim: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), min(BLOCKS, dim))


def units(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1, in doubles."""
    rows = rows.astype(np.float64)
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def shares(dim: int, cosine: float) -> np.ndarray:
    """Squared distance that each block may hold, with room for rounding."""
    return np.array([(2 - 2 * cosine) * len(b) / dim for b in blocks_of(dim)]) * (1 + 1e-9) + 1e-12


def linked(a: np.ndarray, b: np.ndarray, block: int, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of ``a`` and ``b`` (unit vectors) that link and are this block's to count."""
    dim = a.shape[1]
    parts, share = blocks_of(dim), shares(dim, cosine)
    turned_a, turned_b = a @ rotation(dim), b @ rotation(dim)
    mine = parts[block]
    left, right = turned_a[:, mine].astype(np.float32), turned_b[:, mine].astype(np.float32)
    half = (right * right).sum(axis=1)
    for at in range(0, len(a), STRIP):
        some = left[at : at + STRIP]
        far = half[None] - 2 * (some @ right.T) + (some * some).sum(axis=1)[:, None]
        i, j = np.nonzero(far <= share[block] + 1e-4)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), VERIFY):
            x, y = i[k : k + VERIFY], j[k : k + VERIFY]
            good = np.einsum("ij,ij->i", a[x], b[y]) >= cosine
            x, y = x[good], y[good]
            gap = (turned_a[x] - turned_b[y]) ** 2
            within = np.stack([gap[:, p].sum(axis=1) <= s for p, s in zip(parts, share, strict=True)])
            first = within.argmax(axis=0) == block
            if first.any():
                yield x[first], y[first]


def tiles(classes: DataFrame, kind: str) -> DataFrame:
    """(tile, dim, block, low, high, ids, counts, vecs) from (class, n, dim, vec); rows of a tile are neighbours along the block's
    first coordinate."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for dim, rows in frame.groupby("dim"):
                turned = units(matrix(rows["vec"], dim, kind)) @ rotation(dim)
                for number, part in enumerate(blocks_of(dim)):
                    yield pa.RecordBatch.from_pandas(rows.assign(block=number, place=turned[:, part[0]]), preserve_index=False)

    placed = classes.mapInArrow(spread, "class long, n long, dim long, vec binary, block long, place double")
    count = -(-BLOCKS * classes.count() // TILE) or 1
    sorted_ = placed.repartitionByRange(count, "dim", "block", "place", "class").sortWithinPartitions("dim", "block", "place", "class")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held, key = [], None

        def tile():
            nonlocal number
            number += 1
            ids, counts, vecs, places = zip(*held, strict=True)
            held.clear()
            return pa.RecordBatch.from_pydict({
                "tile": [number], "dim": [key[0]], "block": [key[1]], "low": [places[0]], "high": [places[-1]],
                "ids": [np.array(ids, "<i8").tobytes()], "counts": [np.array(counts, "<i8").tobytes()], "vecs": [b"".join(vecs)],
            })

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("dim", "block", "class", "n", "vec", "place")]
            for dim, block, *row in zip(*columns, strict=True):
                if held and (len(held) == TILE or key != (dim, block)):
                    yield tile()
                key = (dim, block)
                held.append(row)
        if held:
            yield tile()

    return saved(sorted_.mapInArrow(
        pack, "tile long, dim long, block long, low double, high double, ids binary, counts binary, vecs binary"), "tiles")


def class_links(classes: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(class, links, root) from (class, n, dim, vec): how many rows of other classes link, and a spanning forest.
    ``kind`` is the numpy type of the packed vectors; all arithmetic is in doubles."""
    tiled = tiles(classes, kind)
    meta = tiled.select("tile", "dim", "block", "low", "high")
    reach = F.sqrt(F.lit((2 - 2 * cosine) * 1.000001) / F.least(F.lit(BLOCKS), F.col("dim"))) * F.sqrt(
        F.ceil(F.col("dim") / F.least(F.lit(BLOCKS), F.col("dim"))) * F.least(F.lit(BLOCKS), F.col("dim")) / F.col("dim")
    ) + 1e-6  # of the largest block
    cell = F.floor(F.col("low") / reach)
    near = meta.select(
        F.col("tile").alias("a"), "dim", "block", "low", (F.col("high") + reach).alias("upto"),
        F.explode(F.sequence(cell, F.floor((F.col("high") + reach) / reach))).alias("cell"),
    )
    other = meta.select(F.col("tile").alias("b"), "dim", "block", F.col("low").alias("from"), cell.alias("cell"))
    pairs = near.join(other, ["dim", "block", "cell"]).filter("a <= b and `from` <= upto").select("a", "b")
    data = ("ids", "counts", "vecs")
    met = pairs.join(tiled.select(F.col("tile").alias("a"), "dim", "block", *[F.col(c).alias(f"{c}_a") for c in data]), "a").join(
        tiled.select(F.col("tile").alias("b"), *[F.col(c).alias(f"{c}_b") for c in data]), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same, dim = row["a"] == row["b"], row["dim"]
                ids = [np.frombuffer(row[f"ids_{s}"], "<i8") for s in "ab"]
                n = [np.frombuffer(row[f"counts_{s}"], "<i8") for s in "ab"]
                a, b = (units(np.frombuffer(row[f"vecs_{s}"], kind).reshape(-1, dim)) for s in "ab")
                shift = 0 if same else len(a)
                both = np.zeros(len(a) + (0 if same else len(b)), np.int64)
                label = np.arange(len(both))
                for i, j in linked(a, b, row["block"], cosine, same):
                    both += np.bincount(i, n[1][j], len(both)).astype(np.int64)
                    both += np.bincount(j + shift, n[0][i], len(both)).astype(np.int64)
                    label = local_components(len(both), i, j + shift, label)
                name = ids[0] if same else np.concatenate(ids)
                found = np.flatnonzero(both)
                yield pa.RecordBatch.from_arrays([pa.array(name[found]), pa.array(both[found]), pa.array(name[label[found]])], ["class", "links", "root"])
        release()

    return met.select("a", "b", "dim", "block", *[f"{c}_{s}" for c in data for s in "ab"]).mapInArrow(run, "class long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) per row."""
    bounded_batches(vectors.sparkSession)
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"  # as given
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    some = usable(F.col("v")) & F.col("id").isNotNull() & F.exists("v", lambda x: x != 0)
    part = rows.filter(F.coalesce(some, F.lit(False)))
    equal = saved(part.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn(
        "class", F.monotonically_increasing_id()).withColumn("dim", F.size("v").cast("long")), "classes")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            vecs = [flat[a:b].astype(kind).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(vecs, pa.binary())], ["class", "n", "dim", "vec"])

    packed = saved(equal.select("class", "n", "dim", "v").mapInArrow(pack, "class long, n long, dim long, vec binary"), "vectors")
    links = saved(class_links(packed, cosine, kind), "links")
    counts = links.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    named = saved(equal.select("class", "v", "least", "n").join(counts, "class", "left").join(roots, "class", "left").withColumn(
        "root", F.coalesce("root", "class")), "named")
    smallest = saved(named.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    classes = named.join(smallest, "root").select(
        F.xxhash64("v").alias("h"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    keyed = rows.withColumn("h", F.when(F.coalesce(some, F.lit(False)), F.xxhash64("v")))
    joined = keyed.filter("h is not null").join(classes, "h").filter("v = w").select("id", "n_links", "component_id")
    alone = keyed.filter("h is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


_SQL = """
with recursive v as (
    select row_number() over () as r, vec_id,
           case when embedding is not null and vec_id is not null
                 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
                then [x::double for x in embedding] end as v
    from embeddings),
u as (select r, vec_id, v, sqrt(list_dot_product(v, v)) as size from v where v is not null),
links as (select a.r as a, b.r as b from u a join u b
          on a.r <> b.r and a.size > 0 and b.size > 0 and list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.9),
reach(r, other) as (select r, r from v union select reach.r, links.b from reach join links on reach.other = links.a),
ids as (select reach.r, min(v.vec_id) as component_id from reach join v on v.r = reach.other group by all),
counts as (select a as r, count(*) as n from links group by all)
select vec_id, coalesce(n, 0) as n_links, component_id, coalesce(vec_id = component_id, false) as kept
from v join ids using (r) left join counts using (r)"""


@query("op5_embedding_dedup", _SQL)
def _embedding_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
