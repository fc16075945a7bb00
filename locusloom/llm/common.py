"""Materialised intermediate tables and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.functions.session import BATCH, bounded_batches, release, saved  # noqa: F401


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find: (a, b) links -> (node, root), root = smallest node of the component.

    Each round hooks every node to its smallest neighbour, halves the paths by looking up the parent's
    parent, and contracts the links to parents; links inside a component vanish, so the table shrinks until
    none is left. Self-links name a node without a partner; nulls, repeats and either direction are allowed.
    Minimum per node is a partial aggregate, so a hub's links are folded before they move.
    """
    links = saved(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a is not null and b is not null").distinct(), "links",
    )
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    root = nodes.select("node", F.col("node").alias("root"))
    links = links.filter("a <> b")
    while not links.isEmpty():
        up = saved(links.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("p")), "hooks")
        grand = up.select(F.col("n").alias("p"), F.col("p").alias("pp"))
        parent = saved(up.join(grand, "p", "left").select("n", F.coalesce("pp", "p").alias("p")), "parents")

        def lift(df: DataFrame, col: str) -> DataFrame:
            to = parent.select(F.col("n").alias(col), F.col("p").alias("__p"))
            return df.join(to, col, "left").withColumn(col, F.coalesce("__p", col)).drop("__p")

        moved = lift(lift(links, "a"), "b").filter("a <> b")
        links = saved(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        root = saved(lift(root, "root"), "roots")
    return root


def local_components(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes through links i-j, on top of earlier ``label``s."""
    label = np.arange(n) if label is None else label
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label
