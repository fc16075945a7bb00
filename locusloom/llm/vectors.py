"""Helpers for tables of vectors: which rows take part, and vectors as packed bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def matrix(column, dim: int, kind: str = "<f8") -> np.ndarray:
    """Rows of one dimension from their packed bytes."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), dim)
