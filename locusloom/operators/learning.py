"""Rule-weight learning: EM on noisy-or examples, and their held-out likelihood."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Start weight, stopping threshold and number of restarts of the learner.
START_WEIGHT, EPS, RESTARTS = 0.25, 0.001, 3


def firing_patterns(examples: DataFrame, keys: Sequence[str], rules: Sequence[str]) -> DataFrame:
    """Examples folded to counts per (keys, rule flags, label): 2^(rules+1) rows per key at most."""
    return examples.groupBy(*keys, *rules, "label").agg(F.count("*").alias("n"))


def class_balance(examples: DataFrame) -> DataFrame:
    return examples.groupBy("fold", "split", "label").agg(F.count("*").alias("n"))


def _miss(rules: Sequence[str], weights):
    out = F.lit(1.0)
    for r in rules:
        out = out * (1 - weights[r] * F.col(r))
    return out


def em_step(patterns: DataFrame, keys: Sequence[str], rules: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """One EM update as a single aggregate: expected firings over rule applications."""
    p = 1 - _miss(rules, {r: F.lit(float(weights[r])) for r in rules})
    hits = {r: F.when(F.col("label") & (F.col(r) == 1), F.col("n") * F.lit(float(weights[r])) / p).otherwise(0.0) for r in rules}
    return patterns.groupBy(*keys).agg(
        *[(F.sum(hits[r]) / F.nullif(F.sum(F.col("n") * F.col(r)), F.lit(0))).alias(r) for r in rules])


def _fit(flags: np.ndarray, label: np.ndarray, n: np.ndarray, w: np.ndarray, eps: float, max_steps: int):
    applied = (flags * n[:, None]).sum(0)
    last, converged = -np.inf, False
    for _ in range(max_steps):
        p = np.clip(1 - np.prod(1 - flags * w, axis=1), 1e-12, 1 - 1e-12)
        ll = float((n * np.where(label, np.log(p), np.log1p(-p))).sum())
        if abs(ll - last) < eps:
            converged = True
            break
        last = ll
        hits = (flags * w * (n * label / p)[:, None]).sum(0)
        w = np.where(applied > 0, hits / np.maximum(applied, 1), w)
    return w, ll, converged


def learn_weights(
    patterns: DataFrame, key: str, rules: Sequence[str], eps: float = EPS, restarts: int = RESTARTS, seed: int = 42,
    max_steps: int = 100_000,
) -> DataFrame:
    """(key, rule weights, log_likelihood, converged): best of several EM runs per key.

    A group is the folded pattern table of one key, at most 2^(rules+1) rows however many
    examples there are.
    """
    rules = list(rules)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        flags, label, n = pdf[rules].to_numpy(float), pdf["label"].to_numpy(bool), pdf["n"].to_numpy(float)
        rng = np.random.default_rng(seed)
        starts = [np.full(len(rules), START_WEIGHT)] + [rng.uniform(0.01, 0.99, len(rules)) for _ in range(restarts - 1)]
        w, ll, converged = max((_fit(flags, label, n, s, eps, max_steps) for s in starts), key=lambda f: f[1])
        return pd.DataFrame([[pdf[key].iloc[0], *w, ll, converged]], columns=[key, *rules, "log_likelihood", "converged"])

    schema = f"{key} int, " + ", ".join(f"{r} double" for r in rules) + ", log_likelihood double, converged boolean"
    return patterns.groupBy(key).applyInPandas(fit, schema)


def held_out_likelihood(patterns: DataFrame, weights: DataFrame, key: str, rules: Sequence[str]) -> DataFrame:
    """Sum of ln p over positives and ln(1-p) over negatives with each key's weights."""
    fitted = weights.select(key, *[F.col(r).alias(f"__{r}") for r in rules])
    miss = F.lit(1.0)
    for r in rules:
        miss = miss * (1 - F.col(f"__{r}") * F.col(r))
    p = F.least(F.greatest(1 - miss, F.lit(1e-12)), F.lit(1 - 1e-12))
    ll = F.sum(F.col("n") * F.when(F.col("label"), F.log(p)).otherwise(F.log1p(-p)))
    return patterns.join(fitted, key).groupBy(key).agg(ll.alias("log_likelihood"))
