"""Scores of predictions: outcome classes, precision/recall, ROC and PR curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.functions.running import running, shuffled, spread, unit_bucket
from locusloom.functions.session import cut_lineage


def outcome(pred: Column, truth: Column, genes: Column) -> Column:
    """1 exact hit, 0 another listed gene, -1 not in the list text (substring test)."""
    return F.when(F.instr(genes, pred) > 0, F.when(pred == truth, 1).otherwise(0)).otherwise(-1)


def is_listed(pred: Column, genes: Column) -> Column:
    """Exact membership in ``{A},{B}`` text, next to the substring test."""
    return F.array_contains(F.split(F.regexp_replace(genes, r"[{}]", ""), ","), pred)


def precision_recall(rows: DataFrame, keys: Sequence[str], outcome_column: str = "outcome") -> DataFrame:
    o = F.col(outcome_column)
    counts = rows.groupBy(*keys).agg(
        F.count_if(o == 1).alias("correct"), F.count_if(o == 0).alias("incorrect"), F.count_if(o == -1).alias("unlisted"))
    total = F.col("correct") + F.col("incorrect")
    scored = counts.withColumns({
        "precision": F.try_divide("correct", total), "recall": F.try_divide("correct", total + F.col("unlisted"))})
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.try_divide(2 * p * r, p + r))


def curve_points(scored: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """One row per distinct score, best first: own and running true/false positives.

    Scores lie in [0, 1]; ties fold into one point before any ordering.
    """
    keys = list(keys)
    steps = cut_lineage(scored.groupBy(*keys, score).agg(
        F.count_if(F.col(label)).alias("d_tp"), F.count_if(~F.col(label)).alias("d_fp")))
    bucket, order = unit_bucket(F.col(score)), [F.col(score).desc()]
    tp = running(steps, keys, bucket, order, F.col("d_tp"), "tp", descending=True)
    both = running(tp, keys, bucket, order, F.col("d_fp"), "fp", descending=True)
    totals = steps.groupBy(*keys).agg(F.sum("d_tp").alias("pos"), F.sum("d_fp").alias("neg"))
    return both.join(totals, keys)


def roc_pr_points(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.select(
        *keys, F.try_divide("fp", "neg").alias("fpr"), F.try_divide("tp", "pos").alias("tpr"),
        F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"))


def areas(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trapezoid areas. The point before is the running count less the own share, so the
    areas are plain sums. ROC starts at (0,0); a PR curve of one point has no area."""
    tp0, fp0 = F.col("tp") - F.col("d_tp"), F.col("fp") - F.col("d_fp")
    roc = F.try_divide("d_fp", "neg") * F.try_divide(F.col("tp") + tp0, 2 * F.col("pos"))
    before = F.try_divide(tp0, tp0 + fp0)
    now = F.try_divide("tp", F.col("tp") + F.col("fp"))
    pr = F.when(before.isNotNull(), F.try_divide("d_tp", "pos") * (now + before) / 2)
    return points.groupBy(*keys).agg(F.sum(roc).alias("auc_roc"), F.sum(pr).alias("auc_pr"))


def fold_summary(metrics: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of the fold areas, nulls left out."""
    return metrics.agg(
        F.avg("auc_roc").alias("mean_roc"), F.stddev_samp("auc_roc").alias("sd_roc"),
        F.avg("auc_pr").alias("mean_pr"), F.stddev_samp("auc_pr").alias("sd_pr"))


def truth_membership(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(snp, gene, pred, num_pred): is the gold gene among the predicted ones, and how many.

    ``gold(snp, gene)`` and ``predicted(snp, gene)`` are trimmed and lower-cased here.
    """
    clean = lambda c: F.lower(F.trim(c))
    want = gold.select(clean("snp").alias("snp"), clean("gene").alias("gene"))
    # one set for each spelling of a variant, where predictions dealt by variant already lie; only the sets are shuffled
    spelt = predicted.groupBy("snp").agg(F.collect_set(F.struct(clean("gene").alias("gene"))).alias("__genes"))
    plain = spread(spelt.select(clean("snp").alias("snp"), F.sort_array(F.col("__genes")["gene"]).alias("__genes")), "snp")
    have = plain.groupBy("snp").agg(F.array_distinct(F.flatten(F.collect_list("__genes"))).alias("__genes"))
    joined = want.join(shuffled(have), "snp", "left")
    return joined.select(
        "snp", "gene", F.coalesce(F.array_contains("__genes", F.col("gene")).cast("int"), F.lit(0)).alias("pred"),
        F.coalesce(F.array_size("__genes"), F.lit(0)).cast("long").alias("num_pred"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows, the same for the same seed whatever the partitioning."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(draw, F.col(key)).limit(n)
