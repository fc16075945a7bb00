"""Sinks: delimited tables, BED files, ranked gene lists, work manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, sep: str = "\t", gzip: bool = True) -> None:
    writer = df.write.option("sep", sep).option("header", True).option("emptyValue", "")
    writer.csv(path, compression="gzip" if gzip else None)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, compression="gzip")


def write_bed(peaks: DataFrame, path: str) -> None:
    """``seqnames, start, end`` annotation -> headerless ``chr, start, end``."""
    peaks.select(F.col("seqnames").alias("chr"), "start", "end").write.option("sep", "\t").csv(path)


def write_ranked_list(df: DataFrame, path: str, symbol: str, score: str) -> None:
    """One ``symbol<TAB>0.1234`` line per row."""
    df.select(F.format_string("%s\t%.4f", F.col(symbol), F.col(score)).alias("value")).write.text(path)


def pending(work: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Work items not in the manifest of finished keys."""
    return work.join(finished.select(*keys).distinct(), keys, "left_anti")
