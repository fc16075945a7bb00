"""Fact text: nodes, edges, properties and labelled examples as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TERM = r"(\w+)\(([^()]*)\)"
_EDGE = rf"^(\w+)\({_TERM},\s*{_TERM}\)\.$"
_PROPERTY = rf"^(\w+)\({_TERM},\s*([^()]*)\)\.$"
_NODE = r"^(\w+)\(([^()]*)\)\.$"


def _lines(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.text(list(paths)).select(F.trim("value").alias("value"))


def read_nodes(spark: SparkSession, *paths: str) -> DataFrame:
    """``gene(x).`` -> (type, id)."""
    g = lambda k: F.regexp_extract("value", _NODE, k)
    rows = _lines(spark, *paths).filter(F.col("value").rlike(_NODE))
    return rows.select(g(1).alias("type"), g(2).alias("id"))


def read_edges(spark: SparkSession, *paths: str) -> DataFrame:
    """``pred(a(x), b(y)).`` -> (pred, src_type, src_id, dst_type, dst_id)."""
    g = lambda k: F.regexp_extract("value", _EDGE, k)
    rows = _lines(spark, *paths).filter(F.col("value").rlike(_EDGE))
    names = ("pred", "src_type", "src_id", "dst_type", "dst_id")
    return rows.select(*[g(i + 1).alias(n) for i, n in enumerate(names)])


def read_properties(spark: SparkSession, *paths: str) -> DataFrame:
    """``prop(a(x), value).`` -> (prop, type, id, value)."""
    g = lambda k: F.regexp_extract("value", _PROPERTY, k)
    rows = _lines(spark, *paths).filter(F.col("value").rlike(_PROPERTY))
    return rows.select(g(1).alias("prop"), g(2).alias("type"), g(3).alias("id"), F.trim(g(4)).alias("value"))


def load_sources(spark: SparkSession, config: dict[str, dict], wanted: list[str]) -> DataFrame:
    """Edges of the wanted sources of a ``{name: {path, nodes, edges}}`` configuration."""
    paths = [config[s]["path"] + "/edges" for s in wanted if config[s].get("edges")]
    return read_edges(spark, *paths)


def save_edges(edges: DataFrame, path: str) -> None:
    """Parquet by predicate, so that a rule reads only the facts it names."""
    edges.write.partitionBy("pred").parquet(path)


def chromosome_background(facts: DataFrame, properties: DataFrame, chromosome: str, on: str = "src_id") -> DataFrame:
    """Facts whose subject lies on one chromosome."""
    there = properties.filter((F.col("prop") == "chr") & (F.col("value") == chromosome)).select(F.col("id").alias(on))
    return facts.join(there.distinct(), on, "left_semi")


def read_examples(spark: SparkSession, path_glob: str) -> DataFrame:
    """``[neg(]relevant_gene(i, gene(G), snp(S))[)].`` -> (fold, example_id, gene, snp, label)."""
    pattern = r"relevant_gene\((\d+),\s*gene\(([^()]*)\),\s*snp\(([^()]*)\)\)"
    rows = spark.read.text(path_glob).filter(F.col("value").rlike(pattern))
    g = lambda k: F.regexp_extract("value", pattern, k)
    return rows.select(
        _fold().alias("fold"), g(1).cast("long").alias("example_id"), g(2).alias("gene"), g(3).alias("snp"),
        (~F.trim("value").startswith("neg(")).alias("label"),
    )


def read_fold_ids(spark: SparkSession, path_glob: str) -> DataFrame:
    """One id per line, fold and split from the path -> (fold, split, example_id)."""
    split = F.regexp_extract(F.col("_metadata.file_path"), r"/(train|test)[^/]*(?:/[^/]*)?$", 1)
    rows = spark.read.text(path_glob).select(
        _fold().alias("fold"), split.alias("split"), F.trim("value").try_cast("long").alias("example_id")
    )
    return rows.filter(F.col("example_id").isNotNull())


def _fold():
    return F.regexp_extract(F.col("_metadata.file_path"), r"fold[_=](\d+)", 1).cast("int")
