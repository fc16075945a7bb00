"""A training corpus from ``documents``: language, lines, near-duplicates, mixture, sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again by the next.
All but the last return the columns of ``documents``; nulls, repeated rows and extra columns are handled as each operator
states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.llm import langid, line_dedup, mixing, packing, simhash
from locusloom.llm.common import saved

#: Learned models, hashing and whole-corpus components have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go; ``lang`` becomes the language found."""
    given = docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("row"))
    found = langid.identify(given).filter(F.col("found.lang") != "und")
    return found.select(*[F.col("found.lang").alias(c) if c == "lang" else F.col(f"row.{c}").alias(c) for c in docs.columns])


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts; ``n_chars`` follows."""
    aside = {c: f"__given_{c}" for c in docs.columns if c.lower() in ("n_lines", "n_kept")}  # the operator's own columns
    cut = line_dedup.deduplicate(docs.withColumnsRenamed(aside))
    return cut.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near-duplicates stays."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("simhash_dedup", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
