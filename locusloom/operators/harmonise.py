"""Summary statistics: column names, quality rules, lookups and merges."""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusloom.functions import columns as C
from locusloom.functions.running import numbered, top_k

# Accepted header names per target, first present name wins.
ALIASES: dict[str, tuple[str, ...]] = {
    "snp": ("markername", "snptestid", "id", "snp", "rsid", "variant_id"),
    "chr": ("chr", "chrom", "chromosome", "#chrom", "hm_chrom"),
    "pos": ("pos", "bp", "position", "bp_hg19", "base_pair_location"),
    "a1": ("a1", "effect_allele", "alt", "hm_effect_allele"),
    "a2": ("a2", "noneffect_allele", "other_allele", "ref", "hm_other_allele"),
    "beta": ("logor", "log_or", "beta", "b", "hm_beta"),
    "se": ("se_gc", "stderrlogor", "se", "stderr", "standard_error"),
    "p": ("p-value_gc", "pvalue", "p_value", "p-value", "p"),
    "n": ("n_samples", "neff", "n", "n_total"),
}
EXTRA_ALIASES = {"frq": ("frq", "freq", "eaf", "maf", "effect_allele_frequency", "hm_effect_allele_frequency"), "z": ("z", "zscore")}
OUTPUT_ORDER = ("chr", "pos", "snp", "a1", "a2", "beta", "se", "p", "n")
REQUIRED = ("a1", "a2", "beta", "p")
DEFAULT_SAMPLE_SIZE = 807553
GENOME_WIDE_P = 5e-8
BUILDS = ("GRCh37", "GRCh38")


def _source(columns: list[str], target: str) -> str | None:
    """The column that stands for ``target``."""
    present = {c.lower(): c for c in columns}
    return next((present[n] for n in ALIASES[target] if n in present), None)


def canonical_columns(df: DataFrame) -> DataFrame:
    """Keep the nine known columns under their target names, in the output order."""
    found = {t: _source(df.columns, t) for t in OUTPUT_ORDER}
    return df.select(*[F.col(f"`{c}`").alias(t) for t, c in found.items() if c])


def is_ldsc_format(columns: list[str]) -> bool:
    """Already reduced to z-scores: z and snp, but neither beta nor logor."""
    low = {c.lower() for c in columns}
    return {"z", "snp"} <= low and not low & {"beta", "logor"}


def rs_id(columns: list[str]) -> Column:
    """SNP, else RSID, else null."""
    by_name = {c.lower(): c for c in columns}
    hit = by_name.get("snp") or by_name.get("rsid")
    return F.col(hit) if hit else F.lit(None).cast("string")


def coerce(df: DataFrame) -> DataFrame:
    """Text columns to numbers (bad text -> null), alleles to capitals, chromosome to int."""
    casts: dict[str, Column] = {}
    for c, t in (("pos", "bigint"), ("beta", "double"), ("se", "double"), ("p", "double"), ("n", "bigint")):
        if c in df.columns:
            casts[c] = F.col(c).try_cast(t)
    for c in ("a1", "a2"):
        if c in df.columns:
            casts[c] = F.upper(c)
    if "chr" in df.columns:
        casts["chr"] = C.chromosome(F.col("chr"))
    return df.withColumns(casts)


def drop_missing(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    return df.dropna(subset=[c for c in required if c in df.columns])


def position_lookup(df: DataFrame, bim: DataFrame) -> DataFrame:
    """Take chr/pos from the variant map by rs id (first map row per id); unmatched rows drop."""
    first = top_k(bim.select("snp", "chr", "pos"), ["snp"], [F.col("chr"), F.col("pos")], 1)
    return df.drop("chr", "pos").join(first, "snp")


def in_panel(df: DataFrame, bim: DataFrame, missing: bool = False) -> DataFrame:
    """Variants present in (or, with ``missing``, absent from) the reference panel."""
    return df.join(bim.select("snp").distinct(), "snp", "left_anti" if missing else "left_semi")


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key; rows that lack a part of the key are no repeats of each other and all stay."""
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    # one pass over the rows: a row without a whole key gets a group of its own
    alone = df.withColumn("__alone", F.when(~whole, F.monotonically_increasing_id()))
    return top_k(alone, [*keys, "__alone"], order, 1).drop("__alone")


def munge(df: DataFrame) -> DataFrame:
    """Quality-controlled statistics with one row per rs id and per position, ``z`` and ``id``.

    The allele frequency and a given z are kept where the input has them; rows without an rs id or position stay.
    """
    present = {c.lower(): c for c in df.columns}
    extra = {t: next((present[n] for n in names if n in present), None) for t, names in EXTRA_ALIASES.items()}
    named = df.select("*", *[F.col(f"`{c}`").alias(f"__{t}") for t, c in extra.items() if c])
    base = canonical_columns(named)
    rows = named.select(*[F.col(f"`{_source(named.columns, t)}`").alias(t) for t in base.columns],
                        *[F.col(f"__{t}").try_cast("double").alias(t) for t, c in extra.items() if c])
    rows = drop_missing(coerce(rows))
    bases = "[ACGT]"
    kept = rows.filter(
        F.col("p").between(0, 1) & (F.col("se") > 0)
        & F.col("a1").rlike(f"^{bases}$") & F.col("a2").rlike(f"^{bases}$") & (F.col("a1") != F.col("a2"))
    )
    by_id = first_by_key(kept, ["snp"], [F.col("p"), F.col("pos")])
    by_place = first_by_key(by_id, ["chr", "pos"], [F.col("p"), F.col("snp")])
    return by_place.withColumns({
        "z": C.z_score(F.col("beta"), F.col("se"), F.col("z") if extra["z"] else None),
        "id": C.variant_id(F.col("chr"), F.col("pos"), F.col("a2"), F.col("a1")),
    })


def significant(df: DataFrame, threshold: float = GENOME_WIDE_P) -> DataFrame:
    return df.filter(F.col("p") < threshold)


def hapmap_merge(df: DataFrame, hapmap: DataFrame) -> DataFrame:
    """Keep listed SNPs whose effect allele is one of the listed alleles."""
    listed = hapmap.select("snp", F.col("a1").alias("__h1"), F.col("a2").alias("__h2"))
    agree = (F.col("a1") == F.col("__h1")) | (F.col("a1") == F.col("__h2"))
    return df.join(listed, "snp").filter(agree).drop("__h1", "__h2")


def ldsc_table(df: DataFrame, hapmap: DataFrame) -> DataFrame:
    """snp, a1, a2, z, n without strand-ambiguous pairs."""
    merged = hapmap_merge(df, hapmap)
    kept = merged.filter(~C.is_strand_ambiguous(F.col("a1"), F.col("a2")))
    out = kept.select("snp", "a1", "a2", C.z_score(F.col("beta"), F.col("se")).alias("z"), "n")
    return out.dropna(subset=["snp", "a1", "a2", "z"])


def sample_size_column(columns: list[str]) -> str | None:
    """A column called n or holding both 'sample' and 'size'."""
    return next((c for c in columns if c.lower() == "n" or ("sample" in c.lower() and "size" in c.lower())), None)


def _find_n(node):
    if isinstance(node, dict):
        for key, value in node.items():
            low = key.lower()
            named = low == "n" or ("sample" in low and "size" in low)
            if named and isinstance(value, (int, float)) and int(value):
                return int(value)
        node = list(node.values())
    if isinstance(node, list):
        return next((n for n in map(_find_n, node) if n), None)
    return None


@F.pandas_udf(T.LongType())
def metadata_sample_size(metadata: pd.Series) -> pd.Series:
    """First sample size found in nested study metadata (JSON text); 0 counts as missing."""
    return metadata.map(lambda text: _find_n(json.loads(text)) if text else None).astype("Int64")


def resolve_sample_size(from_column: Column, metadata: Column) -> Column:
    """Column maximum, else metadata, else the fixed default."""
    return F.coalesce(from_column, metadata_sample_size(metadata), F.lit(DEFAULT_SAMPLE_SIZE)).cast("long")


def study_sample_sizes(stats: DataFrame, keys: list[str], metadata: DataFrame) -> DataFrame:
    """(keys, n) per study: the maximum of the sample-size column of ``stats``, if it has one, else ``metadata``'s."""
    column = sample_size_column(stats.columns)
    most = F.max(F.col(f"`{column}`").try_cast("double")) if column else F.lit(None).cast("double")
    sizes = stats.groupBy(*keys).agg(most.alias("__n"))
    return metadata.join(sizes, keys, "left").select(
        *keys, resolve_sample_size(F.col("__n").cast("long"), F.col("metadata")).alias("n"))


def unique_safe_names(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Safe names in raw-name order; the second, third ... holder of a name gets _2, _3 ..."""
    named = df.withColumn("__safe", C.safe_name(F.col(raw)))
    order = C.text_bucket(F.col(raw))
    ranked = numbered(named, ["__safe"], order, [F.col(raw)], "__k")
    suffix = F.when(F.col("__k") > 1, F.concat(F.lit("_"), F.col("__k").cast("string"))).otherwise("")
    return ranked.withColumn(out, F.concat("__safe", suffix)).drop("__safe", "__k")


def motif_long(matrix: DataFrame, id_column: str, tf_columns: list[str]) -> DataFrame:
    """Motif matrix (one column per factor) -> (variant, tf, score, type); zero effects drop."""
    long = matrix.unpivot(id_column, tf_columns, "tf", "score")
    kind = F.when(F.col("score") < 0, "loss").when(F.col("score") > 0, "gain")
    return long.select(
        F.col(id_column).alias("variant"), F.lower(F.substring_index("tf", "_", 1)).alias("tf"), "score",
        kind.alias("type"),
    ).filter(F.col("type").isNotNull())


# Fixed values in it: the accepted ranges.
def run_problems() -> Column:
    """Array of reasons why a requested run is refused; empty when it is fine."""
    bad = lambda cond, text: F.when(cond, F.lit(text))
    return F.array_compact(F.array(
        bad(~F.col("ref_genome").isin(*BUILDS), "ref_genome"),
        bad(~F.col("population").isin("EUR", "AFR", "AMR", "EAS", "SAS"), "population"),
        bad(~F.col("max_workers").between(1, 16), "max_workers"),
        bad(~F.col("maf").between(0.001, 0.5), "maf"),
        bad(~F.col("seed").between(1, 999999), "seed"),
        bad(F.col("window") > 10000, "window"),
        bad((F.col("l") != -1) & ~F.col("l").between(1, 50), "l"),
        bad(~F.col("coverage").between(0.5, 0.999), "coverage"),
        bad(~F.col("min_abs_corr").between(0.5, 1.0), "min_abs_corr"),
        bad(~F.col("batch_size").between(1, 20), "batch_size"),
    ))
