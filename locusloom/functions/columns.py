"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Numbers of the chromosomes that have none.
NAMED_CHROMOSOMES = {"X": 23, "Y": 24, "XY": 25, "M": 26, "MT": 26}


def chromosome(raw: Column) -> Column:
    """``chr7`` / ``CHR7`` / ``7`` -> 7, X 23, Y 24, XY 25, MT 26; anything else -> null."""
    bare = F.upper(F.regexp_replace(F.trim(raw.cast("string")), "(?i)^chr", ""))
    number = bare.try_cast("int")
    for name, code in NAMED_CHROMOSOMES.items():
        number = F.when(bare == name, code).otherwise(number)
    return number


def variant_id(chr_: Column, bp: Column, a2: Column, a1: Column) -> Column:
    """``CHR:BP:A2:A1``; null when a part is."""
    colon = F.lit(":")
    return F.concat(chr_.cast("string"), colon, bp.cast("string"), colon, a2, colon, a1)


def parsed_variant_id(id_: Column) -> Column:
    """struct(chr, bp, a2, a1), null when the text is not four fields with numbers in front."""
    parts = F.split(id_, ":")
    chr_, bp = parts[0].try_cast("int"), parts[1].try_cast("bigint")
    ok = (F.size(parts) == 4) & chr_.isNotNull() & bp.isNotNull()
    return F.when(ok, F.struct(chr_.alias("chr"), bp.alias("bp"), parts[2].alias("a2"), parts[3].alias("a1")))


def variant_label(chr_: Column, start: Column, end: Column, ref: Column, alt: Column) -> Column:
    """``Chr:Start-End-REF>ALT`` with alleles in capitals."""
    return F.format_string(
        "%s:%s-%s-%s>%s", chr_.cast("string"), start.cast("string"), end.cast("string"), F.upper(ref), F.upper(alt)
    )


def z_score(beta: Column, se: Column, z: Column | None = None) -> Column:
    """The given z, else beta / se; a zero standard error gives null."""
    ratio = beta / F.nullif(se, F.lit(0.0))
    return ratio if z is None else F.coalesce(z, ratio)


def log_p(p: Column) -> Column:
    """-log10 p; p = 0 counts as the smallest positive number."""
    return -F.log10(F.when(p == 0, 5e-324).otherwise(p))


def is_strand_ambiguous(a1: Column, a2: Column) -> Column:
    """The allele pair is {A,T} or {C,G}."""
    pair = F.concat(F.least(a1, a2), F.greatest(a1, a2))
    return pair.isin("AT", "CG")


def impact(vest: Column, sift: Column) -> Column:
    """struct(is_damaging, confidence) from a VEST and a SIFT score, either may be null."""
    damaging = F.coalesce(vest > 0.5, F.lit(False)) | F.coalesce(sift < 0.05, F.lit(False))
    agree = F.coalesce(vest > 0.8, F.lit(False)) & F.coalesce(sift < 0.01, F.lit(False))
    confidence = (
        F.when(vest.isNull() & sift.isNull(), "no_data")
        .when(damaging & agree, "high").when(damaging, "medium").otherwise("low")
    )
    return F.struct(damaging.alias("is_damaging"), confidence.alias("confidence"))


def safe_name(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^A-Za-z0-9_-]", "_")


def tissue_label(raw: Column) -> Column:
    """``Brain_(cortex)`` -> ``Brain_cortex``."""
    return F.replace(F.regexp_replace(raw, r"_\(", "_"), F.lit(")"), F.lit(""))


def file_stem(path: Column) -> Column:
    """File name without folder, compression and table suffixes."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)(\.(tsv|csv|txt))?(\.(gz|bgz))?$", "")


def term_id(term: Column) -> Column:
    """The GO id in parentheses, else the text of the first parenthesis, else ''."""
    go = F.regexp_extract(term, r"\((GO:\d+)\)", 1)
    return F.when(go != "", go).otherwise(F.regexp_extract(term, r"\(([^)]*)\)", 1))


def term_name(term: Column) -> Column:
    return F.substring_index(term, "(", 1)


def text_bucket(text: Column) -> Column:
    """Ordered bucket of a string: its first four bytes as a number."""
    return F.conv(F.rpad(F.substring(F.hex(text), 1, 8), 8, "0"), 16, 10).cast("long")


def parse_stamp(stamp: Column) -> Column:
    """ISO text that may carry both an offset and a Z."""
    return F.to_timestamp(F.regexp_replace(stamp, r"(\+\d\d:\d\d)Z$", "$1"))
