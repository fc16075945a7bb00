"""Range joins on genome positions: equi-join on (chromosome, bin), residual test after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.functions.running import paged, running, shuffled
from locusloom.functions.session import saved

_BIN, _SALT = "__bin", "__salt"
GENE_WINDOW_BP = 500_000
ENHANCER_WINDOW_BP = 50_000


def range_join(
    points: DataFrame,
    ranges: DataFrame,
    pos: str,
    lo: str,
    hi: str,
    width: int,
    on: Sequence[str] = ("chr",),
    salt: int = 4,
) -> DataFrame:
    """Pairs with equal ``on`` and ``lo <= pos <= hi`` (both ends in).

    A point falls into exactly one bin, so no pair comes out twice. Points of one bin are
    spread over ``salt`` slots by a hash of the row, the ranges are copied to each slot:
    a bin holding a large share of all points is worked on by several tasks.
    """
    on = list(on)
    right = _slots(_bins(ranges, lo, hi, width), salt)
    return (
        _placed(points, pos, width, salt).join(shuffled(right), [*on, _BIN, _SALT])
        .filter((F.col(pos) >= F.col(lo)) & (F.col(pos) <= F.col(hi)))
        .drop(_BIN, _SALT)
    )


def range_arrays(
    points: DataFrame,
    ranges: DataFrame,
    pos: str,
    lo: str,
    hi: str,
    width: int,
    items: Sequence[str],
    out: str,
    on: Sequence[str] = ("chr",),
    salt: int = 4,
) -> DataFrame:
    """The pairs of :func:`range_join` with the ``items`` of a point's ranges in arrays ``out``; points in no range drop out.

    The ranges of a bin meet its points in pages, so the pairs of a point are one row, or one for each page of a crowded bin.
    """
    on, items = list(on), list(items)
    pages = paged(_bins(ranges, lo, hi, width), [*on, _BIN], [lo, hi, *items], out)
    met = _placed(points, pos, width, salt).join(shuffled(_slots(pages, salt)), [*on, _BIN, _SALT])
    # positions travel as an argument: a column used inside a function of an array is overlooked when filters move below a join
    held = F.zip_with(out, F.array_repeat(pos, F.size(out)), lambda r, at: F.when(
        (r[lo] <= at) & (at <= r[hi]), F.struct(*[r[c].alias(c) for c in items])))
    return met.withColumn(out, F.filter(held, lambda r: r.isNotNull())).filter(F.size(out) > 0).drop(_BIN, _SALT)


def _placed(points: DataFrame, pos: str, width: int, salt: int) -> DataFrame:
    """Points with their bin and a slot by hash of the row."""
    slot = F.pmod(F.xxhash64(*points.columns), F.lit(salt)).cast("int")
    return points.withColumn(_BIN, F.floor(F.col(pos) / width)).withColumn(_SALT, slot)


def _bins(ranges: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """A row for each bin that a range touches."""
    touched = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    return ranges.filter(F.col(lo) <= F.col(hi)).withColumn(_BIN, F.explode(touched))


def _slots(ranges: DataFrame, salt: int) -> DataFrame:
    """A copy for each slot."""
    return ranges.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))


def distance_ranges(features: DataFrame, start: str, end: str, k: int, include_spanning: bool = False) -> DataFrame:
    """Disjoint ranges ``lo..hi`` of positions within ``k`` of either end of a feature.

    A long feature gives two ranges, unless ``include_spanning`` also counts its middle.
    """
    s, e = F.col(start), F.col(end)
    whole = F.array(F.struct((s - k).alias("lo"), (e + k).alias("hi")))
    halves = F.array(
        F.struct((s - k).alias("lo"), (s + k).alias("hi")),
        F.struct((e - k).alias("lo"), (e + k).alias("hi")),
    )
    spans = whole if include_spanning else F.when(e - s <= 2 * k, whole).otherwise(halves)
    return features.withColumn("__r", F.explode(spans)).select(
        *features.columns, F.col("__r.lo").alias("__lo"), F.col("__r.hi").alias("__hi")
    )


def within_k_distance(
    variants: DataFrame, features: DataFrame, k: int, pos: str, start: str, end: str,
    include_spanning: bool = False,
) -> DataFrame:
    """Variant-feature pairs on one chromosome with an end at most ``k`` bp away."""
    ranges = distance_ranges(features, start, end, k, include_spanning)
    return range_join(variants, ranges, pos, "__lo", "__hi", max(2 * k, 1)).drop("__lo", "__hi")


def arrays_within_k_distance(
    variants: DataFrame, features: DataFrame, k: int, pos: str, start: str, end: str, items: Sequence[str], out: str,
) -> DataFrame:
    """The pairs of :func:`within_k_distance` with a variant's ``items`` in arrays ``out``."""
    ranges = distance_ranges(features, start, end, k)
    return range_arrays(variants, ranges, pos, "__lo", "__hi", max(2 * k, 1), items, out)


def contained_in(
    inner: DataFrame, outer: DataFrame, inner_start: str, inner_end: str,
    outer_start: str, outer_end: str, width: int = 20_000,
) -> DataFrame:
    """Strict containment: outer start < inner start and inner end < outer end."""
    ranges = outer.withColumn("__lo", F.col(outer_start) + 1).withColumn("__hi", F.col(outer_end) - 1)
    return (
        range_join(inner, ranges, inner_start, "__lo", "__hi", width)
        .filter(F.col(inner_end) < F.col(outer_end))
        .drop("__lo", "__hi")
    )


def merge_intervals(ranges: DataFrame, keys: Sequence[str], start: str, end: str, width: int = 10_000_000) -> DataFrame:
    """Union of overlapping or touching intervals per key (gaps and islands)."""
    keys = list(keys)
    spread = ranges.select(*keys, start, end).distinct()
    bucket = F.floor(F.col(start) / width)
    order = [F.col(start), F.col(end)]
    marked = running(spread, keys, bucket, order, F.col(end), "__reach", how="max", exclusive=True)
    opens = F.when(F.col("__reach").isNull() | (F.col("__reach") < F.col(start)), 1).otherwise(0)
    islands = running(marked.withColumn("__open", opens), keys, bucket, order, F.col("__open"), "__island")
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def annotate(variants: DataFrame, peaks: DataFrame, pos: str, start: str, end: str, label: str, width: int = 20_000) -> DataFrame:
    """(variant, label) rows for half-open peaks ``start < pos <= end``, each pair once."""
    merged = merge_intervals(peaks, ["chr", label], start, end)
    ranges = merged.select("chr", label, (F.col(start) + 1).alias("__lo"), F.col(end).alias("__hi"))
    return range_join(variants, ranges, pos, "__lo", "__hi", width).drop("__lo", "__hi")


def region_members(leads: DataFrame, sumstats: DataFrame, window_kb: int = 2000, min_rows: int = 2) -> DataFrame:
    """All variants within ``window_kb`` of each lead; regions below ``min_rows`` are dropped.

    ``leads`` has ``region_id, chr, center``; ``sumstats`` has ``chr, bp`` and more.
    """
    w = window_kb * 1000
    ranges = leads.select(
        "region_id", "chr", "center", (F.col("center") - w).alias("__lo"), (F.col("center") + w).alias("__hi")
    )
    members = saved(range_join(sumstats, ranges, "bp", "__lo", "__hi", 2 * w).drop("__lo", "__hi"), "members")  # read twice
    enough = members.groupBy("region_id").count().filter(F.col("count") >= min_rows).select("region_id")
    return members.join(enough, "region_id", "left_semi")
