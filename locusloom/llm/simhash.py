"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 h`` bits share a variant within ``h`` bits of both. Every distinct
fingerprint emits its ball of radius ``h``, variants are shuffled, and fingerprints that meet on a variant are
verified. A variant gathers at most as many distinct fingerprints as the ball has members, so its group is
bounded without a cap, however many documents share a fingerprint.

Defined results: null and empty texts, and texts without a word, have fingerprint 0 and link like any other; a text of
fewer words than ``width`` is one shingle; repeated rows and null ids keep their own row; a null id never names a
component unless the component has no other id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusloom.llm.common import bounded_batches, components, release, saved
from locusloom.llm.registry import query, table

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_STEP = 1 << 16


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each word shingle of an ASCII-lower-cased text, in blocks of bounded size."""
    words = _WORD.findall(text)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    elif words:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _STEP):
        cuts = zip(starts[at : at + _STEP].tolist(), ends[at : at + _STEP].tolist(), strict=True)
        yield np.array([digest(line[a:b], seed) for a, b in cuts], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash as a signed long: a bit is set when over half of the shingle hashes have it."""
    total, count = 0, np.zeros(64, np.int64)
    for block in shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower(), width):
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
        total += len(block)
    packed = np.packbits(2 * count > total, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(text: Column, width: int = 3) -> Column:
    """SimHash column, batch by batch through Arrow."""

    @F.pandas_udf(T.LongType())
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(x, width) for x in batch], dtype="int64")
        release()

    return compute(text)


def ball_masks(radius: int) -> list[int]:
    """Signed 64-bit masks of at most ``radius`` set bits."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_components(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(fp) -> (fp, root) over links of at most ``distance`` differing bits, for the distinct values of ``fp``."""
    distinct = prints.select("fp").distinct()
    masks = F.array(*[F.lit(m) for m in ball_masks((distance + 1) // 2)])
    balls = distinct.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")
    )
    met = balls.groupBy("variant").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    if distance % 2:
        pairs = met.select("fps", F.posexplode("fps").alias("i", "a")).select(
            "a", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("b")
        )
    else:  # an even ball joins every two of its members, so the smallest one links them all
        pairs = met.select(F.col("fps")[0].alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    roots = components(pairs.distinct())
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def _grouped(docs: DataFrame, id_col: str, text_col: str, distance: int) -> DataFrame:
    """(id, hash, fp, first) per row: ``first`` names the group's first row by (no_id, id, hash of the text)."""
    bounded_batches(docs.sparkSession)
    text = F.col(text_col)
    one = saved(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), fingerprints(text).alias("fp")), "fingerprints")
    least = one.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash")).alias("least"))
    groups = saved(fingerprint_components(one, distance).join(least, "fp"), "groups")
    smallest = saved(groups.groupBy("root").agg(F.min("least").alias("first")), "smallest")
    return one.join(saved(groups.select("fp", "root").join(smallest, "root").select("fp", "first"), "named"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits) and the smallest id of its component."""
    return _grouped(docs, id_col, text_col, distance).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id")
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2) -> DataFrame:
    """The first row of each group, with all columns of ``docs``; of rows equal in id and text that with the smallest hash of
    all columns."""
    first = saved(_grouped(docs, id_col, text_col, distance).select("first.*").distinct().select(F.col("id").alias("__id"), F.col("hash").alias("__of")), "first")
    plain = [F.sort_array(F.map_entries(c)) if kind.startswith("map") else F.col(c) for c, kind in docs.dtypes]
    keyed = docs.select(F.col(id_col).alias("__key"), F.xxhash64(text_col).alias("__hash"), F.xxhash64(*plain).alias("__whole"), F.struct(*docs.columns).alias("__row"))
    met = keyed.join(first, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__of")))
    return met.groupBy("__key", "__hash").agg(F.min_by("__row", "__whole").alias("row")).select("row.*")


@query("op9_simhash")
def _simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
