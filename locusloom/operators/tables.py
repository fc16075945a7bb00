"""Document collections as tables: upsert, patch, delete, look-up, paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.functions.running import numbered, top_k


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """Newest row per key of both tables."""
    return top_k(existing.unionByName(incoming), keys, [v for v in version], 1)


def patch(table: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Overwrite the non-null ``fields`` of ``changes`` (one row per key)."""
    new = changes.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    keep = [F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns]
    return table.join(new, key, "left").select(*keep)


def patch_outcome(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """(key, outcome) per change: updated or not found."""
    known = table.select(key).distinct().withColumn("__hit", F.lit(1))
    outcome = F.when(F.col("__hit") == 1, "updated").otherwise("not found")
    return changes.select(key).join(known, key, "left").select(key, outcome.alias("outcome"))


def delete_owned(table: DataFrame, requests: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows left after deleting the requested (key, owner) pairs."""
    return table.join(requests.select(key, owner).distinct(), [key, owner], "left_anti")


def delete_outcome(table: DataFrame, requests: DataFrame, key: str, owner: str) -> DataFrame:
    """Exact per-request outcome of a bulk delete."""
    known = table.select(key, owner).distinct().withColumn("__hit", F.lit(True))
    joined = requests.select(key, owner).distinct().join(known, [key, owner], "left")
    return joined.select(
        key, owner, F.when(F.col("__hit"), "deleted").otherwise("failed").alias("outcome"),
        F.when(F.col("__hit").isNull(), "Not found or not authorized").alias("reason"),
    )


def replace_keys(table: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop all rows of the keys in ``fresh``, then append ``fresh``."""
    touched = fresh.select(*keys).distinct()
    return table.join(touched, list(keys), "left_anti").unionByName(fresh)


def missing_requests(requests: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests without a stored result: the only ones worth computing."""
    return requests.join(results.select(*keys).distinct(), list(keys), "left_anti")


def latest_snapshot(history: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Newest stored value per key; the history itself is append-only."""
    return history.groupBy(key).agg(F.max_by(value, ts).alias(value))


def look_up(requests: DataFrame, table: DataFrame, key_columns: Sequence[str]) -> DataFrame:
    """Rows matching a request on the keys it fills in.

    Requests are split by which keys they fill, so every part is a plain equi-join; a
    request with no key at all matches nothing.
    """
    keys = list(key_columns)
    parts = []
    for mask in range(1, 2 ** len(keys)):
        used = [k for i, k in enumerate(keys) if mask >> i & 1]
        want = requests
        for k in keys:
            want = want.filter(F.col(k).isNotNull() if k in used else F.col(k).isNull())
        parts.append(want.select("request_id", *used).join(table, used).select("request_id", *table.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paged(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], row: Column, name: str, page_rows: int = 1000) -> DataFrame:
    """Nest rows as arrays of at most ``page_rows`` per (keys, page), in ``order``."""
    ranked = numbered(df, keys, bucket, order, "__k").withColumn("page", F.floor((F.col("__k") - 1) / page_rows).cast("long"))
    packed = ranked.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(F.struct("__k", row.alias("__r")))).alias("__a"))
    return packed.select(*keys, "page", F.transform("__a", lambda x: x["__r"]).alias(name))


COMPLETE_FIELDS = ("enrich_id", "go_id", "summary", "graph")


def hypothesis_status(latest_state: Column) -> Column:
    """completed when all parts are there, failed on a failed last update, else pending."""
    done = F.lit(True)
    for f in COMPLETE_FIELDS:
        done = done & F.col(f).isNotNull()
    return F.when(done, "completed").when(latest_state == "failed", "failed").otherwise("pending")
