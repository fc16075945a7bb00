"""Running totals and ranks that never sort a whole group in one task.

A plain ``partitionBy(key).orderBy(x)`` window hands every row of a key to one task.
Here each key is cut into ordered buckets: the window runs inside (key, bucket), and a
second window over the per-bucket totals, which are few, supplies the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET, _OFFSET, _LOCAL, _TOTAL = "__bucket", "__offset", "__local", "__total"


def p_value_bucket(p: Column, per_unit: int = 1000) -> Column:
    """Ordered bucket of a p-value: linear above 1e-3, logarithmic below, 0 = smallest."""
    tail = 3000
    small = F.greatest(F.lit(0), F.lit(tail) - F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * 10))
    return F.when(p < 1e-3, small).otherwise(F.lit(tail + 1) + F.floor(p * per_unit)).cast("long")


def unit_bucket(x: Column, buckets: int = 1024) -> Column:
    """Ordered bucket of a value in [0, 1]."""
    return F.least(F.floor(x * buckets), F.lit(buckets)).cast("long")


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    value: Column,
    out: str,
    how: str = "sum",
    exclusive: bool = False,
    descending: bool = False,
) -> DataFrame:
    """Add ``out`` = running sum/max/min of ``value`` along ``order`` within ``keys``.

    ``bucket`` must be monotone in the order (falling when ``descending``). With
    ``exclusive`` the current row is left out; an empty frame gives 0 for sums, else null.
    """
    agg, combine = {
        "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
        "max": (F.max, F.greatest),
        "min": (F.min, F.least),
    }[how]
    keys = list(keys)
    base = df.withColumn(_BUCKET, bucket)
    bucket_order = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    before = Window.partitionBy(*keys).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        base.groupBy(*keys, _BUCKET).agg(agg(value).alias(_TOTAL))
        .withColumn(_OFFSET, agg(_TOTAL).over(before)).drop(_TOTAL)
    )
    inside = (
        Window.partitionBy(*keys, _BUCKET).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )
    return (
        base.withColumn(_LOCAL, agg(value).over(inside))
        .join(offsets, [*keys, _BUCKET])
        .withColumn(out, combine(F.col(_OFFSET), F.col(_LOCAL)))
        .drop(_BUCKET, _OFFSET, _LOCAL)
    )


def numbered(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], out: str,
    descending: bool = False,
) -> DataFrame:
    """Add the 1-based row number along a total ``order`` within ``keys``."""
    return running(df, keys, bucket, order, F.lit(1), out, descending=descending)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each key. Spark cuts each map task to ``k`` rows per key first."""
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def shuffled(df: DataFrame) -> DataFrame:
    """A join side that must not be broadcast: its estimate comes from a small compressed file and does not count the copies
    that an ``explode`` makes, so the planner would build it whole in the driver."""
    return df.hint("merge")


def spread(df: DataFrame, *keys: str, times: int = 8) -> DataFrame:
    """Rows by hash of ``keys`` in ``times`` the session's shuffle partitions: for rows that multiply after the shuffle, whose
    tasks would else be cut by the size before. A given number is not merged by adaptive execution."""
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def paged(df: DataFrame, keys: Sequence[str], items: Sequence[str], out: str, size: int = 1000) -> DataFrame:
    """The rows of ``keys`` as arrays ``out`` of some ``size`` structs of ``items``: one row that meets a page stands for
    ``size`` rows that meet one item each. Which page an item is on follows from its values."""
    pages = F.ceil(F.count("*").over(Window.partitionBy(*keys)) / size)
    dealt = df.select(*keys, *items).withColumn("__page", F.pmod(F.xxhash64(*items), pages))
    return dealt.groupBy(*keys, "__page").agg(F.collect_list(F.struct(*items)).alias(out)).drop("__page")


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", salt: int = 8) -> DataFrame:
    """Equi-join whose hot keys are spread over ``salt`` tasks; ``small`` is copied per slot."""
    flat = [c for c, kind in big.dtypes if not kind.startswith(("array", "map", "struct", "binary"))]
    spread = flat if set(flat) - set(on) else big.columns  # long vectors are hashed only where nothing else differs
    left = big.withColumn("__slot", F.pmod(F.xxhash64(*spread), F.lit(salt)).cast("int"))
    right = small.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return left.join(shuffled(right), [*on, "__slot"], how).drop("__slot")
