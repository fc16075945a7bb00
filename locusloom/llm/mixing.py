"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets the rate ``min(cap, exp(k * size / scale))``: of all rates in [0, cap] that give a source its target
words, these are closest to one copy each in relative entropy, and ``k`` is the source's multiplier in the convex dual.
Newton steps on the dual run for all sources at once over a table folded to (source, size, count): a step is one join and
one grouped sum, and bisection replaces a step that leaves the bracket. Rates become whole copies by systematic rounding
along sizes within the source, then copies are moved between sizes until the source's words are as near as a size
allows. Which documents of one (source, size) take the extra copy is decided by hash, so reruns agree.

Rows of one source are never gathered: windows run over distinct sizes of a source, and over slots of few documents of
one (source, size).

Defined results: null text and text without a word have size 0 and take 0; a null source is a source of its own, listed
last; a source without words has target 0; repeated rows and null ids are documents like others; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.functions.columns import text_bucket
from locusloom.functions.running import numbered
from locusloom.llm.common import saved
from locusloom.llm.registry import query, table

_WORDS = r"[^\x20\x09-\x0D]+"
_STEPS, _TOLERANCE = 60, 1e-7
_SLOT_ROWS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Adds ``target`` to (source key, source_size): ``share`` of all words by weight, none above ``cap`` times its size."""
    bucket = text_bucket(F.substring("key", 2, 1 << 30)) + F.when(F.col("key") == "1", 1 << 33).otherwise(0)
    placed = numbered(sources, [], bucket, [F.col("key")], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = saved(placed.select("key", "source_size", weight.alias("weight")), "weights")
    level, full = 0.0, -1
    while True:  # raise the level of the sources below their limit until none is above it
        at_limit = F.col("weight") * level >= cap * F.col("source_size") if full >= 0 else F.lit(False)
        row = weighed.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(at_limit, F.col("source_size"))).alias("held"),
            F.sum(F.when(~at_limit, F.col("weight"))).alias("free"), F.count(F.when(at_limit, 1)).alias("full"),
        ).first()
        if row.full == full or not row.free:
            break
        level, full = (share * (row.words or 0) - cap * (row.held or 0)) / row.free, row.full
    return weighed.select(
        "key", "source_size", F.least(cap * F.col("source_size"), F.col("weight") * F.lit(level)).alias("target")
    )


def multipliers(cells: DataFrame, wanted: DataFrame, cap: float) -> DataFrame:
    """(key, k, scale): the dual solution per source. ``cells``: key, size, n; ``wanted``: key, source_size, target."""
    scale = cells.filter("size > 0").groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = saved(
        wanted.join(scale, "key").filter(F.col("target") < cap * F.col("source_size"))
        .select("key", "target", "scale", F.lit(0.0).alias("k"), F.lit(None).cast("double").alias("low"),
                F.lit(None).cast("double").alias("high"), F.lit(False).alias("done")), "dual",
    )
    for step in range(_STEPS):
        x = F.col("size") / F.col("scale")
        tilt = F.exp(F.least(F.col("k") * x, F.lit(700.0)))
        words = F.col("n") * F.col("size")
        sums = cells.join(state.select("key", "k", "scale"), "key").groupBy("key").agg(
            F.sum(words * F.least(tilt, F.lit(cap))).alias("got"),
            F.sum(F.when(tilt < cap, words * tilt * x).otherwise(0.0)).alias("slope"),
        )
        over = F.col("got") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("k"))
        high = F.when(over, F.col("k")).otherwise(F.col("high"))
        newton = F.col("k") - (F.col("got") - F.col("target")) / F.col("slope")
        moved = state.join(sums, "key").select(
            "key", "target", "scale", "k", low.alias("low"), high.alias("high"),
            (F.abs(F.col("got") - F.col("target")) <= _TOLERANCE * F.greatest("target", F.lit(1.0))).alias("done"),
            F.when(F.col("slope") > 0, newton).alias("newton"),
        )
        inside = (F.col("newton") > F.coalesce("low", F.lit(float("-inf")))) & (F.col("newton") < F.coalesce("high", F.lit(float("inf"))))
        halved = F.when(F.col("low").isNull(), F.least(F.col("high") * 2, F.col("high") - 1)).when(
            F.col("high").isNull(), F.greatest(F.col("low") * 2, F.col("low") + 1)
        ).otherwise((F.col("low") + F.col("high")) / 2)
        next_k = F.when(F.col("done"), F.col("k")).when(
            inside & (F.abs(F.col("newton") - F.col("k")) <= 2 * (1 + F.abs("k"))), F.col("newton")
        ).otherwise(halved)
        state = saved(moved.select("key", "target", "scale", next_k.alias("k"), "low", "high", "done"), "dual")
        if state.filter("not done").isEmpty():
            break
    return state.select("key", "k", "scale")


def whole_copies(cells: DataFrame, wanted: DataFrame, solved: DataFrame, cap: float) -> DataFrame:
    """Adds ``copies`` (of all ``n`` documents of the cell together) to (key, size, n), with source_size and target."""
    rate = F.when(F.col("k").isNull(), F.lit(cap)).otherwise(
        F.least(F.lit(cap), F.exp(F.least(F.col("k") * F.col("size") / F.col("scale"), F.lit(700.0))))
    )
    falling = Window.partitionBy("key").orderBy(F.desc("size"))
    before = falling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("key")
    most = (F.floor(F.lit(cap)) * F.col("n")).cast("long")
    cut = (
        cells.join(wanted, "key").join(solved, "key", "left")
        .withColumn("mass", F.col("n") * rate).withColumn("upto", F.sum("mass").over(falling))
        .withColumn("copies", F.least(most, (
            F.floor(F.col("upto") + 0.5) - F.floor(F.coalesce(F.sum("mass").over(before), F.lit(0.0)) + 0.5)
        ).cast("long")))
    )
    for _ in range(3):  # what rounding left over, from large to small sizes
        gap = F.round("target").cast("long") - F.sum(F.col("copies") * F.col("size")).over(every)
        room = F.when(F.col("gap") > 0, most - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap"))
        cut = (
            cut.withColumn("gap", gap)
            .withColumn("room", F.when(fits, room * F.col("size")).otherwise(0))
            .withColumn("spent", F.coalesce(F.sum("room").over(before), F.lit(0)))
            .withColumn("moves", F.when(fits, F.least(room, F.floor(F.greatest(F.abs("gap") - F.col("spent"), F.lit(0)) / F.col("size")))).otherwise(0))
            .withColumn("copies", F.col("copies") + F.signum(F.col("gap").cast("double")).cast("long") * F.col("moves").cast("long"))
        )
    gap = F.round("target").cast("long") - F.sum(F.col("copies") * F.col("size")).over(every)
    cut = cut.withColumn("gap", gap)  # one more copy, or less, of the size nearest to what is left, if that comes nearer
    free = F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    nearer = free & (F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap"))
    cut = cut.withColumn("off", F.when(nearer, F.abs(F.col("size") - F.abs("gap"))))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("off"), "size"))
    cut = cut.withColumn("place", place)
    moved = F.when((F.col("place") == 1) & F.col("off").isNotNull(), F.signum(F.col("gap").cast("double")).cast("long")).otherwise(0)
    return cut.withColumn("copies", F.col("copies") + moved).select("key", "size", "n", "source_size", "target", "copies")


def mixed_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), also: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, draw (hash of id and text), key of its source, size, source_size, target, copies and the
    columns ``also``."""
    sized = saved(docs.select(
        *also, F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")).alias("key"),
        word_count(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col).alias("draw"),
    ), "sized")
    cells = saved(sized.groupBy("key", "size").agg(F.count("*").alias("n")), "cells")
    sources = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = saved(targets(sources, share, cap, weights), "targets")
    plan = saved(whole_copies(cells, wanted, multipliers(cells, wanted, cap), cap), "copies")
    # a document's place among the n of its (source, size): documents before its slot + its place in the slot
    slots = F.greatest(F.lit(1), F.ceil(F.col("n") / _SLOT_ROWS))
    sized = sized.join(plan.select("key", "size", "n"), ["key", "size"]).withColumn("slot", F.pmod("draw", slots))
    ahead = Window.partitionBy("key", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = sized.groupBy("key", "size", "slot").agg(F.count("*").alias("held"))
    begins = saved(counts.withColumn("begin", F.coalesce(F.sum("held").over(ahead), F.lit(0))).drop("held"), "slots")
    inside = Window.partitionBy("key", "size", "slot").orderBy("draw", "id", *also)
    placed = sized.withColumn("place", F.row_number().over(inside))
    begins = begins.join(plan, ["key", "size"])
    extra = (F.col("begin") + F.col("place") <= F.pmod(F.col("copies"), F.col("n"))).cast("long")
    return placed.drop("n").join(begins, ["key", "size", "slot"]).withColumn(
        "copies", F.floor(F.col("copies") / F.col("n")) + extra
    ).select("id", "draw", "key", "size", "source_size", "target", "copies", *also)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies and taken = copies * size."""
    return mixed_copies(docs, id_col, text_col, source_col, **how).select(
        F.col("id").alias(id_col), F.when(F.col("key").startswith("0"), F.substring("key", 2, 1 << 30)).alias(source_col),
        "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with every row as often as the mix takes it. Rows go by a hash of all their columns, so rows that are equal in
    id and text but not elsewhere stay apart, and what counts as one row is equal in every column."""
    plain = [F.sort_array(F.map_entries(c)) if kind.startswith("map") else F.col(c) for c, kind in docs.dtypes]
    key = ["__key", "__draw", "__whole"]
    named = docs.select("*", F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")).alias("__key"),
                        F.xxhash64(id_col, text_col).alias("__draw"), F.xxhash64(*plain).alias("__whole"))
    copies = mixed_copies(named, id_col, text_col, source_col, also=("__whole",), **how)
    times = copies.groupBy(F.col("key").alias("__key"), F.col("draw").alias("__draw"), "__whole").agg(F.sum("copies").cast("int").alias("__times"))
    taken = named.dropDuplicates(key).join(saved(times.filter("__times > 0"), "times"), key)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


@query("op1_mixing")
def _mixing(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
