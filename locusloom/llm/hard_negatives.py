"""Hard negatives by segment summaries.

Every vector is cut into segments; of each the mean and the deviation (length of what the mean leaves over) are stored. On a
segment of m components two vectors have the product m * mean * mean' give or take deviation * deviation', so summaries
bound a score from both sides. One segment covers the whole vector first; pairs that the bounds leave open are looked at
again with segments of half the length, down to ``SEGMENTS``, and only what is open then is scored exactly.

Rows lie in tiles of about ``TILE`` rows in the order of (dimension, label, mean); anchors in slots of about ``SLOT``. A tile
keeps the bounds of its summaries, so tiles meet only the slots whose windows of scores they can reach. A first pass finds
each anchor's positives, in the tiles that hold its label; the second, for every positive, the best rows of other labels
whose score lies in the window that follows from the positive's score. Bounds rise with the best rows found so far.

Work within a slot and a tile grows with their product, so all work grows with rows times anchors where summaries do not
separate them; no group is ever larger than one tile.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of
another dimension never meet; a row never meets rows of its own id; repeated rows are rows each, a repeated anchor answers
for each of its rows; products beyond 64 bits are cut to the largest long; an anchor without positives, and a positive
without negatives, gives no row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.llm.common import bounded_batches, release, saved
from locusloom.llm.registry import query, table
from locusloom.llm.topk import products
from locusloom.llm.vectors import usable

SEGMENTS, TILE, SLOT, BLOCK, STRIP, CELLS = 8, 8192, 4096, 2048, 256, 32
MOST_TASKS = 10_000
_LOOSE = 1e-3  # summaries travel as 32-bit numbers: bounds widen by its square times both lengths
_HUGE = 1e30  # from this length on summaries bound nothing
_DENSE = 0.05
_LOW, _HIGH = -(2**63), 2**63 - 1
_ROWS = "vec_id long, label long, dim long, mean double, size double, vec binary, means binary, devs binary"
_BLOBS = ("ids", "labels", "sizes", "vecs", "means", "devs")
_TILES = (
    "tile long, dim long, kind string, least_label long, most_label long, held array<long>, mean_low array<double>, "
    "mean_high array<double>, dev_high array<double>, size_high double, " + ", ".join(f"{b} binary" for b in _BLOBS)
)
_FOUND = pa.schema([("slot", pa.int64())] + [(c, pa.int64()) for c in ("place", "part", "anchor_id", "vec_id", "score")])


def edges(dim: int) -> np.ndarray:
    """Borders of the finest segments, a power of two of them."""
    count = 1
    while count * 2 <= min(SEGMENTS, dim):
        count *= 2
    return np.linspace(0, dim, count + 1).astype(np.int64)


def summaries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every finest segment, deviations rounded up."""
    border = edges(rows.shape[1])
    means, devs = [], []
    for a, b in zip(border[:-1], border[1:], strict=True):
        part = rows[:, a:b]
        mean = part.mean(axis=1)
        off = part - mean[:, None]
        top = np.abs(off).max(axis=1, initial=0)
        safe = np.where(top > 0, top, 1.0)
        means.append(mean)
        devs.append(top * np.sqrt(((off / safe[:, None]) ** 2).sum(axis=1)))
    limit = np.finfo(np.float32).max
    means, devs = np.clip(np.stack(means, 1), -limit, limit), np.clip(np.stack(devs, 1), 0, limit)
    return means.astype("<f4"), np.nextafter(devs.astype("<f4"), np.float32(np.inf)).astype("<f4")


def hierarchy(means: np.ndarray, devs: np.ndarray, dim: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(means, deviations, lengths) with one segment, two, four, ... up to the stored ones."""
    lengths = np.diff(edges(dim)).astype(float)
    levels = [(means.astype(float), devs.astype(float), lengths)]
    while len(levels[-1][2]) > 1:
        mean, dev, size = levels[-1]
        a, b = slice(0, None, 2), slice(1, None, 2)
        both = size[a] + size[b]
        mid = (mean[:, a] * size[a] + mean[:, b] * size[b]) / both
        energy = dev[:, a] ** 2 + dev[:, b] ** 2 + size[a] * mean[:, a] ** 2 + size[b] * mean[:, b] ** 2
        rest = np.maximum(energy - both * mid**2, 0) + _LOOSE**2 * energy  # what rounding may hide
        levels.append((mid, np.sqrt(rest), both))
    return levels[::-1]


class Tile:
    """Rows of one dimension with their summaries."""

    def __init__(self, row: dict, end: str):
        get = lambda name, kind: np.frombuffer(row[f"{name}_{end}"], kind)
        dim = row["dim"]
        self.ids, self.labels, self.sizes = get("ids", "<i8"), get("labels", "<i8"), get("sizes", "<f8")
        self.loose = np.where(self.sizes < _HUGE, _LOOSE * np.maximum(self.sizes, 1.0), np.inf)
        self.vecs = get("vecs", row[f"kind_{end}"]).reshape(len(self.ids), dim).astype(float)
        count = len(edges(dim)) - 1
        self.levels = hierarchy(get("means", "<f4").reshape(-1, count), get("devs", "<f4").reshape(-1, count), dim)

    def block(self, a: int, b: int) -> Tile:
        part = object.__new__(Tile)
        part.ids, part.labels, part.sizes, part.loose, part.vecs = (x[a:b] for x in (self.ids, self.labels, self.sizes, self.loose, self.vecs))
        part.levels = [(m[a:b], d[a:b], n) for m, d, n in self.levels]
        return part


def reachable(anchors: Tile, rows: Tile, need: np.ndarray, cap: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """``open_`` without the pairs whose score lies below ``need`` or above ``cap`` by the bounds of some level."""
    for (mean_a, dev_a, size), (mean_b, dev_b, _) in zip(anchors.levels, rows.levels, strict=True):
        a, b = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if not len(a):
            break
        with np.errstate(over="ignore", invalid="ignore"):
            middle = (mean_a[a] * size) @ mean_b[b].T
            spread = np.c_[dev_a[a], anchors.loose[a]] @ np.c_[dev_b[b], rows.loose[b]].T + 0.5
            out = (middle + spread < need[a, None]) | (middle - spread > cap[a, None])
        open_[np.ix_(a, b)] &= ~out
    return open_


def scores(anchors: Tile, rows: Tile, open_: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact score) of the open pairs."""
    i, j = np.nonzero(open_)
    if most < 2.0**53 and len(i) < _DENSE * open_.size:
        return i, j, np.einsum("nd,nd->n", anchors.vecs[i], rows.vecs[j]).astype(np.int64)
    return i, j, products(anchors.vecs, rows.vecs, most)[i, j]


def search(anchors: Tile, rows: Tile, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> dict[tuple[int, int], list]:
    """(anchor, window) -> its k best (-score, id) among rows of the same label, or of other labels; ``low``, ``high``:
    borders of each anchor's windows, a window without a whole number in it is empty."""
    best: dict[tuple[int, int], list] = {}
    filled = low <= high
    need = np.where(filled, low, _HIGH).astype(np.int64)
    cap = np.where(filled, high, _LOW).max(axis=1)
    for at in range(0, len(rows.ids), BLOCK):
        part = rows.block(at, at + BLOCK)
        for first in range(0, len(anchors.ids), STRIP):
            own = anchors.block(first, first + STRIP)
            mine = slice(first, first + STRIP)
            open_ = ((own.labels[:, None] == part.labels) == same) & (own.ids[:, None] != part.ids) & filled[mine].any(axis=1)[:, None]
            open_ = reachable(own, part, need[mine].min(axis=1).astype(float), cap[mine].astype(float), open_)
            if not open_.any():
                continue
            i, j, score = scores(own, part, open_, own.sizes.max() * part.sizes.max())
            good = score >= need[mine].min(axis=1)[i]
            i, j, score = i[good], j[good], score[good]
            order = np.lexsort((part.ids[j], ~score, i))  # ~score falls as the score rises, and cannot overflow
            i, ids, score = i[order], part.ids[j][order], score[order]
            starts = np.searchsorted(i, np.arange(len(own.ids) + 1))
            for n in np.flatnonzero(np.diff(starts)):
                mine_scores, mine_ids = score[starts[n] : starts[n + 1]], ids[starts[n] : starts[n + 1]]
                for w in np.flatnonzero(filled[first + n]):
                    begin = int(np.searchsorted(~mine_scores, ~high[first + n, w]))
                    new = [(-int(s), int(v)) for s, v in zip(mine_scores[begin : begin + k], mine_ids[begin : begin + k], strict=True) if s >= low[first + n, w]]
                    if new:
                        key = (first + int(n), int(w))
                        best[key] = sorted(best.get(key, []) + new)[:k]
                        if len(best[key]) == k:
                            need[key] = -best[key][-1][0]
    return best


def whole_numbers(vectors: DataFrame, id_col: str, label: Column, vector_col: str, scale: float) -> DataFrame:
    """Rows of whole numbers floor(scale * x), packed, with their stored summaries."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).filter(usable(F.col("v")) & (F.size("v") > 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            with np.errstate(over="ignore"):
                flat = np.clip(np.floor(scale * lists.values.to_numpy(zero_copy_only=False)), -1e300, 1e300)
            dims = np.diff(offsets)
            out = [[None] * len(dims) for _ in range(5)]
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = flat[offsets[at][:, None] + np.arange(dim)]
                means, devs = summaries(part)
                top = np.maximum(np.abs(part).max(axis=1), 1.0)
                size = top * np.sqrt(((part / top[:, None]) ** 2).sum(axis=1))
                for n, r in enumerate(at.tolist()):
                    for column, value in zip(out, (float(part[n].mean()), float(size[n]), part[n].astype("<f8").tobytes(), means[n].tobytes(), devs[n].tobytes()), strict=True):
                        column[r] = value
            mean, size, *blobs = out
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims), pa.array(mean, pa.float64()), pa.array(size, pa.float64()), *[pa.array(b, pa.binary()) for b in blobs]],
                ["vec_id", "label", "dim", "mean", "size", "vec", "means", "devs"],
            )
        release()

    return rows.mapInArrow(pack, _ROWS)


def tiled(rows: DataFrame, size: int) -> DataFrame:
    """Tiles of at most ``size`` rows of one dimension, in the order of label and mean, with the bounds of their summaries."""
    parts = -(-rows.count() // size) or 1
    order = ("dim", "label", "mean", "vec_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        made = 0
        names = _TILES.replace("array<", "").replace(">", "").split(", ")

        def tile() -> pa.RecordBatch:
            nonlocal made
            dim, made = held[0]["dim"], made + 1
            column = lambda name: [r[name] for r in held]
            vecs = np.frombuffer(b"".join(column("vec")), "<f8")
            kind = "<i2" if np.abs(vecs).max() < 2**15 else "<f8"
            means = np.frombuffer(b"".join(column("means")), "<f4").reshape(len(held), -1).astype(float)
            devs = np.frombuffer(b"".join(column("devs")), "<f4").reshape(len(held), -1).astype(float)
            labels = np.array(column("label"), "<i8")
            values = [
                (TaskContext.get().partitionId() << 32) + made, dim, kind, int(labels.min()), int(labels.max()), np.unique(labels).tolist(),
                means.min(axis=0).tolist(), means.max(axis=0).tolist(), devs.max(axis=0).tolist(), max(column("size")),
                np.array(column("vec_id"), "<i8").tobytes(), labels.tobytes(), np.array(column("size"), "<f8").tobytes(),
                vecs.astype(kind).tobytes(), b"".join(column("means")), b"".join(column("devs")),
            ]
            held.clear()
            kinds = {"held": pa.list_(pa.int64())} | dict.fromkeys(("mean_low", "mean_high", "dev_high"), pa.list_(pa.float64()))
            plain = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
            return pa.RecordBatch.from_arrays(
                [pa.array([v], kinds.get(n.split()[0]) or plain[n.split()[1]]) for v, n in zip(values, names, strict=True)],
                [n.split()[0] for n in names],
            )

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) >= size or row["dim"] != held[0]["dim"]):
                    yield tile()
                held.append(row)
        if held:
            yield tile()
        release()

    return saved(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, _TILES), "tiles")


def _spread(tiles: DataFrame, end: str, name: str, *more: str) -> DataFrame:
    """The tile's data under names that end in ``end``, keyed by ``name``."""
    return tiles.select(F.col("tile").alias(name), F.col("kind").alias(f"kind_{end}"), *[F.col(b).alias(f"{b}_{end}") for b in _BLOBS], *more)


def meet(pairs: DataFrame, slots: DataFrame, tiles: DataFrame, run) -> DataFrame:
    """``run(row)`` over every (slot, tile) pair with the data of both; gives (place, part, anchor_id, vec_id, score) tuples."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                found = [(row["slot"], *x) for x in run(row)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=_FOUND)
        release()

    spread = max(1, min(pairs.count(), MOST_TASKS))  # by tile: a slot meets most tiles, and there are few slots
    joined = pairs.join(slots, "slot").repartition(spread, "tile").join(_spread(tiles, "b", "tile").repartition(spread, "tile"), "tile")
    return joined.mapInArrow(work, "slot long, place long, part long, anchor_id long, vec_id long, score long")


def bound(sign: int) -> Column:
    """Upper (+1) or lower (-1) bound of the scores between slot ``s`` and tile ``t`` from the bounds of their summaries."""
    pick = F.greatest if sign > 0 else F.least
    parts = F.arrays_zip(*[F.col(f"{who}.{c}").alias(f"{who}_{c}") for who in "st" for c in ("mean_low", "mean_high", "dev_high")], F.col("lengths").alias("n"))
    corner = lambda z: pick(*[z[f"s_{a}"] * z[f"t_{b}"] for a in ("mean_low", "mean_high") for b in ("mean_low", "mean_high")])
    total = F.aggregate(parts, F.lit(0.0), lambda acc, z: acc + z["n"] * corner(z) + sign * z["s_dev_high"] * z["t_dev_high"])
    most = F.greatest("s.size_high", F.lit(1.0)) * F.greatest("t.size_high", F.lit(1.0))
    open_ = sign * F.lit(float("inf"))
    return F.when((F.col("s.size_high") < _HUGE) & (F.col("t.size_high") < _HUGE), total + sign * (_LOOSE**2 * most + 1)).otherwise(open_)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row where ``is_anchor`` (a Column
    of ``vec_id``) holds; ``low`` and ``high``: the window of a negative's score in percent of the positive's."""
    bounded_batches(vectors.sparkSession)
    rows = saved(whole_numbers(vectors, id_col, label, vector_col, scale), "rows")
    tiles, slots = tiled(rows, TILE), tiled(rows.filter(is_anchor), SLOT)

    def find_positives(row: dict) -> Iterator[tuple]:
        a, b = Tile(row, "a"), Tile(row, "b")
        shape = (len(a.ids), 1)
        for (n, _), found in search(a, b, np.full(shape, _LOW), np.full(shape, _HIGH), positives, True).items():
            yield from ((n, 0, int(a.ids[n]), v, -s) for s, v in found)

    each = F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell")
    cell = F.pmod(F.xxhash64("tile"), F.lit(CELLS)).cast("int").alias("cell")
    same = saved(slots.select(F.col("tile").alias("slot"), "dim", "held", each).select("slot", "dim", "cell", F.explode("held").alias("label")).join(
        tiles.select("tile", "dim", cell, F.explode("held").alias("label")), ["dim", "cell", "label"]).select("slot", "tile", "dim").distinct(), "pairs")
    near = meet(same, _spread(slots, "a", "slot"), tiles, find_positives)
    rank = F.row_number().over(Window.partitionBy("slot", "place").orderBy(F.desc("score"), "vec_id"))
    near = saved(near.withColumn("part", rank.cast("long")).filter(F.col("part") <= positives), "positives")
    asked = saved(near.groupBy("slot").agg(  # at most SLOT anchors with ``positives`` rows each
        F.collect_list(F.struct("place", "part", "vec_id", "score")).alias("near"),
        (F.min(F.when(F.col("score") >= 0, F.col("score"))) * (low / 100.0) - 1).alias("least"),
        (F.max("score") * (high / 100.0) + 1).alias("most"),
    ), "asked")

    def find_negatives(row: dict) -> Iterator[tuple]:
        a, b = Tile(row, "a"), Tile(row, "b")
        least, most = np.ones((len(a.ids), positives), np.int64), np.zeros((len(a.ids), positives), np.int64)
        for p in row["near"]:
            at = (p["place"], p["part"] - 1)
            least[at], most[at] = -(-low * p["score"] // 100), high * p["score"] // 100
        for (n, w), found in search(a, b, least, most, negatives, False).items():
            yield from ((n, w + 1, int(a.ids[n]), v, -s) for s, v in found)

    brief = ("tile", "dim", "least_label", "most_label", "mean_low", "mean_high", "dev_high", "size_high")
    dims = F.col("dim")
    s = slots.join(asked.withColumnRenamed("slot", "tile"), "tile").select(
        dims, each, F.struct(*brief, "least", "most").alias("s"))
    t = tiles.select(dims, cell, F.struct(*brief).alias("t"))
    count = F.size("s.mean_low")
    border = lambda i: F.floor(i * dims / count)
    lengths = F.transform(F.sequence(F.lit(1), count), lambda i: (border(i) - border(i - 1)).cast("double"))
    alone = (F.col("s.least_label") == F.col("s.most_label")) & (F.col("t.least_label") == F.col("t.most_label")) & (F.col("s.least_label") == F.col("t.least_label"))
    pairs = saved(s.join(t, ["dim", "cell"]).withColumn("lengths", lengths).filter(
        ~alone & F.col("s.least").isNotNull() & (bound(1) >= F.col("s.least")) & (bound(-1) <= F.col("s.most"))
    ).select(F.col("s.tile").alias("slot"), F.col("t.tile").alias("tile"), "dim"), "pairs")
    given = _spread(slots, "a", "slot").join(asked.select("slot", "near"), "slot")
    far = meet(pairs, given, tiles, find_negatives)
    place = F.row_number().over(Window.partitionBy("slot", "place", "part").orderBy(F.desc("score"), "vec_id"))
    ranked = far.withColumn("rank", place).filter(F.col("rank") <= negatives)
    named = near.select("slot", "place", "part", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["slot", "place", "part"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


_SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
p as (
    select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
    from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
near as (
    select anchor_id, other_id as positive_id, score as positive_score
    from (select *, row_number() over (partition by anchor_id order by score desc, other_id) as place from p where same) where place <= 5),
far as (
    select near.*, p.other_id as negative_id, p.score as negative_score,
        row_number() over (partition by near.anchor_id, positive_id order by p.score desc, p.other_id) as rank
    from near join p on p.anchor_id = near.anchor_id and not p.same
        and 50 * positive_score <= 100 * p.score and 100 * p.score <= 95 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from far where rank <= 3"""


@query("op13_hard_negatives", _SQL)
def _hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0, label)
