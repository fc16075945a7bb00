"""Fuzzy line deduplication across documents by MinHash.

Lines (split at ``\\n``, trimmed of blanks) that are equal are one line. Distinct lines of at least ``SHINGLE`` characters
get a MinHash signature of their character shingles, cut into ``BANDS`` bands of ``ROWS`` values; lines that share a band
are candidates, candidates are verified by the exact Jaccard similarity of their shingle sets, and a distributed
union-find joins what is similar. Of each component the first occurrence (smallest document, then line) stays.

Every two lines of a band meet, in two steps. First every batch links its own lines of a band to the first of them and
forwards that one only, and the shuffle links what arrives to the first again, under one of two orders by turns; that joins
most copies without comparing every two. Then the lines of each band that are not in one component by now are cut into
blocks of about ``GROUP`` lines or ``GROUP_BYTES`` characters, every two blocks meet in a cell of their own, and all pairs of
different components in it are compared. Work grows with the square of a band's lines only where they are unlike.
Exact repeats never enter a band twice. Texts of candidates are fetched through a bit set of fixed size and met by joins.

Defined results: null and empty texts have no line and stay as they are; blank lines always stay; lines shorter than a
shingle fall only to equal ones; rows equal in id and text count as one document and come out alike; a null id sorts
first; an empty table gives an empty table; other columns are kept as they are,
but given columns called ``n_lines`` or ``n_kept`` give way to the operator's counts (the pipeline keeps the given ones).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusloom.functions.running import salted_join
from locusloom.llm.common import bounded_batches, components, release, saved
from locusloom.llm.registry import query, table

SHINGLE, SIMILAR, BANDS, ROWS = 8, 0.8, 12, 4
BITS = 1 << 24
GROUP, GROUP_BYTES = 256, 1 << 18
_BLANK, _BLOCK, _WIDE = " \t\r", 1 << 15, 4096
_MULTIPLIERS = np.random.default_rng(11).integers(1 << 31, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_keys(lines: pa.Array) -> np.ndarray:
    """The same 64-bit hash that ``F.xxhash64`` gives."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, 42) for x in lines.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)


def batch_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct trimmed lines that are not blank, and their keys."""
    lines = pc.unique(pc.utf8_trim(pc.split_pattern(pc.drop_null(texts), "\n").flatten(), _BLANK))
    lines = lines.filter(pc.not_equal(lines, ""))
    return lines, line_keys(lines)


def signatures(lines: list[str]) -> np.ndarray:
    """BANDS * ROWS MinHash values (rows) of each line (columns); a line has SHINGLE characters or more."""
    sizes = np.array([len(x) for x in lines]) - SHINGLE + 1
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    whole = codes[: len(codes) - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        whole *= np.uint32(0x01000193)
        whole ^= codes[i : len(codes) - SHINGLE + 1 + i]
    whole ^= whole >> np.uint32(15)
    whole *= np.uint32(0x85EBCA6B)
    whole ^= whole >> np.uint32(13)
    starts = np.cumsum(sizes + SHINGLE - 1) - (sizes + SHINGLE - 1)
    inside = np.ones(len(whole), bool)
    for i in range(SHINGLE - 1):  # windows that would reach into the next line
        inside[starts[1:] - 1 - i] = False
    whole = whole[inside]
    heads = np.cumsum(sizes) - sizes
    out = np.empty((BANDS * ROWS, len(lines)), np.uint32)
    first = 0
    while first < len(lines):
        last = max(first + 1, int(np.searchsorted(heads, heads[first] + _BLOCK, side="right")) - 1)
        part = whole[heads[first] : heads[last] if last < len(lines) else len(whole)]
        buffer, cuts = np.empty_like(part), heads[first:last] - heads[first]
        for row, multiplier in enumerate(_MULTIPLIERS):
            np.multiply(part, multiplier, out=buffer)
            out[row, first:last] = np.minimum.reduceat(buffer, cuts)
        first = last
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    """One 64-bit number for each band (rows) and line (columns)."""
    out = np.empty((BANDS, signature.shape[1]), np.uint64)
    for band in range(BANDS):
        total = np.full(signature.shape[1], band + 1, np.uint64)
        for row in signature[band * ROWS : (band + 1) * ROWS]:
            total = (total ^ row) * _MIX
            total ^= total >> np.uint64(29)
        out[band] = total
    out = (out & ~np.uint64(1)) | (np.arange(BANDS, dtype=np.uint64)[:, None] & np.uint64(1))  # the last bit names the order
    return out.view(np.int64)


def _order(band: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Lines of a band go by their key, or by its complement in every second band."""
    return np.where(band & 1, ~key, key)


def star(band: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by band, the start of each band among them, and the key of its first line in the band's order."""
    order = np.argsort(band)
    band = band[order]
    head = np.flatnonzero(np.diff(band, prepend=band[0] - 1) != 0)
    return order, head, _order(band[head], np.minimum.reduceat(_order(band, key[order]), head))


def several(batches: Iterator[pa.RecordBatch], size: int = 6 << 20) -> Iterator[pa.Array]:
    """The first columns of some batches together, of about ``size`` bytes: repeats among more lines leave at once."""
    held: list[pa.Array] = []
    for batch in batches:
        held.append(batch.column(0))
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_arrays(held)
            held = []
    if held:
        yield pa.concat_arrays(held)


def candidates(docs: DataFrame) -> DataFrame:
    """(a, b): pairs of line keys to verify."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in several(batches):
            lines, keys = batch_lines(texts)
            long = pc.greater_equal(pc.utf8_length(lines), SHINGLE).to_numpy(zero_copy_only=False)
            if not long.any():
                continue
            band = bands_of(signatures(lines.filter(pa.array(long)).to_pylist())).ravel()
            key = np.tile(keys[long], BANDS)
            order, head, first = star(band, key)
            each = np.repeat(first, np.diff(head, append=len(order)))
            same = each != key[order]
            # forwarded rows (band, first line, null), and links found here (the link's own number, line, first line)
            a, b = key[order][same], each[same]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([band[order[head]], a ^ b])), pa.array(np.concatenate([first, a])),
                pa.array(np.concatenate([np.zeros(len(head), np.int64), b]), mask=np.arange(len(head) + len(a)) < len(head)),
            ], ["band", "a", "b"])
        release()

    proposed = docs.select("text").mapInArrow(propose, "band long, a long, b long")
    odd = F.col("band").bitwiseAND(F.lit(1)) == 1
    first = F.min(F.when(odd, F.bitwise_not("a")).otherwise(F.col("a"))).over(Window.partitionBy("band"))
    met = proposed.repartition("band").withColumn("first", first).select(
        "a", F.coalesce("b", F.when(odd, F.bitwise_not("first")).otherwise(F.col("first"))).alias("b")
    ).filter("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, line) of the wanted keys. A bit set of fixed size keeps most other lines from being shuffled."""
    spark = docs.sparkSession
    bits = np.zeros(BITS // 8, np.uint8)
    words = keys.select(F.pmod("key", F.lit(BITS)).alias("bit")).select(
        F.expr("bit div 64").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("mask")
    ).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    got = words.toPandas()  # at most BITS / 64 rows
    bits.view("<i8")[got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, key = batch_lines(batch.column(0))
            at = np.mod(key, BITS)
            keep = pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(key).filter(keep), lines.filter(keep)], ["key", "line"])
        release()

    found = docs.select("text").mapInArrow(pick, "key long, line string")
    return found.join(keys, "key", "left_semi").groupBy("key").agg(F.min("line").alias("line"))


def shingles(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each line as sorted numbers: equal ones are equal shingles, among these lines."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) for x in lines])
    if len(codes) < SHINGLE:
        return [np.empty(0, np.uint64) for _ in lines]
    top = int(codes.max())
    if top > 255:  # only the characters that occur get a number
        used = np.zeros(top + 1, bool)
        used[codes] = True
        codes, top = (np.cumsum(used) - 1)[codes], int(used.sum()) - 1
    if top <= 255:  # eight characters of a byte each are one number
        whole = np.ndarray(len(codes) - SHINGLE + 1, np.uint64, codes.astype(np.uint8), 0, (1,)).copy()
    else:  # pieces of one, two and four characters meet in one number, and are numbered when that has too few bits
        whole, bits, step = codes.astype(np.uint64), top.bit_length(), 1
        while step < SHINGLE:
            if 2 * bits > 64:
                whole = np.unique(whole, return_inverse=True)[1].astype(np.uint64)
                bits = len(whole).bit_length()
            whole = whole[:-step] << np.uint64(bits) | whole[step:]
            bits, step = 2 * bits, 2 * step
    out = []
    for end, line in zip(ends.tolist(), lines, strict=True):
        part = np.sort(whole[end - len(line) : max(end - SHINGLE + 1, end - len(line))])
        out.append(part[np.append(True, part[1:] != part[:-1])] if len(part) else part)
    return out


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Number of shingles in both."""
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have Jaccard similarity SIMILAR or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a = batch.column(0).to_numpy()
            head = np.flatnonzero(np.diff(a, prepend=a[0] - 1) != 0)  # a line that comes in several rows on end is read once
            sets = shingles(batch.column(2).take(pa.array(head)).to_pylist() + batch.column(3).to_pylist())
            of = np.repeat(np.arange(len(head)), np.diff(head, append=len(a))).tolist()
            keep = []
            for x, y in zip((sets[i] for i in of), sets[len(head) :], strict=True):
                alike = min(len(x), len(y)) >= SIMILAR * max(len(x), len(y))
                both = common(x, y) if alike else 0
                keep.append(alike and both >= SIMILAR * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
        release()

    met = pairs.join(lines.select(F.col("key").alias("b"), F.col("line").alias("y")), "b").join(
        lines.select(F.col("key").alias("a"), F.col("line").alias("x")), "a")
    return met.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets. Shingles of one line alone are left out, they are in none."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token)
    row, token = row[order], token[order]
    new, last = np.ones((2, len(token)), bool)
    new[1:] = token[1:] != token[:-1]
    last[:-1] = new[1:]
    often = ~(new & last)
    row, token = row[often], np.cumsum(new[often]) - 1
    out = np.zeros((len(sets), len(sets)))
    all_ = int(token[-1]) + 1 if len(token) else 0
    for low in range(0, all_, _WIDE):
        wide = min(_WIDE, all_ - low)
        a, b = np.searchsorted(token, [low, low + wide])
        part = np.zeros((len(sets), wide), np.float32)
        part[row[a:b], token[a:b] - low] = 1
        out += part @ part.T
    return out


def similar_roots(lines: list[str], roots: np.ndarray, sides: np.ndarray, one_block: bool) -> np.ndarray:
    """Pairs (columns) of different roots with similar lines, of every two lines or of those on different sides."""
    i, j = np.triu_indices(len(lines), 1)
    meet = (roots[i] != roots[j]) & (one_block | (sides[i] != sides[j]))
    i, j = i[meet], j[meet]
    if not len(i):
        return np.empty((2, 0), roots.dtype)
    sets = shingles(lines)
    size = np.array([len(s) for s in sets], np.int64)
    meet = np.minimum(size[i], size[j]) >= SIMILAR * np.maximum(size[i], size[j])
    i, j = i[meet], j[meet]
    if len(i) > 2 * len(sets):
        both = _overlaps(sets)[i, j]
    else:
        both = np.array([common(sets[x], sets[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], float)
    alike = both >= SIMILAR * (size[i] + size[j] - both)
    a, b = roots[i[alike]], roots[j[alike]]
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)


def rest(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): pairs of components to join, from comparing all lines of a band that are in different ones."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                text = batch.column(2)
                columns = [np.tile(c, BANDS) for c in (batch.column(0), batch.column(1), pc.utf8_length(text).cast(pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bands_of(signatures(text.to_pylist())).ravel()), *map(pa.array, columns)], ["band", "key", "root", "size"]
                )
        release()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            cell = pa.Table.from_batches(held)
            a, b = similar_roots(
                cell["line"].to_pylist(), cell["root"].to_numpy(), cell["side"].to_numpy(), cell["i"][0].as_py() == cell["j"][0].as_py()
            )
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            cell = np.stack([batch.column(c).to_numpy() for c in range(3)])
            starts = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if held and any(held[0].column(c)[0].as_py() != cell[c, a] for c in range(3)):
                    yield from done()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()
        release()

    known = lines.filter(F.length("line") >= SHINGLE).join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "line")
    members = saved(known.mapInArrow(spread, "band long, key long, root long, size long"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("size") / GROUP_BYTES))
    # of two lines the first step has compared both
    mixed = members.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), blocks.alias("blocks"))
    mixed = saved(mixed.filter("n > 2 and low <> high").select("band", "blocks"), "mixed")
    asked = salted_join(members.drop("size"), mixed, ["band"]).join(lines, "key")
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    cells = asked.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"), "root", "line"
    )
    return cells.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(compare, "a long, b long").distinct()


def grouped(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, root) of the candidate lines that are similar to another."""
    roots = saved(components(saved(verified(pairs, lines), "similar")).withColumnRenamed("node", "key"), "near")
    links = saved(rest(lines, roots), "rest")
    if links.isEmpty():
        return roots
    up = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    all_ = lines.select("key").join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"))
    return salted_join(all_, up, ["root"], "left").select("key", F.coalesce("top", "root").alias("root"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text`` cut to its kept lines, and ``n_lines`` and ``n_kept``."""
    bounded_batches(docs.sparkSession, 10_000)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null and text <> ''")
    pairs = saved(candidates(given), "candidates")
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    lines = saved(texts_of(given, saved(keys, "keys")), "lines")
    roots = grouped(lines, pairs)
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANK)))
    places = given.select("id", F.xxhash64("text").alias("hash"), F.posexplode(trimmed).alias("place", "line")).filter("line <> ''")
    places = places.select("id", "hash", "place", F.xxhash64("line").alias("key")).join(roots, "key", "left").select(
        "id", "hash", "place", F.coalesce("root", "key").alias("root")
    )
    places = saved(places, "places")
    spot = F.struct("id", "hash", "place")
    several = saved(places.groupBy("root").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).filter("first <> last").select("root", "first"), "several")
    dropped = places.join(several, "root").filter(F.col("first") != spot).groupBy("id", "hash").agg(
        F.sort_array(F.collect_set("place")).alias("dropped")
    )
    cut = saved(dropped.select(F.col("id").alias("__id"), F.col("hash").alias("__of"), F.col("dropped").alias("__dropped")), "dropped")
    bounded_batches(docs.sparkSession)  # what follows has no Python step
    text, gone = F.col(text_col), F.col("__dropped")
    lines_of = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), gone)  # by a hash set, so linear
    left = F.element_at(F.transform(F.array(lines_of), lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n")), 1)  # split once
    some = F.coalesce(text, F.lit("")) != ""
    joined = docs.withColumn("__hash", F.xxhash64(text_col)).join(
        cut, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__of")), "left"
    )
    return joined.select(
        *[F.col(c) for c in docs.columns if c not in (text_col, "n_lines", "n_kept")],
        F.when(gone.isNull(), text).otherwise(left).alias(text_col),
        F.when(some, F.size(lines_of)).otherwise(0).cast("long").alias("n_lines"),
        F.when(some, F.size(lines_of) - F.coalesce(F.size(gone), F.lit(0))).otherwise(0).cast("long").alias("n_kept"),
    )


@query("op8_line_dedup")
def _line_dedup(spark, sf_dir):
    cut = deduplicate(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_kept", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
