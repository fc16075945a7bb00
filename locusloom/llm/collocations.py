"""Phrase collocations by weighted acyclic automata.

Shards of the texts become count transducers (see ``automaton``): the sorted phrases of a shard, each with its count, cut into
sections by range of the path's code. Sections of one range are united and their weights summed, then paths below ``least``
go. This runs once for single words, once for pairs and once for triples; as a phrase never occurs more often than its
parts, a shard skips phrases with a part that is not in a bit set of the frequent paths of the length before. The bit set
has a fixed size; a path that it holds by chance is counted and dropped like any other.

The parts of a candidate lie in other ranges: every range sends the distinct parts it needs as a transducer, with the
largest count of a longer phrase around each part, to the parts' ranges; there it is composed with the counts, and the
answers go back. A phrase is scored by its weakest cut, a * a / (l * r), in whole numbers.

The code of a path is a 64-bit mix of its language and all its words, so a word or pair that stands in a third of all
phrases is dealt to all ranges; a shard sends a phrase once, a range asks for a part once. The number of ranges follows
the size of the texts.

Defined results: null texts count as empty, a null language is ``und``; only A-Z is lower-cased; blanks other than space
and tab stay in words; repeated rows count; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusloom.llm.automaton import DEPTH, Transducer, folded, forest, gathered, mixed, numbered_words, packed, path_place, union, unpacked, words
from locusloom.llm.common import bounded_batches, release, saved
from locusloom.llm.registry import query, table

SHARD, RANGE = 16 << 20, 8 << 20
BITS = 25  # a bit set of 4 MB
_SALT = 16
_CUT = 0xFF  # no byte of UTF-8: a cut between pieces
_FOLD = bytearray(range(256))
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c + 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _FOLD[_c] = _CUT
_FOLD = bytes(_FOLD)
_ROW = pa.schema([("range", pa.int64()), ("lang", pa.string()), ("kind", pa.int32()), ("source", pa.int64()), ("blob", pa.binary())])
_ROW_SQL = "range long, lang string, kind int, source long, blob binary"
_SCORED = pa.schema([("lang", pa.string()), ("phrase", pa.string())] + [(c, pa.int64()) for c in ("words", "a", "l", "r", "score")])


def tokens(data: bytes, limit: int) -> tuple[pa.BinaryArray, np.ndarray, int]:
    """(words, piece of each word, words that start before byte ``limit``) of folded text."""
    raw = np.frombuffer(data, np.uint8)
    cut = raw == _CUT
    word = ~(cut | (raw == 0x20) | (raw == 0x09))
    edge = np.flatnonzero(np.diff(np.r_[False, word, False].view(np.int8)))
    start, end = edge[::2], edge[1::2]
    piece = np.searchsorted(np.flatnonzero(cut), start)
    return words(end - start, raw[word]), piece, int(np.searchsorted(start, limit))


def blocks(data: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """Folded text in blocks of about ``size`` bytes: (block with the words that its last phrases run into, its own bytes)."""
    at = 0
    blank = (0x20, 0x09, _CUT)
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] not in blank:
            end += 1
        more = end
        for _ in range(DEPTH - 1):
            while more < len(data) and data[more] in blank:
                more += 1
            while more < len(data) and data[more] not in blank:
                more += 1
        yield data[at:more], end - at
        at = end


def codes(lang: str, labels: pa.BinaryArray, paths: np.ndarray) -> np.ndarray:
    """64-bit code of every path."""
    digest = np.array([xxhash.xxh3_64_intdigest(w) for w in labels.to_pylist()] + [1], np.uint64)
    code = np.full(len(paths), xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")), np.uint64)
    with np.errstate(over="ignore"):
        for d in range(DEPTH):
            code = mixed(code * np.uint64(3) + digest[paths[:, d]])
    return code


def deal(lang: str, labels: pa.BinaryArray, paths: np.ndarray, parts: int) -> np.ndarray:
    """Range of every path: the place of its code among ``parts`` equal intervals."""
    code = codes(lang, labels, paths)
    return ((code >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def places(code: np.ndarray, words_: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the 64-bit word, bit in it) of codes in a bit set of ``words_`` words, a power of two."""
    bit = code & np.uint64(64 * words_ - 1)
    return (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))


def runs(number: np.ndarray, piece: np.ndarray, k: int) -> np.ndarray:
    """All phrases of ``k`` words as paths, -1 in the first column where the words are not of one piece."""
    n = max(len(number) - k + 1, 0)
    paths = np.full((n, DEPTH), -1, np.int32)
    for d in range(k):
        paths[:, d] = number[d : d + n]
    paths[piece[:n] != piece[k - 1 : k - 1 + n], 0] = -1
    return paths


def counted(lang: str, data: bytes, limit: int, k: int, frequent: np.ndarray | None = None) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """(words, distinct paths in order, counts) of the phrases of ``k`` words that start in the first ``limit`` bytes and whose
    parts of one word less are all in the bit set ``frequent``."""
    found, piece, own = tokens(data, limit)
    labels, number = numbered_words(found)
    paths = runs(number, piece, k)
    good = (paths[:, 0] >= 0) & (np.arange(len(paths)) < own)
    if k > 1 and frequent is not None:
        word, bit = places(codes(lang, labels, runs(number, piece, k - 1)), len(frequent))
        known = (frequent[word] & bit) != 0
        good &= known[: len(paths)] & known[1 : len(paths) + 1]
    paths = paths[good]
    if len(labels) < (1 << 21) - 1:
        key, counts = np.unique(packed(paths), return_counts=True)
        return labels, unpacked(key), counts
    return labels, *folded(paths, np.ones(len(paths), np.int64), len(labels))


def sections(lang: str, labels: pa.BinaryArray, paths: np.ndarray, weights: np.ndarray, parts: int, kind: int, source: int) -> Iterator[tuple]:
    """Rows (range, lang, kind, source, transducer) of the paths, which are in order."""
    place = deal(lang, labels, paths, parts)
    order = np.argsort(place.astype(np.uint16) if parts < 65536 else place, kind="stable")
    targets, tree = np.unique(place[order], return_inverse=True)
    made = forest(labels, paths[order], weights[order], tree, len(targets))
    for target, part in zip(targets.tolist(), made, strict=True):
        yield target, lang, kind, source, part.dumps()


def _batches(rows: Iterator[tuple], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROW, strict=True)], schema=_ROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ROW, strict=True)], schema=_ROW)


def shards(docs: DataFrame, parts: int, k: int, frequent: np.ndarray | None) -> DataFrame:
    """Sections of the count transducers of all phrases of ``k`` words; ``docs``: lang, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, size = defaultdict(list), 0

            def flush() -> Iterator[tuple]:
                for lang in sorted(held):
                    data = bytes([_CUT]).join(held.pop(lang))
                    for block, own in blocks(data, SHARD):
                        yield from sections(lang, *counted(lang, block, own, k, frequent), parts, 0, -1)

            for batch in batches:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if text:
                        held["und" if lang is None else lang].append(text.translate(_FOLD))
                        size += len(text)
                        if size >= SHARD:
                            yield from flush()
                            size = 0
            yield from flush()

        yield from _batches(rows())
        release()

    return docs.mapInArrow(count, _ROW_SQL)


def bit_set(counts: DataFrame) -> np.ndarray:
    """The codes of all paths as a bit set; its size is fixed, so it may reach the driver and every task."""
    size = 1 << (BITS - 6)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = Transducer.loads(row["blob"])
                word, bit = places(codes(row["lang"], held.labels, held.paths()[0]), size)
                order = np.argsort(word, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(word[order]) != 0]) if len(word) else np.zeros(0, np.int64)
                both = np.bitwise_or.reduceat(bit[order], first) if len(word) else bit
                yield pa.RecordBatch.from_arrays([pa.array(word[order][first]), pa.array(both.view(np.int64))], ["word", "bits"])

    out = np.zeros(size, np.uint64)
    found = counts.mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def united(rows: DataFrame, least: int) -> DataFrame:
    """(range, lang, kind, source, blob): per range and language the summed transducer of phrases that occur ``least`` times
    or more; ``source`` carries the number of word occurrences of the range."""

    def unite(group: pa.Table) -> pa.Table:
        out = []
        for lang, blobs in _by_language(group).items():
            labels, paths, counts = union([Transducer.loads(b) for _, _, b in blobs])
            n = int(counts[paths[:, 1] < 0].sum())
            keep = counts >= least
            out.append((group["range"][0].as_py(), lang, 0, n, Transducer.build(labels, paths[keep], counts[keep]).dumps()))
        release()
        return pa.Table.from_batches(_batches(iter(out)), _ROW)

    return rows.groupBy("range").applyInArrow(unite, _ROW_SQL)


def _by_language(group: pa.Table) -> dict[str, list[tuple[int, int, bytes]]]:
    out = defaultdict(list)
    for row in group.select(["lang", "kind", "source", "blob"]).to_pylist():
        out[row["lang"]].append((row["kind"], row["source"], row["blob"]))
    return out


def cuts(paths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """First and second part of every path cut after one word, two words, ...; rows of single words only where too short."""
    out = []
    for k in range(1, DEPTH):
        first, rest = np.full_like(paths, -1), np.full_like(paths, -1)
        first[:, :k], rest[:, : DEPTH - k] = paths[:, :k], paths[:, k:]
        out.append((first, rest))
    return out


def asked(counts: DataFrame, parts: int) -> DataFrame:
    """Transducers of the parts that each range's candidates need, sent to the parts' ranges; a part's weight is 1 + the
    largest count of a longer candidate around it."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row in batch.to_pylist():
                    held = Transducer.loads(row["blob"])
                    paths, a = held.paths()
                    several = paths[:, 1] >= 0
                    paths, a = paths[several], a[several]
                    if not len(paths):
                        continue
                    need, weight = [], []
                    for first, rest in cuts(paths):
                        there = rest[:, 0] >= 0
                        for part in (first[there], rest[there]):
                            need.append(part)
                            weight.append(1 + np.where(part[:, 1] >= 0, a[there], 0))
                    need, weight = folded(np.concatenate(need), np.concatenate(weight), len(held.labels), np.maximum)
                    yield from sections(row["lang"], held.labels, need, weight, parts, 1, row["range"])

        yield from _batches(rows())
        release()

    return counts.mapInArrow(ask, _ROW_SQL)


def answered(rows: DataFrame, absorb: int) -> DataFrame:
    """Counts of the parts, back to the ranges that asked (kind 2), and the pairs that a longer phrase absorbs (kind 3)."""

    def answer(group: pa.Table) -> pa.Table:
        out, here = [], group["range"][0].as_py()
        for lang, found in _by_language(group).items():
            held = [Transducer.loads(b) for kind, _, b in found if kind == 0]
            asks = [(s, Transducer.loads(b)) for kind, s, b in found if kind == 1]
            if not held or not asks:
                continue
            labels, paths, longer, of = gathered([part for _, part in asks])
            a = Transducer.build(*union(held)).compose(labels, paths)
            order = np.lexsort((path_place(paths, len(labels)), of))
            for (source, _), part in zip(asks, forest(labels, paths[order], a[order], of[order], len(asks)), strict=True):
                out.append((source, lang, 2, here, part.dumps()))
            paths, both = folded(paths, np.stack([longer, a], axis=1), len(labels), np.maximum)
            longer, a = both.T
            gone = (paths[:, 1] >= 0) & (100 * (longer - 1) >= absorb * a)
            if gone.any():
                out.append((here, lang, 3, here, Transducer.build(labels, paths[gone], longer[gone]).dumps()))
        release()
        return pa.Table.from_batches(_batches(iter(out)), _ROW)

    return rows.groupBy("range").applyInArrow(answer, _ROW_SQL)


def weakest(a: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], scale: int = 1_000_000) -> tuple[np.ndarray, ...]:
    """(l, r, score) of the cut with the lowest floor(scale * a * a / (l * r)), the first of equals; l = 0 is no cut."""
    most = max([int(x.max(initial=0)) for pair in sides for x in pair] + [int(a.max(initial=0))])
    kind = np.int64 if scale * most * most < 2**62 else object
    best = None
    for l, r in sides:
        there = l > 0
        product = (l.astype(kind) * r.astype(kind)) if kind is np.int64 else l.astype(object) * r.astype(object)
        score = np.where(there, scale * a.astype(kind) * a.astype(kind) // np.where(there, product, 1), -1)
        if best is None:
            best = [l, r, score]
        else:
            lower = there & (score < best[2])
            best = [np.where(lower, new, old) for new, old in zip((l, r, score), best, strict=True)]
    return best[0], best[1], best[2].astype(np.int64)


def scored(rows: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the candidates that no longer phrase absorbs."""

    def score(group: pa.Table) -> pa.Table:
        out = []
        for lang, found in _by_language(group).items():
            held = [Transducer.loads(b) for kind, _, b in found if kind == 0]
            if not held:
                continue
            labels, paths, a = union(held)
            keep = paths[:, 1] >= 0
            absorbed = [Transducer.loads(b) for kind, _, b in found if kind == 3]
            if absorbed:
                keep &= absorbed[0].compose(labels, paths) == 0
            paths, a = paths[keep], a[keep]
            if not len(paths):
                continue
            answers = Transducer.build(*union([Transducer.loads(b) for kind, _, b in found if kind == 2], np.maximum))  # a part may be asked for twice
            sides = []
            for first, rest in cuts(paths):
                there = rest[:, 0] >= 0
                sides.append(tuple(np.where(there, answers.compose(labels, part), 0) for part in (first, rest)))
            l, r, value = weakest(a, sides)
            text = labels.to_pylist()
            phrase = [b" ".join(text[i] for i in path if i >= 0).decode("utf-8", "surrogatepass") for path in paths.tolist()]
            out.append(pa.Table.from_arrays(
                [pa.array([lang] * len(a), pa.string()), pa.array(phrase, pa.string()), pa.array((paths >= 0).sum(axis=1), pa.int64()),
                 *[pa.array(x.astype(np.int64)) for x in (a, l, r, value)]], schema=_SCORED))
        release()
        return pa.concat_tables(out) if out else _SCORED.empty_table()

    kinds = "lang string, phrase string, words long, a long, l long, r long, score long"
    return rows.groupBy("range").applyInArrow(score, kinds)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, absorb: int = 50) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of every phrase of 2 or 3 words that occurs ``least`` times or more and is not
    inside a longer one that occurs at least ``absorb`` % as often."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // RANGE))
    levels, frequent = [], None
    for k in range(1, DEPTH + 1):
        levels.append(saved(united(shards(texts, parts, k, frequent), max(least, 1)), "counts"))
        frequent = bit_set(levels[-1]) if k < DEPTH else None
    counts = reduce(DataFrame.unionByName, levels)
    total = saved(levels[0].groupBy("lang").agg(F.sum("source").alias("n")), "words")
    answers = answered(counts.unionByName(asked(counts, parts)), absorb)
    found = scored(counts.unionByName(answers))
    return found.join(total, "lang").select("lang", "phrase", "words", "a", "l", "r", "n", "score")


def best(found: DataFrame, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language by score, count and phrase, with their rank."""
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    salted = found.withColumn("__slot", F.pmod(F.xxhash64("phrase"), F.lit(_SALT)))
    part = Window.partitionBy("lang", "__slot").orderBy(*order)
    first = salted.withColumn("__place", F.row_number().over(part)).filter(F.col("__place") <= top).drop("__place", "__slot")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top)


_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
listed as (select lang, row_number() over () as id, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
placed as (select lang, id, unnest(w) as w1, generate_subscripts(w, 1) as i from listed),
followed as (
    select lang, w1, lead(w1) over (partition by id order by i) as w2, lead(w1, 2) over (partition by id order by i) as w3 from placed),
grams as (
    select lang, 1 as k, w1 as phrase from followed
    union all select lang, 2, w1 || ' ' || w2 from followed where w2 is not null
    union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from followed where w3 is not null),
f as (select lang, k, phrase, count(*) as f from grams group by all),
n as (select lang, sum(f) as n from f where k = 1 group by lang),
candidates as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k >= 2 and f >= 10),
cuts as (
    select c.lang, c.phrase, c.k, c.a, cut, array_to_string(w[1:cut], ' ') as left_part, array_to_string(w[cut + 1:], ' ') as right_part
    from candidates c, (values (1), (2)) as places(cut) where cut < c.k),
measured as (
    select c.*, x.f as l, y.f as r, (1000000::hugeint * a::hugeint * a::hugeint) // (x.f::hugeint * y.f::hugeint) as score
    from cuts c join f x on x.lang = c.lang and x.phrase = left_part and x.k = c.cut
    join f y on y.lang = c.lang and y.phrase = right_part and y.k = c.k - c.cut),
chosen as (select * from (select *, row_number() over (partition by lang, phrase order by score, cut) as pick from measured) where pick = 1),
around as (
    select lang, part, max(a) as longer from (
        select lang, a, array_to_string(w[1:2], ' ') as part from candidates where k = 3
        union all select lang, a, array_to_string(w[2:3], ' ') from candidates where k = 3) group by lang, part),
kept as (
    select c.* from chosen c left join around r on r.lang = c.lang and r.part = c.phrase
    where r.longer is null or c.k = 3 or 100 * r.longer < 50 * c.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r,
    cast(n as bigint) as n, cast(score as bigint) as score
from ranked join n using (lang) where rank <= 2000"""


@query("op12_collocations", _SQL)
def _collocations(spark, sf_dir):
    found = best(collocations(table(spark, sf_dir, "documents", "lang", "text")))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
