"""Packing tokenised documents into sequences by bounded-space online best fit.

A partition keeps at most ``OPEN`` windows. Whole windows of a long document leave at once; the rest goes to the fullest
window that holds it. If none does and no more may be opened, the fullest leaves: padded when its gap is at most
``SLACK``, else filled with the head of the piece. At its end a partition joins its open windows to full ones and keeps
one remainder; remainders are merged ``FAN`` partitions at a time until one is left, which alone is padded at will.

A task holds one batch and ``OPEN`` windows, a merge ``FAN`` windows. Sequence ids come from partition numbers and
counters, so a repeated task gives the same rows.

Defined results: a null text is an empty one, whose only token is the end id; repeated rows and null ids are packed like
others; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import bounded_batches, release, saved
from locusloom.llm.registry import query, table

LENGTH, OPEN, SLACK, FAN, END_ID = 2048, 64, 16, 64, 1
PIECES = "start long, doc_tokens long, ids binary, sequence_id long, offset long, part long, open boolean"
_JOINED = 10_000
_ROUND, _PART = 58, 28  # bit positions of the merge round and the partition in a sequence id

# White space that a cut at single spaces could tear apart: next to a space, or not ASCII.
_UNSAFE = r"  |\s (\s|$)|[\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: visible Latin-1 ones for themselves, the
    others for 256, 257, ... in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of whole texts for a byte-level BPE vocabulary file whose ids are its merge ranks.

    A space between two other characters always starts a token, so a text's ids are those of its space-led words: the
    distinct words of a batch are encoded joined, and cut apart by the byte lengths of their tokens. Texts with other
    white space around spaces, and texts that hold an added token of the file, are encoded whole by the tokenizer of the
    file itself, as it comes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        special = {str(t.content) for t in self._tokenizer.get_added_tokens_decoder().values()}
        self._added = sorted(special)
        byte, vocab = _byte_of(), self._tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
        self._fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self._bytes[list(ranks.values())] = list(map(len, ranks))

    def ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every space-led word, end to end, and how many each has; no word is empty or starts with a space."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), _JOINED):
            some = words.slice(at, _JOINED)
            got = np.array(self._fast.encode_ordinary(" " + " ".join(some.to_pylist())), np.uint32)
            ends = np.cumsum(pc.binary_length(some).to_numpy() + 1)
            counts.append(np.diff(np.searchsorted(np.cumsum(self._bytes[got]), ends) + 1, prepend=0))
            ids.append(got)
        return np.concatenate(ids), np.concatenate(counts)

    def _units(self, words: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``lead`` + word, end to end, and (start, count) of each word's."""
        plain = pc.match_substring_regex(words, r"^[^\s]") if lead else pa.array([False] * len(words), pa.bool_())
        ids, counts = self._joined(words.filter(plain))
        rest = [self._fast.encode_ordinary(lead + w) for w in words.filter(pc.invert(plain)).to_pylist()]
        mask = plain.to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(mask), np.flatnonzero(~mask)])
        counts = np.concatenate([counts, np.fromiter(map(len, rest), np.int64, len(rest))])
        at = np.zeros((2, len(words)), np.int64)
        at[:, order] = np.cumsum(counts) - counts, counts
        return np.concatenate([ids, *(np.array(x, np.uint32) for x in rest)]), at

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids (uint32) of each text, in order."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _UNSAFE)
        for added in self._added:
            whole = pc.or_(whole, pc.match_substring(texts, added))
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        words = split.flatten()
        later, first = words.dictionary_encode(), words.take(pa.array(offsets[:-1])).dictionary_encode()
        codes = later.indices.to_numpy().astype(np.int64)
        codes[offsets[:-1]] = first.indices.to_numpy().astype(np.int64) + len(later.dictionary)
        flat, at = self._units(later.dictionary, " ")
        more, at_more = self._units(first.dictionary, "")
        starts, sizes = np.concatenate([at, at_more + [[len(flat)], [0]]], axis=1)
        flat = np.concatenate([flat, more])
        counts = sizes[codes]
        ends = np.cumsum(counts)
        ids = flat[np.repeat(starts[codes] - (ends - counts), counts) + np.arange(counts.sum())]
        cuts = np.concatenate([[0], ends[offsets[1:] - 1]])
        for i, odd in enumerate(whole.to_pylist()):
            yield self.ids(texts[i].as_py()) if odd else ids[cuts[i] : cuts[i + 1]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Windows:
    """The open windows of one partition. A piece is (id, start, document's tokens, packed ids)."""

    def __init__(self, base: int, length: int = LENGTH, most: int = OPEN, slack: int = SLACK):
        self.base, self.length, self.most, self.slack = base, length, most, slack
        self.open: list[tuple[int, int, list[tuple]]] = []  # (free, number, pieces), fullest first
        self.opened, self.left, self.out = 0, 0, []

    def _leave(self, pieces: list[tuple], unfinished: bool = False) -> None:
        at = 0
        for id_, start, tokens, ids in pieces:
            self.out.append((id_, start, tokens, ids, self.base + self.left, at, unfinished))
            at += len(ids) // 4
        self.left += 1

    def add(self, piece: tuple) -> None:
        id_, start, tokens, ids = piece
        ids = memoryview(ids)  # cut without copying the rest
        while len(ids):
            need = len(ids) // 4
            if need >= self.length:
                head, ids = bytes(ids[: 4 * self.length]), ids[4 * self.length :]
                self._leave([(id_, start, tokens, head)])
                start += self.length
                continue
            at = bisect_left(self.open, (need, -1, []))
            if at == len(self.open) < self.most:
                self.opened += 1
                insort(self.open, (self.length - need, self.opened, [(id_, start, tokens, bytes(ids))]))
                return
            if at == len(self.open):  # none fits: the fullest leaves
                free, _, pieces = self.open.pop(0)
                if free > self.slack:
                    pieces.append((id_, start, tokens, bytes(ids[: 4 * free])))
                    ids, start = ids[4 * free :], start + free
                self._leave(pieces)
                continue
            free, number, pieces = self.open.pop(at)
            pieces.append((id_, start, tokens, bytes(ids)))
            if free == need:
                self._leave(pieces)
            else:
                insort(self.open, (free - need, number, pieces))
            return

    def close(self) -> None:
        """Join the open windows, fullest first, to full ones; the remainder leaves marked unfinished."""
        now, used = [], 0
        for _, _, pieces in self.open:
            for id_, start, tokens, ids in pieces:
                while ids:
                    take = min(len(ids) // 4, self.length - used)
                    now.append((id_, start, tokens, ids[: 4 * take]))
                    ids, start, used = ids[4 * take :], start + take, used + take
                    if used == self.length:
                        self._leave(now)
                        now, used = [], 0
        if now:
            self._leave(now, True)
        self.open = []

    def take(self, schema: pa.Schema, part: int) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * 7
        self.out = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, schema.field(i).type) for i, c in enumerate([*columns[:6], [part] * len(columns[0]), columns[6]])], schema=schema
        )


def _schema(id_type: pa.DataType) -> pa.Schema:
    long = pa.int64()
    return pa.schema([("id", id_type), ("start", long), ("doc_tokens", long), ("ids", pa.binary()), ("sequence_id", long),
                      ("offset", long), ("part", long), ("open", pa.bool_())])


def _merger(level: int, whole: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Joins the remainders of up to FAN partitions."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        windows = Windows((level << _ROUND) + (group << _PART))
        for row in rows.sort_values(["part", "offset"]).itertuples(index=False):
            windows.add((None if pd.isna(row.id) else row.id, row.start, row.doc_tokens, row.ids))
        windows.close()
        names = ["id", "start", "doc_tokens", "ids", "sequence_id", "offset", "part", "open"]
        out = pd.DataFrame([(*p[:6], group, p[6]) for p in windows.out], columns=names)
        return out.astype({"id": "Int64"}) if whole else out

    return merge


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Pieces: id, start, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        windows, schema = Windows(part << _PART), None
        for batch in batches:
            schema = schema or _schema(batch.schema.field(0).type)
            for id_, ids in zip(batch.column(0).to_pylist(), encoder(path).batch(batch.column(1)), strict=True):
                windows.add((id_, 0, len(ids) + 1, ids.tobytes() + END_ID.to_bytes(4, "little")))
            yield windows.take(schema, part)
        if schema:
            windows.close()
            yield windows.take(schema, part)
        release()

    first = saved(given.mapInArrow(run, f"id {kind}, {PIECES}"), "pieces")
    done = [first.filter("not open")]
    rest = first.filter("open")
    level = 0
    while (last := rest.agg(F.max("part")).first()[0]) is not None and (last > 0 or level == 0):
        level += 1

        merged = saved(
            rest.withColumn("group", F.floor(F.col("part") / FAN)).groupBy("group").applyInPandas(
                _merger(level, kind in ("bigint", "int")), f"id {kind}, {PIECES}"),
            "merged",
        )
        done.append(merged.filter("not open"))
        rest = merged.filter("open")
    out = rest
    for part in done:
        out = out.union(part)
    return out.select(F.col("id").alias(id_col), "start", "doc_tokens", "ids", "sequence_id", "offset")


def digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return pieces.select(
        id_col, "start", F.floor(F.octet_length("ids") / 4).alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


@query("op3_packing")
def _packing(spark, sf_dir):
    return digest(pack(table(spark, sf_dir, "documents", "doc_id", "text")))
