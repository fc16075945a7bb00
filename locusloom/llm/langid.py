"""Language spans: script ranges narrow the candidates of a word, character n-grams score it, Viterbi joins words.

A word is a run of letters. Hashed n-grams of its lower-cased letters with word edges (n = 1 to 4) give each language a
log-likelihood; languages that do not use the word's script are out, unless none uses it. Viterbi over a document's
words, with ``SWITCH`` nats per change of language, labels spans of mixed-language text. Documents of a batch advance
together, one word per step.

The model is fitted on at most about ``FIT_ROWS`` documents per language, chosen by hash of the id; its size is
languages x ``BUCKETS`` numbers.

Defined results: null and empty texts and texts without a letter have no span and the language ``und`` with score 0;
without a labelled row everything is ``und``; rows with a null label or null text are not learned from; repeated rows
and null ids keep their own row, and a null id is never learned from; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import bounded_batches, release
from locusloom.llm.registry import query, table

BUCKETS, SWITCH, FIT_ROWS, SLICE_CHARS = 1 << 16, 8.0, 4000, 400_000
SPANS = "array<struct<start:int,end:int,lang:string,words:int,letters:int>>"
_OUT = -1e6
_USED = 0.01  # a language uses a script that has this share of its letters
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)

# First and last code point of the letter ranges told apart; letters elsewhere share the last number.
_RANGES = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)], "tamil": [(0xB80, 0xBFF)], "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0xAC00, 0xD7AF), (0x1100, 0x11FF)],
}
SCRIPTS = len(_RANGES) + 2


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: script number (0: no letter), and the code point in lower case."""
    script, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    number = np.full(0x110000, SCRIPTS - 1, np.uint8)
    for i, ranges in enumerate(_RANGES.values()):
        for first, last in ranges:
            number[first : last + 1] = i + 1
    for c in range(0x20, 0x32400):  # no letter lies beyond
        if unicodedata.category(chr(c))[0] == "L":
            script[c] = number[c]
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
    return script, lower


@dataclass
class Words:
    """Words of some texts put end to end: place, length and script of each, and per place one bucket of each n."""

    start: np.ndarray
    script: np.ndarray
    text: np.ndarray
    position: np.ndarray
    letters: np.ndarray
    grams: list[np.ndarray]  # BUCKETS where no n-gram starts


def words_of(texts: list[str]) -> Words:
    script_of, lower_of = _letters()
    joined = "\n" + "\n".join(texts) + "\n\n\n\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    script = script_of[codes]
    letter = script > 0
    low = lower_of[codes]
    low *= letter
    start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    owner = np.searchsorted(begins, start, side="right") - 1
    grams, total, inside = [], low, letter
    for n in range(1, 5):
        # a window starts at a letter or at the edge before one; inside it are letters only
        if n > 1:
            total = total[:-1] * np.uint32(_MULTIPLIERS[n - 1]) + low[n - 1 :]
            inside = letter[:-1] | letter[1:] if n == 2 else inside[:-1] & letter[n - 2 : -1]
        mixed = total * np.uint32(_MULTIPLIERS[0]) + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(_MULTIPLIERS[1])
        mixed >>= np.uint32(16)
        mixed[~inside] = BUCKETS
        grams.append(mixed)
    return Words(start, script[start], owner, start - begins[owner], end - start, grams)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS + 1 x languages, zeros in the last row
    uses: np.ndarray  # SCRIPTS x languages


def _word_scores(words: Words, model: Model) -> np.ndarray:
    """Log-likelihood of every word (rows) in every language."""
    if not len(words.start):
        return np.zeros((0, len(model.langs)), np.float32)
    size = len(words.grams[-1])
    total = model.table[words.grams[0][:size]]
    for bucket in words.grams[1:]:
        total += model.table[bucket[:size]]
    scores = np.add.reduceat(total, words.start - 1, axis=0)
    return np.where(model.uses[words.script], scores, np.float32(_OUT))


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each row of ``scores``, whose rows are sequences of ``sizes`` rows put end to end."""
    label = np.zeros(len(scores), np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    alive = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")  # sequences longer than t
    back = np.zeros(scores.shape, np.int16)
    best = np.zeros((len(order), scores.shape[1]))
    every = np.arange(scores.shape[1])
    for t, k in enumerate(alive):
        row = starts[:k] + t
        if t:
            now = best[:k]
            top = now.argmax(axis=1)
            jump = now[np.arange(k), top] - switch
            stay = now >= jump[:, None]
            back[row] = np.where(stay, every, top[:, None])
            best[:k] = np.where(stay, now, jump[:, None])
        best[:k] += scores[row]
    state = best.argmax(axis=1)
    for t in range(len(alive) - 1, -1, -1):
        row = starts[: alive[t]] + t
        label[row] = state[: alive[t]]
        state[: alive[t]] = back[row, state[: alive[t]]]
    return label


def _pieces(text: str) -> Iterator[str]:
    """``text`` cut between words into pieces of about SLICE_CHARS."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        cut = at + SLICE_CHARS
        while cut < len(text) and text[cut - 1].isalpha():
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def spans_of(texts: list[str], model: Model) -> list[list[dict]]:
    """Labelled spans of each text; places are code points."""
    pieces = [(i, p) for i, t in enumerate(texts) for p in _pieces(t)]
    kept, at = [], 0
    while at < len(pieces):  # pieces scored together hold about SLICE_CHARS
        last, chars = at, 0
        while last < len(pieces) and (last == at or chars + len(pieces[last][1]) <= SLICE_CHARS):
            chars += len(pieces[last][1])
            last += 1
        words = words_of([p for _, p in pieces[at:last]])
        kept.append((words.text + at, words.position, words.letters, _word_scores(words, model)))
        at = last
    piece, position, letters, scores = (np.concatenate(x) for x in zip(*kept, strict=True))
    owner = np.array([i for i, _ in pieces])
    lengths = np.array([len(p) for _, p in pieces], np.int64)
    before = np.cumsum(lengths) - lengths
    heads = before[np.searchsorted(owner, np.arange(len(texts)))]
    text = owner[piece]
    position = position + before[piece] - heads[text]
    label = viterbi(scores, np.bincount(text, minlength=len(texts)))
    out: list[list[dict]] = [[] for _ in texts]
    cuts = [*np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0)).tolist(), len(text)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[text[a]].append({
            "start": int(position[a]), "end": int(position[b - 1] + letters[b - 1]), "lang": model.langs[label[a]],
            "words": b - a, "letters": int(letters[a:b].sum()),
        })
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", draw: Column | None = None, rows: int = FIT_ROWS) -> Model:
    """Model of the languages of ``docs`` from about ``rows`` documents each; ``draw``: long that picks them."""
    spark = docs.sparkSession
    bounded_batches(spark)
    given = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (draw if draw is not None else F.xxhash64(text_col)).alias("draw"))
    given = given.filter("text is not null and lang is not null")
    shares = {r.lang: min(1.0, rows / r.n) for r in given.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(shares)
    if not langs:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros((SCRIPTS, 0), bool))
    part = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
    sample = given.filter(F.pmod("draw", F.lit(1_000_000)) < part * 1_000_000).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(langs), BUCKETS + SCRIPTS), np.int64)
        for batch in batches:
            by = batch.to_pandas().groupby("lang")["text"]
            for lang, texts in by:
                for text in ("\n".join(texts[i : i + 100]) for i in range(0, len(texts), 100)):
                    for piece in _pieces(text):
                        words = words_of([piece])
                        row = found[langs.index(lang)]
                        for bucket in words.grams:
                            row[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS + 1)[:BUCKETS]
                        row[BUCKETS:] += np.bincount(words.script, words.letters, SCRIPTS).astype(np.int64)
        lang, bucket = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(found[lang, bucket])], ["lang", "bucket", "n"])
        release()

    counted = sample.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    full = np.zeros((len(langs), BUCKETS + SCRIPTS))
    full[counted.lang, counted.bucket] = counted.n
    grams, script = full[:, :BUCKETS], full[:, BUCKETS:]
    logs = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    uses = script / np.maximum(script.sum(axis=1, keepdims=True), 1) >= _USED
    uses[:, ~uses.any(axis=0)] = True
    logs = np.concatenate([logs, np.zeros((len(langs), 1))], axis=1)
    return Model(langs, np.ascontiguousarray(logs.T, np.float32), np.ascontiguousarray(uses.T))


def label_spans(text: Column, model: Model, spark) -> Column:
    """Column of labelled spans of ``text``."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    @F.pandas_udf(SPANS)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch) or not shared.value.langs:
                yield pd.Series([[] for _ in batch], dtype=object)
                continue
            yield pd.Series(spans_of(["" if x is None else x for x in batch], shared.value), dtype=object)
        release()

    return label.asNondeterministic()(text)  # else a filter on the result would run it a second time


def dominant(spans: Column) -> Column:
    """struct(lang, score): the language with most letters and its share of them; ``und`` and 0 without a span."""
    letters = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["letters"])
    per = F.transform(F.array_distinct(F.transform(spans, lambda s: s["lang"])), lambda lang: F.struct(
        F.aggregate(F.filter(spans, lambda s: s["lang"] == lang), F.lit(0).cast("long"), lambda a, s: a + s["letters"]).alias("letters"),
        lang.alias("lang"),
    ))
    best = F.array_max(per)
    return F.struct(F.coalesce(best["lang"], F.lit("und")).alias("lang"), F.coalesce(best["letters"] / letters, F.lit(0.0)).alias("score"))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out, null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def identify(docs: DataFrame) -> DataFrame:
    """Adds ``spans`` and ``found`` = struct(lang, score) to ``docs`` (doc_id, text, lang), learning outside fold 0."""
    model = fit(docs.filter(fold() != 0), draw=F.xxhash64("doc_id"))
    return docs.withColumn("spans", label_spans(F.col("text"), model, docs.sparkSession)).withColumn("found", dominant(F.col("spans")))


@query("op2_language_id")
def _language_id(spark, sf_dir):
    found = identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return found.select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"), F.size("spans").alias("n_spans"),
    )
