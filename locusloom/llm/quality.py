"""Quality classifier: a byte-level convolutional network in numpy.

Text bytes are embedded; learned filters of ``WIDTH`` bytes slide, two bytes a step, over chunks that overlap and cover the
whole document. Each filter keeps its largest response per chunk; a document's features are the mean and the maximum of
its chunks' pooled responses, and a logistic unit makes one probability of them. Since a filter sees one embedded byte
per tap, embedding and filter fold to one table per tap, and a response is a sum of look-ups.

The network is fitted on at most about ``FIT_ROWS`` labelled documents per class, chosen by hash, and up to
``FIT_CHUNKS`` chunks of each; the prior of all labelled rows is put back afterwards. Scoring reads every byte.

Defined results: null and empty texts are one chunk of padding and get that score; without labels of both classes the
score is the share of label 1 (0.5 without labels); labels without a document and null labels are not learned from;
several labels of one document each count, equal ones once; repeated rows and null ids keep their own row; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import bounded_batches, release
from locusloom.llm.registry import query, table

CHUNK, OVERLAP, WIDTH, STRIDE, EMBED, FILTERS = 1024, 128, 8, 2, 8, 24
FIT_ROWS, FIT_CHUNKS, EPOCHS, BATCH, RATE = 1500, 4, 14, 32, 0.01
SLICE_BYTES = 1 << 20


def chunks_of(text: bytes) -> np.ndarray:
    """Overlapping chunks that cover ``text``, in rows of CHUNK bytes; the last one is zero-padded."""
    step = CHUNK - OVERLAP
    rows = max(1, -(-(len(text) - OVERLAP) // step))
    padded = np.zeros(OVERLAP + rows * step, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    weight: np.ndarray  # 2 FILTERS
    offset: np.ndarray  # 1

    def tables(self) -> np.ndarray:
        return np.einsum("be,wef->wbf", self.embed, self.filters).astype(np.float32)

    def responses(self, chunks: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """chunks x places x FILTERS"""
        places = (CHUNK - WIDTH) // STRIDE + 1
        total = tables[0][chunks[:, : places * STRIDE : STRIDE]]
        for tap in range(1, WIDTH):
            total += tables[tap][chunks[:, tap : tap + places * STRIDE : STRIDE]]
        return total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(samples: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on logistic loss. A sample: (chunks, CHUNK) bytes of one document; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)), np.zeros(FILTERS),
        rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1),
    )
    params = [net.embed, net.filters, net.bias, net.weight, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    step, steps = 0, EPOCHS * -(-len(samples) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            sizes = np.array([len(samples[i]) for i in pick])
            chunks = np.concatenate([samples[i] for i in pick])
            doc = np.repeat(np.arange(len(pick)), sizes)
            heads = np.cumsum(sizes) - sizes
            found = net.responses(chunks, net.tables())
            place = found.argmax(axis=1)
            pooled = np.maximum(np.take_along_axis(found, place[:, None], 1)[:, 0] + net.bias, 0)
            mean, top = np.add.reduceat(pooled, heads) / sizes[:, None], np.maximum.reduceat(pooled, heads)
            out = _sigmoid(np.concatenate([mean, top], axis=1) @ net.weight + net.offset)
            delta = (out - labels[pick]) * balance[pick] / len(pick)
            back = delta[:, None] * net.weight[None]
            is_top = pooled == top[doc]
            grad = back[doc, :FILTERS] / sizes[doc, None] + back[doc, FILTERS:] * is_top
            grad *= pooled > 0
            g_embed, g_filters = np.zeros_like(net.embed), np.zeros_like(net.filters)
            column = np.arange(FILTERS)
            for tap in range(WIDTH):
                byte = chunks[np.arange(len(chunks))[:, None], place * STRIDE + tap]
                table_grad = np.zeros((256, FILTERS))
                np.add.at(table_grad, (byte, np.broadcast_to(column, byte.shape)), grad)
                g_filters[tap] = net.embed.T @ table_grad
                g_embed += table_grad @ net.filters[tap].T
            grads = [g_embed, g_filters, grad.sum(axis=0), np.concatenate([mean, top], axis=1).T @ delta, np.array([delta.sum()])]
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def score_texts(texts: list[bytes], net: Network, tables: np.ndarray) -> np.ndarray:
    """Probability of each text; work is sliced, so memory does not grow with a text's length."""
    mean, top = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS))
    count = np.zeros(len(texts))
    waiting, owner = [], []

    def flush() -> None:
        if not waiting:
            return
        chunks, doc = np.concatenate(waiting), np.repeat(owner, [len(w) for w in waiting])
        for at in range(0, len(chunks), 64):
            pooled = np.maximum(net.responses(chunks[at : at + 64], tables).max(axis=1) + net.bias, 0)
            part = doc[at : at + 64]
            np.add.at(mean, part, pooled)
            np.maximum.at(top, part, pooled)
            count[:] += np.bincount(part, minlength=len(texts))
        waiting.clear()
        owner.clear()

    held = 0
    for i, text in enumerate(texts):
        rows = chunks_of(text)
        for at in range(0, len(rows), SLICE_BYTES // CHUNK):
            waiting.append(rows[at : at + SLICE_BYTES // CHUNK])
            owner.append(i)
            held += len(waiting[-1])
            if held >= SLICE_BYTES // CHUNK:
                flush()
                held = 0
    flush()
    features = np.concatenate([mean / np.maximum(count, 1)[:, None], top], axis=1)
    return _sigmoid(features @ net.weight + net.offset)


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Network | float:
    """Network from ``docs`` (doc_id, text) and ``labels`` (doc_id, label), or the share of label 1 where a class is missing.

    Labels are counted and sampled before any text is touched; the sample, about ``rows`` of each class, is broadcast."""
    bounded_batches(docs.sparkSession)
    given = labels.filter("label in (0, 1)").join(docs.select("doc_id"), "doc_id").withColumn("draw", F.xxhash64("doc_id"))
    counts = {r.label: r.n for r in given.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts))) if counts else 0.5
    part = F.when(F.col("label") == 1, rows / counts[1]).otherwise(rows / counts[0])
    sample = given.filter(F.pmod("draw", F.lit(1_000_000)) < part * 1_000_000).distinct()
    sample = docs.join(F.broadcast(sample), "doc_id")

    @F.pandas_udf("array<binary>")
    def picked(texts: pd.Series, draws: pd.Series) -> pd.Series:
        out = []
        for text, draw in zip(texts, draws, strict=True):
            chunks = chunks_of(_encode(text))
            some = np.random.default_rng(abs(int(draw))).permutation(len(chunks))[:FIT_CHUNKS]
            out.append([chunks[i].tobytes() for i in sorted(some)])
        return pd.Series(out, dtype=object)

    got = sample.select("label", "draw", picked("text", "draw").alias("chunks")).toPandas().sort_values(["draw", "label"])
    samples = [np.stack([np.frombuffer(c, np.uint8) for c in row]) for row in got.chunks]
    labels = got.label.to_numpy(float)
    if labels.min(initial=1) == labels.max(initial=0):
        return counts[1] / (counts[0] + counts[1])
    net = train(samples, labels)
    net.offset += np.log(counts[1] / counts[0])  # training weighs both classes the same
    return net


def quality_score(text: Column, net: Network | float, spark) -> Column:
    """Probability of label 1 for a text column."""
    if isinstance(net, float):
        return F.lit(net)
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(net)  # a few thousand numbers

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = shared.value.tables()
        for batch in batches:
            yield pd.Series(score_texts([_encode(x) for x in batch], shared.value, tables))
        release()

    return score(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``score`` to (doc_id, text), learning from ``labels`` (doc_id, quality) outside fold 0."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.filter(fold != 0).select("doc_id", F.col("quality").alias("label"))
    net = fit(docs.select("doc_id", "text"), known)
    return docs.withColumn("score", quality_score(F.col("text"), net, docs.sparkSession)).withColumn(
        "held_out", F.coalesce(fold == 0, F.lit(False))
    )


@query("op6_quality")
def _quality(spark, sf_dir):
    scored = classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
