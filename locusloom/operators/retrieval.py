"""Nearest terms by embedding, pattern look-up in term text, passages and prompts."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.functions.running import salted_join, top_k


def _dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


def squared_l2(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gap, F.lit(0.0), lambda s, v: s + v)


def nearest_terms(requests: DataFrame, terms: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """Top-k terms of each request with a 1-based rank.

    ``requests(request_id, query)`` has one row per request, ``terms(request_id, term_id,
    embedding)`` the terms its enrichment found. The salted join spreads a request with very
    many terms; each task then keeps k rows per request.
    """
    pairs = salted_join(terms, requests, ["request_id"])
    if metric == "cosine":
        score, order = cosine(F.col("query"), F.col("embedding")), F.col("score").desc()
    else:
        score, order = F.sqrt(squared_l2(F.col("query"), F.col("embedding"))), F.col("score").asc()
    scored = pairs.select("request_id", "term_id", score.alias("score"))
    return top_k(scored, ["request_id"], [order, F.col("term_id")], k, "rank")


def term_text(term: Column, desc: Column, sep: str = " [SEP] ") -> Column:
    return F.concat_ws(sep, F.coalesce(term, F.lit("")), F.coalesce(desc, F.lit("")))


CHUNK_BYTES = 4 << 20  # pattern text that one automaton holds


def contains_pairs(texts: DataFrame, patterns: DataFrame, text_id: str, text: str, pattern_id: str, pattern: str) -> DataFrame:
    """(text_id, pattern_id) for every text and pattern row with the pattern inside the text, letter case ignored.

    Patterns are cut into chunks of at most ``CHUNK_BYTES`` of text; a chunk becomes an Aho-Corasick automaton in the
    tasks, which passes over each text once, whatever the number of patterns in it. There are as many passes as chunks.
    Null and empty patterns, and null texts, match nothing.
    """
    pats = patterns.select(F.col(pattern_id).alias("id"), F.lower(pattern).alias("low")).filter(F.length("low") > 0)
    size = pats.agg(F.sum(F.octet_length("low") + 16)).head()[0] or 0
    chunks = max(1, -(-2 * size // CHUNK_BYTES))  # hashed, so chunks of half the size on average
    low = texts.filter(F.col(text).isNotNull()).select(F.col(text_id).alias("text_id"), F.lower(text).alias("text"))
    kinds = f"{text_id} {texts.schema[text_id].dataType.simpleString()}, {pattern_id} {patterns.schema[pattern_id].dataType.simpleString()}"
    found = None
    for chunk in range(chunks):
        mine = pats.filter(F.pmod(F.xxhash64("low"), F.lit(chunks)) == chunk).toArrow()  # of bounded size
        part = low.mapInArrow(_matcher(mine["id"].combine_chunks(), mine["low"].to_pylist(), (text_id, pattern_id)), kinds)
        found = part if found is None else found.unionByName(part)
    return found


def _matcher(ids: pa.Array, patterns: list[str], names: tuple[str, str]):
    """Batches of (text id, text) to pairs of ids; the automaton is built once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, rows = ahocorasick.Automaton(), {}
        for i, p in enumerate(patterns):
            rows.setdefault(p, []).append(i)
        for p, places in rows.items():
            automaton.add_word(p, tuple(places))
        automaton.make_automaton()
        for batch in batches:
            left, right = [], []
            for n, text in enumerate(batch.column(1).to_pylist() if rows else []):
                hits = [i for places in {places for _, places in automaton.iter(text)} for i in places]
                left += [n] * len(hits)
                right += hits
            pairs = [batch.column(0).take(pa.array(left, pa.int64())), ids.take(pa.array(right, pa.int64()))]
            yield pa.RecordBatch.from_arrays(pairs, list(names))

    return run


GRAM_LENGTHS = (8, 4, 2, 1)  # a name is looked up by its first characters, as many of them as the longest of these that fits


def named_terms(names: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of ``table(request_id, low, ...)`` beside ``names(request_id, name)`` of their request whose first characters
    their text holds somewhere, once each: the only ones that can hold the name."""
    def pieces(n: int) -> Column:
        places = F.when(F.length("low") >= n, F.sequence(F.lit(1), F.length("low") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(F.col("low"), i, F.lit(n)))

    start = F.coalesce(*[F.when(F.length("name") >= n, F.substring("name", 1, n)) for n in GRAM_LENGTHS])
    laid = table.withColumn("__gram", F.explode(F.array_distinct(F.concat(*[pieces(n) for n in GRAM_LENGTHS]))))
    return salted_join(laid, names.withColumn("__gram", start), ["request_id", "__gram"]).drop("__gram")


def matched_replies(replies: DataFrame, table: DataFrame) -> DataFrame:
    """(request_id, id, term, rank, reason, genes, p): enrichment rows that a structured reply names, with its rank and reason.

    ``replies(request_id, place, name, rank, reason)`` in the order of the reply, ``table(request_id, row, id, term, genes,
    p)`` in the order of the enrichment table. A named term takes the first row whose term holds the name, letter case
    ignored; of several that take the same id the first in the reply counts. Names without a row, null or empty ones drop.

    Equal names of a request share one look-up, and of equal terms only the first row can be taken. What is left meets by
    the first characters of the names, not every name with every row of its request.
    """
    named = replies.filter(F.length("name") > 0).select("request_id", "place", F.lower("name").alias("name"), "rank", "reason")
    rows = table.select("request_id", F.lower("term").alias("low"), "row", "id", "term", "genes", "p").filter(F.col("low").isNotNull())
    terms = top_k(rows, ["request_id", "low"], [F.col("row"), F.col("id")], 1)
    met = named_terms(named.select("request_id", "name").distinct(), terms).filter(F.contains("low", "name")).drop("low")
    found = top_k(met, ["request_id", "name"], [F.col("row"), F.col("id")], 1)
    taken = salted_join(named, found, ["request_id", "name"])
    first = top_k(taken, ["request_id", "place"], [F.col("row"), F.col("id")], 1)
    once = top_k(first, ["request_id", "id"], [F.col("place")], 1)
    return once.select("request_id", "id", "term", "rank", "reason", "genes", "p")


def first_match(pairs: DataFrame, text_id: str, pattern_id: str) -> DataFrame:
    """First matching text of each pattern, then each text once (its first pattern)."""
    first = pairs.groupBy(pattern_id).agg(F.min(text_id).alias(text_id))
    return first.groupBy(text_id).agg(F.min(pattern_id).alias(pattern_id))


def passages(corpus: DataFrame, keep: list[str], text: str, title: str, words: int = 100) -> DataFrame:
    """Blocks of ``words`` space-separated words of every whole text; null texts are skipped."""
    split = corpus.filter(F.col(text).isNotNull()).select(
        *keep, F.coalesce(title, F.lit("")).alias("title"), F.split(text, " ").alias("__w"))
    starts = F.sequence(F.lit(0), F.floor((F.size("__w") - 1) / words))
    blocks = F.transform(starts, lambda i: F.trim(F.array_join(F.slice("__w", (i * words + 1).cast("int"), words), " ")))
    return split.select(*keep, "title", F.posexplode(blocks).alias("block", "passage"))


def gene_list_text(genes: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(genes), lambda g: F.concat(F.lit("{"), g, F.lit("}"))), ",")


def prompts(requests: DataFrame, task: str, answer: str, retry: str) -> DataFrame:
    """(request_id, system, user) from phenotype, genes array and, on a retry, prev_gene and rule.

    The system text is ``task``, on a retry ``retry`` with its two %s filled, and ``answer``, which asks for a reply in the
    form that :func:`parse_replies` reads.
    """
    again = F.concat(F.lit(" "), F.format_string(retry, "prev_gene", "rule"))
    system = F.concat(F.lit(task), F.when(F.col("rule").isNull(), "").otherwise(again), F.lit(" " + answer))
    user = F.concat(F.lit("GWAS Phenotype: "), "phenotype", F.lit("\nGenes: "), gene_list_text(F.col("genes")))
    return requests.select("request_id", system.alias("system"), user.alias("user"))


def retry_requests(predictions: DataFrame, proofs: DataFrame, rule: str) -> DataFrame:
    """The predictions whose gene no proof supports, as requests to be asked once more.

    ``predictions(request_id, snp, phenotype, genes, causal_gene)``, ``proofs(snp, gene)``; ``rule`` names what failed,
    with %s for the gene and the variant. A prediction without a gene is asked again without a rule.
    """
    proven = proofs.select("snp", F.col("gene").alias("causal_gene")).distinct()
    failed = predictions.join(proven, ["snp", "causal_gene"], "left_anti")
    return failed.select(
        "request_id", "phenotype", "genes", F.col("causal_gene").alias("prev_gene"),
        F.when(F.col("causal_gene").isNotNull(), F.format_string(rule, "causal_gene", "snp")).alias("rule"))


REPLY_SCHEMA = "causal_gene string, confidence double, reason string, _corrupt_record string"


def parse_replies(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Reply fields as columns and ``needs_retry`` for text that is no such object."""
    parsed = F.from_json(column, REPLY_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = replies.withColumn("__r", parsed)
    bad = F.col("__r._corrupt_record").isNotNull() | F.col("__r.causal_gene").isNull()
    keep = [c for c in replies.columns if c != column]
    return rows.select(
        *keep, F.when(~bad, F.col("__r.causal_gene")).alias("causal_gene"),
        F.when(~bad, F.col("__r.confidence")).alias("confidence"), F.when(~bad, F.col("__r.reason")).alias("reason"),
        bad.alias("needs_retry"))
