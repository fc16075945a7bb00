"""Secrets in texts: fixed patterns, and long tokens that a battery of randomness tests cannot tell from random ones.

Every maximal run of at least ``LEAST`` letters, digits and ``+/_-`` is a candidate. Its encoding is inferred from the
characters it holds, which names an alphabet. Three tests ask whether its characters could be drawn at random from that
alphabet: a chi-squared test of uniformity (moments exact for short tokens), a runs test above and below the alphabet's
middle, and a serial-correlation test of neighbours; their p-values are combined by the Cauchy rule, which holds for
dependent tests. A token that passes is weighed against ordinary text: its share of equal character pairs against what
characters drawn with the frequencies of all documents would show. That p-value is exact to first order for every length,
so longer tokens can prove more, and false discoveries are held at ``RATE`` by Benjamini and Hochberg's step, taken in every
stratum of encoding and doubling length by itself, over the candidates of all documents.

DataFrame operations only. Texts are read twice, no row leaves its partition; what moves are counts per (stratum, score).
Two small results reach the driver: 64 character counts, and one threshold per stratum (eleven encodings, at most 31 lengths).

Defined results: a null text counts as empty; spans are code points with the end exclusive, of whole matches; a random
token inside a span of a fixed pattern is not named again; repeated rows and null ids keep their own row; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusloom.llm.common import saved
from locusloom.llm.registry import query, table

LEAST, PASS, RATE = 20, 0.001, 0.01
_FINE, _BLOCK = 100, 512

# The patterns of known secrets, in the order in which spans are listed; the least length of group 2 or of
# the match is checked apart. A run of hex digits is taken from its first digit, so the short runs need not be listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "random")

_RUN = r"(?<![\p{L}\p{N}+/_-])[\p{L}\p{N}+/_-]{%d,}+" % LEAST
_LOWER, _UPPER, _DIGIT = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: Encoding -> (characters a token may hold, groups of which it must hold one each, alphabet); the first that fits.
ENCODINGS = {
    "decimal": ("0-9", (), _DIGIT),
    "hex": ("0-9a-f", ("0-9", "a-f"), _DIGIT + "abcdef"),
    "hex_upper": ("0-9A-F", ("0-9", "A-F"), _DIGIT + "ABCDEF"),
    "lower": ("a-z", (), _LOWER),
    "upper": ("A-Z", (), _UPPER),
    "base32": ("A-Z2-7", (), _UPPER + "234567"),
    "lower_digit": ("a-z0-9", (), _LOWER + _DIGIT),
    "upper_digit": ("A-Z0-9", (), _UPPER + _DIGIT),
    "letters": ("A-Za-z", (), _UPPER + _LOWER),
    "base62": ("A-Za-z0-9", (), _UPPER + _LOWER + _DIGIT),
    "base64": ("A-Za-z0-9+/", (), _UPPER + _LOWER + _DIGIT + "+/"),
    "base64_url": ("A-Za-z0-9_-", (), _UPPER + _LOWER + _DIGIT + "-_"),
}
_CHARACTERS = _UPPER + _LOWER + _DIGIT + "+/-_"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_starts(lengths: Column) -> Column:
    """Sums of all earlier elements, per element: block by block, so work stays near linear for long arrays."""
    first = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    blocks = F.transform(first, lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))

    def starts(part: Column, at: Column) -> Column:
        begin = F.struct(F.array().cast("array<long>").alias("out"), at.alias("at"))
        step = lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), (acc["at"] + x).alias("at"))
        return F.aggregate(part, begin, step, lambda acc: acc["out"])

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + x))
    return F.flatten(F.zip_with(blocks, starts(totals, F.lit(0).cast("long")), starts))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>; ``value`` is the text of ``group``."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    sizes = F.transform(hits, lambda x: F.length(x).cast("long"))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), sizes, lambda g, s: g + s)
    ends = F.zip_with(running_starts(steps), steps, lambda a, b: a + b)
    found = F.transform(F.arrays_zip(ends.alias("end"), sizes.alias("size"), values.alias("value")), lambda m: F.struct(
        (m["end"] - m["size"]).alias("start"), m["end"].alias("end"), m["value"].alias("value")
    ))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z): a series near 0, a continued fraction beyond 2."""

    def positive(x: Column) -> Column:
        density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        near = F.aggregate(
            F.sequence(F.lit(1), F.lit(30)), F.struct(x.alias("term"), x.alias("sum")),
            lambda acc, k: F.struct((acc["term"] * x * x / (2 * k + 1)).alias("term"), (acc["sum"] + acc["term"] * x * x / (2 * k + 1)).alias("sum")),
            lambda acc: 0.5 - density * acc["sum"],
        )
        far = density / F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / acc)
        return F.when(x < 2, near).otherwise(far)

    size = F.least(F.abs(z), F.lit(37.0))
    return _let(size, lambda x: F.when(z < 0, 1 - positive(x)).otherwise(positive(x)))


def encoding(token: Column) -> Column:
    """Name of the first encoding that fits, else null."""
    name = F.lit(None).cast("string")
    for kind, (may, must, _) in reversed(ENCODINGS.items()):
        fits = token.rlike(f"^[{may}]+$")
        for part in must:
            fits = fits & token.rlike(f"[{part}]")
        name = F.when(fits, kind).otherwise(name)
    return name


def _pick(kind: Column, of) -> Column:
    """``of(alphabet)`` of the encoding named."""
    out = F.lit(None)
    for name, (_, _, alphabet) in ENCODINGS.items():
        out = F.when(kind == name, F.lit(of(alphabet))).otherwise(out)
    return out


def features(token: Column, kind: Column) -> Column:
    """struct(n, a, pairs, ones, turns, sx, sxx, sxy): what the tests need, in whole numbers."""
    n, alphabet = F.length(token), _pick(kind, lambda a: a)
    halves = F.lit(None).cast("string")
    for name, (_, _, chars) in ENCODINGS.items():
        low = "".join("01"[2 * i >= len(chars)] for i in range(len(chars)))
        halves = F.when(kind == name, F.translate(token, chars, low)).otherwise(halves)
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("long"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def rest(x: Column) -> Column:
        codes, bits = x["codes"], x["bits"]
        turned = F.concat(F.slice(codes, F.lit(2), F.size(codes) - 1), F.slice(codes, 1, 1))
        return F.struct(
            n.cast("double").alias("n"), F.length(alphabet).cast("double").alias("a"),
            total(F.transform(F.array_distinct(codes), lambda c: _let(
                F.size(F.filter(codes, lambda d: d == c)).cast("long"), lambda m: m * (m - 1)))).cast("double").alias("pairs"),
            (n - F.length(F.replace(bits, F.lit("1"), F.lit("")))).cast("double").alias("ones"),
            (1 + (2 * n - F.length(F.replace(bits, F.lit("01"), F.lit(""))) - F.length(F.replace(bits, F.lit("10"), F.lit("")))) / 2)
            .cast("double").alias("turns"),
            total(codes).cast("double").alias("sx"), total(F.transform(codes, lambda c: c * c)).cast("double").alias("sxx"),
            total(F.zip_with(codes, turned, lambda c, d: c * d)).cast("double").alias("sxy"),
        )

    return _let(F.struct(codes.alias("codes"), halves.alias("bits")), rest)


def p_random(f: Column) -> Column:
    """Combined p-value of the three tests: characters drawn uniformly and independently from the alphabet."""
    n, a = f["n"], f["a"]
    chi = a * (f["pairs"] + n) / n - n
    scale = (n - 1) / n  # variance over twice the mean
    df = (a - 1) / scale
    uniform = upper_tail((F.pow(chi / (scale * df), F.lit(1 / 3)) - 1 + 2 / (9 * df)) / F.sqrt(2 / (9 * df)))
    ones, zeros = f["ones"], n - f["ones"]
    expected = 2 * ones * zeros / n + 1
    runs = F.when(ones * zeros == 0, F.pow(F.lit(2.0), 1 - n)).otherwise(
        2 * upper_tail(F.abs(f["turns"] - expected) / F.sqrt((expected - 1) * (expected - 2) / (n - 1)))
    )
    spread = n * f["sxx"] - f["sx"] * f["sx"]
    r = (n * f["sxy"] - f["sx"] * f["sx"]) / spread
    serial = F.when(spread == 0, F.lit(0.0)).otherwise(
        2 * upper_tail(F.abs(r + 1 / (n - 1)) * (n - 1) / F.sqrt(n * (n - 3) / (n + 1)))
    )
    bend = lambda p: F.tan((0.5 - F.least(F.greatest(p, F.lit(1e-15)), F.lit(0.99))) * math.pi)
    return 0.5 - F.atan((bend(uniform) + bend(runs) + bend(serial)) / 3) / math.pi


def p_ordinary(f: Column, two: Column, three: Column) -> Column:
    """P(as few equal pairs or fewer) for characters of ordinary text; ``two``, ``three``: sums of squared and cubed shares."""
    n = f["n"]
    variance = (4 * (n - 2) * (three - two * two) + 2 * (two - two * two)) / (n * (n - 1))
    return upper_tail((two - f["pairs"] / (n * (n - 1))) / F.sqrt(F.greatest(variance, F.lit(1e-12))))


def character_shares(docs: DataFrame, text_col: str) -> dict[str, tuple[float, float]]:
    """Per encoding the sums of squared and cubed shares of its characters, over all texts; one row reaches the driver."""
    text = F.col(text_col)
    row = docs.agg(*[
        F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))).alias(f"c{i}") for i, c in enumerate(_CHARACTERS)
    ]).first()
    count = {c: row[i] or 0 for i, c in enumerate(_CHARACTERS)}
    shares = {}
    for name, (_, _, alphabet) in ENCODINGS.items():
        total = sum(count[c] for c in alphabet)
        part = [count[c] / total if total else 1 / len(alphabet) for c in alphabet]
        shares[name] = (sum(p**2 for p in part), sum(p**3 for p in part))
    return shares


def thresholds(scored: DataFrame, rate: float) -> dict[tuple[str, int], int]:
    """(encoding, length stratum) -> least score that is a discovery, by Benjamini and Hochberg's step over folded scores."""
    counts = scored.groupBy("kind", "stratum", "score").agg(F.count("*").alias("n"))
    down = Window.partitionBy("kind", "stratum").orderBy(F.desc("score"))  # at most 300 * _FINE + 1 rows per stratum
    reached = counts.withColumn("upto", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy("kind", "stratum")))
    fits = F.pow(F.lit(10.0), -F.col("score") / _FINE) <= rate * F.col("upto") / F.col("all")
    rows = reached.filter(fits).groupBy("kind", "stratum").agg(F.min("score").alias("least")).collect()
    return {(r["kind"], r["stratum"]): r["least"] for r in rows}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per document: its id and ``spans``, array<struct<start, kind_no, end, kind>> in the order of KINDS at one start."""
    shares = character_shares(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = lambda found, no: F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(no).alias("kind_no"), m["end"].alias("end"), F.lit(KINDS[no]).alias("kind")))
    base = F.concat(
        plain(F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_VALUE), 0),
        plain(matches(text, ACCESS), 1), plain(matches(text, HEX), 2),
    )
    typed = F.transform(matches(text, _RUN), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), encoding(m["value"]).alias("kind")))

    def judged(m: Column) -> Column:
        two, three = (F.lit(None).cast("double"), F.lit(None).cast("double"))
        for name, (s2, s3) in shares.items():
            two, three = F.when(m["kind"] == name, s2).otherwise(two), F.when(m["kind"] == name, s3).otherwise(three)
        return _let(features(m["value"], m["kind"]), lambda f: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"),
            F.floor(F.log2(f["n"])).cast("int").alias("stratum"), p_random(f).alias("p_random"),
            F.least(F.lit(300 * _FINE), F.floor(-_FINE * F.log10(F.greatest(p_ordinary(f, two, three), F.lit(1e-300))))).cast("int").alias("score"),
        ))

    found = saved(
        docs.select(F.col(id_col).alias("id"), base.alias("base"), F.filter(typed, lambda m: m["kind"].isNotNull()).alias("runs"))
        .select("id", "base", F.transform("runs", judged).alias("runs")), "tokens",
    )
    least = thresholds(found.select(F.explode("runs").alias("r")).select("r.kind", "r.stratum", "r.score"), rate)
    limit = lambda m: F.coalesce(
        *[F.when((m["kind"] == kind) & (m["stratum"] == band), at) for (kind, band), at in sorted(least.items())], F.lit(1 << 30))
    secret = lambda m: (m["p_random"] >= PASS) & (m["score"] >= limit(m)) & ~F.exists(
        "base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"]))
    spans = F.sort_array(F.concat("base", plain(F.filter("runs", secret), 3)))
    return found.select(F.col("id").alias(id_col), spans.alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op11_secrets")
def _secrets(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda no: F.size(F.filter("spans", lambda s: s["kind_no"] == no)).cast("long")
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count(3).alias("n_random"),
    )
