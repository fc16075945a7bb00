"""Automata against dictionaries, collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusloom.llm import automaton, collocations
from locusloom.llm.automaton import Transducer

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def transducer(table):
    """{tuple of words: count} as an automaton."""
    labels = sorted({w for path in table for w in path})
    number = {w: i for i, w in enumerate(labels)}
    rows = np.array([[number[w] for w in p] + [-1] * (3 - len(p)) for p in table], np.int32).reshape(-1, 3)
    labels = pa.array(labels, pa.binary())
    return Transducer.build(labels, *automaton.folded(rows, np.array(list(table.values()), np.int64), len(labels)))


def contents(labels, paths, counts):
    text = labels.to_pylist()
    return {tuple(text[i] for i in p if i >= 0): int(c) for p, c in zip(paths.tolist(), counts, strict=True)}


words_ = st.sampled_from([b"a", b"b", b"ab", b"\xc3\xa9", b"\x01", b"z" * 40])
tables = st.dictionaries(st.lists(words_, min_size=1, max_size=3).map(tuple), st.integers(1, 1 << 50), max_size=40)


@settings(max_examples=80, deadline=None)
@given(tables, tables)
def test_round_trip_union_and_composition(one, two):
    a, b = transducer(one), transducer(two)
    for made, table in ((a, one), (b, two)):
        again = Transducer.loads(made.dumps())
        assert contents(again.labels, *again.paths()) == table
    assert contents(*automaton.union([a, b])) == dict(Counter(one) + Counter(two))
    paths, _ = a.paths()
    assert contents(a.labels, paths, b.compose(a.labels, paths)) == {p: two.get(p, 0) for p in one}


def test_equal_states_are_kept_once():
    table = {(f"{i}".encode(), b"x"): 1 for i in range(500)} | {(f"{i}".encode(), b"x", b"y"): 1 for i in range(500)}
    made = transducer(table)
    assert [len(level[1]) for level in made.levels] == [500, 1, 1]
    assert contents(made.labels, *made.paths()) == table


def test_equal_fingerprints_do_not_merge_unlike_states(monkeypatch):
    monkeypatch.setattr(automaton, "mixed", lambda x: np.zeros(len(x), np.uint64))
    table = {(a, b, c): 1 + (a < b) for a in (b"a", b"b", b"c") for b in (b"d", b"e") for c in (b"f", b"g")}
    made = transducer(table)
    assert contents(made.labels, *made.paths()) == table


def test_wide_vocabularies_order_like_narrow_ones(monkeypatch):
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 30, (400, 3)).astype(np.int32)
    rows[:100, 2] = -1
    rows[:40, 1] = -1
    narrow = automaton.folded(rows, np.ones(400, np.int64), 30)
    wide = automaton.folded(rows, np.ones(400, np.int64), 1 << 22)
    assert all((x == y).all() for x, y in zip(narrow, wide, strict=True))


def plain(rows, least=10, absorb=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({ord(c): c.lower() for c in UPPER})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    rows = []
    for (lang, w), a in found.items():
        if any(100 * b >= absorb * a and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) for (m, v), b in found.items() if m == lang):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        rows.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(lang, i + 1, *r[1:]) for i, r in enumerate(ranked)]
    return sorted(out)


def run(spark, rows, top=2000, **how):
    docs = spark.createDataFrame([(lang, text, "x", i) for i, (lang, text) in enumerate(rows)], "lang string, text string, phrase string, n int")
    got = collocations.best(collocations.collocations(docs, **how), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(map(tuple, got.collect()))


def corpus(seed):
    rng = random.Random(seed)
    words = ["The", "of", "and", "é", "x\xa0y", "\x01", "ab", "abc", "𝔘", "New", "York", "city"] + [f"w{i}" for i in range(12)]
    weights = [30, 25, 20] + [3] * 21
    rows = []
    for i in range(150):
        text = ""
        for _ in range(rng.randint(0, 12)):
            piece = rng.choices(words, weights, k=rng.randint(0, 14)) + (["New York  City"] if rng.random() < 0.3 else [])
            text += rng.choice([" ", "\t", "  "]).join(piece) + rng.choice([". ", ",", "!?", "\n", "\r\n", "\x0b"])
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return rows


@pytest.mark.parametrize(("seed", "shard", "part"), [(1, 16 << 20, 8 << 20), (2, 300, 900), (3, 40, 4000)])
def test_matches_plain_counts(spark, monkeypatch, seed, shard, part):
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "RANGE", part)
    rows = corpus(seed)
    expected = plain(rows)
    assert len(expected) > 100
    assert run(spark, rows) == expected


def test_top_and_ties(spark):
    rows = [("en", "a b. c d. e f. " * 12), ("en", "g h " * 3)]
    assert run(spark, rows, top=2) == plain(rows, top=2)


@pytest.mark.parametrize("size", [1, 2, 5, 17])
def test_blocks_keep_every_phrase(size):
    data = "the cat  sat on\tthe mat. the cat sat, on the mat the cat sat on the mat".encode().translate(collocations._FOLD)
    every = lambda block, own: sum((Counter(contents(*collocations.counted("en", block, own, k))) for k in (1, 2, 3)), Counter())
    assert every(data, len(data)) == sum((every(block, own) for block, own in collocations.blocks(data, size)), Counter())


def test_a_small_bit_set_drops_only_phrases_with_rare_parts(spark, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(collocations, "BITS", 7)  # most rare paths are held by chance
    assert run(spark, rows) == plain(rows)


def test_products_beyond_64_bits():
    a, l, r = (np.array([x], np.int64) for x in (3_000_000_000, 4_000_000_000, 5_000_000_000))
    zero = np.zeros(1, np.int64)
    got = collocations.weakest(a, [(l, r), (zero, zero)])
    assert int(got[2][0]) == 1_000_000 * 3_000_000_000**2 // (4_000_000_000 * 5_000_000_000)


def test_odd_rows(spark, odd_rows):
    rows = [(lang, text) for _, text, lang, _ in odd_rows] + [("", "p q " * 20), ("en", "Same text here\nand a second line of it\n" * 11)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []
    assert run(spark, [(None, None), ("en", "")]) == []
