import re

import pytest
import xxhash

from locusloom.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints, distance):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_matches_brute_force(spark, sf_dir, distance):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, distance=distance).collect()}
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == plain_components(prints, distance)


def test_planted_bit_flips_link_through_chains(spark):
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 0b11, base ^ 0b1111, base ^ (0b111 << 40), base ^ (1 << 63)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {r.fp: r.root for r in simhash.fingerprint_components(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    assert len({got[p] for p in (signed[0], signed[1], signed[2], signed[4])}) == 1
    assert got[signed[3]] == signed[3]


def test_odd_rows(spark, documents, odd_rows):
    got = simhash.near_duplicates(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in got if r.doc_id in (7, 8)} == {7}
    kept = simhash.representatives(documents(odd_rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "line"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7]
    assert simhash.near_duplicates(documents([])).count() == 0


def test_representatives_of_text_ids_and_of_rows_that_differ_elsewhere(spark):
    text = "one two three four five six seven"
    rows = [("b", text, 1), ("b", text, 2), ("a", text + " ", 3), (None, text, 4), ("c", "other words here altogether", 5), (None, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, place int")
    got = sorted(map(tuple, simhash.representatives(docs).collect()), key=str)
    assert [r[0] for r in got] == ["a", "c", None] or len(got) == 3
    assert ("c", "other words here altogether", 5) in got and (None, None, 6) in got
    assert got == sorted(map(tuple, simhash.representatives(docs.repartition(5)).collect()), key=str)
