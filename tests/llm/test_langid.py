from itertools import product

import numpy as np
from pyspark.sql import functions as F

from locusloom.llm import langid
from locusloom.llm.registry import QUERIES


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    sizes = np.array([4, 0, 6, 1])
    scores = rng.normal(size=(sizes.sum(), 3)) * 6

    def value(part, path):
        return sum(part[i, s] for i, s in enumerate(path)) - langid.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False))

    got, at = langid.viterbi(scores, sizes), 0
    for n in sizes:
        part = scores[at : at + n]
        best = max(product(range(3), repeat=int(n)), key=lambda path: value(part, path))
        assert tuple(got[at : at + n]) == best
        at += n


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES["op2_language_id"](spark, sf_dir).filter("held_out")
    joined = got.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 150 and right > 0.98


def test_spans_scripts_and_odd_rows(spark, documents, odd_rows):
    ru = "это простой русский текст про язык " * 3
    en = "this is some plain english text about language "
    de = "das ist ein einfacher deutscher text und die sprache "
    train = documents([(i, t, lang, "s") for i, (t, lang) in enumerate([(ru, "ru"), (en, "en"), (de, "de")] * 5)] + [(None, "zz", "zz", "s"), (99, None, "yy", "s")])
    model = langid.fit(train.filter("doc_id is not null"), draw=F.xxhash64("doc_id"))
    assert model.langs == ["de", "en", "ru"]
    text = en * 2 + ru + de * 2
    spans = langid.spans_of([text, "12 !", "ж"], model)
    assert [s["lang"] for s in spans[0]] == ["en", "ru", "de"] and spans[1] == [] and spans[2][0]["lang"] == "ru"
    assert text[spans[0][1]["start"] : spans[0][1]["end"]] == ru.strip()
    assert sum(s["letters"] for s in spans[0]) == sum(c.isalpha() for c in text)
    got = {(r.doc_id, r.text): r.found for r in langid.identify(documents(odd_rows)).collect()}
    assert {got[i, t].lang for i, t in [(1, None), (2, ""), (3, "  \n\t "), (4, "12 34 !!"), (None, None)][:3]} == {"und"}
    assert got[4, "12 34 !!"].lang == "und" and got[5, "one"].lang != "und" and 0 < got[5, "one"].score <= 1
    assert langid.identify(documents([])).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(langid, "SLICE_CHARS", 50)
    text = "wordsandmore " * 40 + "x" * 200
    assert "".join(langid._pieces(text)) == text
    table = np.zeros((langid.BUCKETS + 1, 2), np.float32)
    model = langid.Model(["a", "b"], table, np.ones((langid.SCRIPTS, 2), bool))
    (spans,) = langid.spans_of([text], model)
    assert (spans[0]["start"], spans[-1]["end"], sum(s["words"] for s in spans)) == (0, len(text), 41)
