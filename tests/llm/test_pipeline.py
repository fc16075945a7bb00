"""The pipeline's stages against plain versions of them, on the smallest tables."""

from collections import Counter

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from locusloom.llm.common import saved
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_mixing import plain_targets
from tests.llm.test_packing import check as check_packing
from tests.llm.test_simhash import plain_components, plain_fingerprint


def test_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "packing"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, "1234 !!")], "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' lang", "'src0' source", "cast(length(text) as bigint) n_chars")
    out = [docs.unionByName(extra)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], sf_dir), f"test-{name}"))
    return [(df.columns, df.collect()) for df in out]


def test_columns_stay(stages):
    assert all(columns == stages[0][0] for columns, _ in stages[:-1])


def test_language_keeps_every_text_with_a_letter(stages):
    (_, given), (_, kept) = stages[0], stages[1]
    assert {r.doc_id for r in kept} == {r.doc_id for r in given if any(c.isalpha() for c in r.text or "")}
    texts = {r.doc_id: r for r in given}
    assert all(r.text == texts[r.doc_id].text and r.lang in {"en", "de", "fr", "es"} for r in kept)
    assert sum(r.lang == texts[r.doc_id].lang for r in kept) > 0.97 * len(kept)


def test_lines(stages):
    (_, given), (_, cut) = stages[1], stages[2]
    want = plain_lines([(r.doc_id, r.text) for r in given])
    wrong = [r.doc_id for r in cut if r.text != want[r.doc_id]]
    assert len(wrong) <= 0.01 * len(want)
    assert len(cut) == len(given) and all(r.n_chars == len(r.text) for r in cut)


def test_near_duplicates(stages):
    (_, given), (_, kept) = stages[2], stages[3]
    groups = plain_components({r.doc_id: plain_fingerprint(r.text) for r in given}, 2)
    assert sorted(r.doc_id for r in kept) == sorted(set(groups.values()))


def test_mixture(stages):
    (_, given), (_, mixed) = stages[3], stages[4]
    words = lambda t: len((t or "").split())
    sizes, taken = Counter(), Counter()
    for r in given:
        sizes[r.source] += words(r.text)
    for r in mixed:
        taken[r.source] += words(r.text)
    times = Counter(r.doc_id for r in mixed)
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in given}
    want = plain_targets(sizes)
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.03 * target + 30


def test_sequences(spark, stages):
    (_, given), (_, pieces) = stages[4], stages[5]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(spark, tokenizer, [(r.doc_id, r.text) for r in given], pieces)


def test_odd_rows(spark, sf_dir, documents, odd_rows):
    docs = documents(odd_rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"odd-{name}")
        assert docs.columns == documents(odd_rows).columns
    ids = {r.doc_id for r in docs.collect()}
    assert ids <= {5, 6, 7, 8, None} and corpus_pipeline.pack_sequences(spark, docs, sf_dir).count() > 0
    empty = documents([])
    for name, stage in corpus_pipeline.STAGES:
        empty = saved(stage(spark, empty, sf_dir), f"empty-{name}")
        assert empty.count() == 0


def test_line_stage_keeps_given_counts(spark):
    docs = spark.createDataFrame([(1, "a line\na line", 77, "x")], "doc_id long, text string, n_lines long, n_kept string")
    got = corpus_pipeline.deduplicate_lines(spark, docs, "")
    assert got.columns == docs.columns and list(map(tuple, got.collect())) == [(1, "a line", 77, "x")]
