import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from locusloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é.'s\n\t\r 　1<|>", max_size=30), min_size=1, max_size=5))
def test_encoder_equals_tokenizer(tokenizer, texts):
    texts = [*texts, "<|endoftext|> it's", None]
    got = [list(x) for x in packing.encoder(PATH).batch(pa.array(texts, pa.string()))]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def check(spark, tokenizer, rows, pieces):
    """Every id lies in one piece, sequences have no gap, and only the last one is padded much."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        by_doc[p.doc_id].append((p.start, p.doc_tokens, ids))
        by_sequence[p.sequence_id].append((p.offset, len(ids)))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= packing.LENGTH
    used = sorted(sum(n for _, n in parts) for parts in by_sequence.values())
    assert all(n >= packing.LENGTH - packing.SLACK for n in used[1:])
    wanted = defaultdict(list)
    for doc_id, text in rows:
        wanted[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID])
    for doc_id, texts in wanted.items():
        assert sum(map(len, texts)) == sum(len(ids) for _, _, ids in by_doc[doc_id])
        if len(texts) == 1:
            at, whole = 0, []
            for start, tokens, ids in sorted(by_doc[doc_id], key=lambda x: x[0]):
                assert start == at and tokens == len(texts[0])
                at += len(ids)
                whole += ids.tolist()
            assert whole == texts[0]
    assert set(by_doc) == set(wanted)


def test_round_trip_over_many_partitions(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    pieces = packing.pack(docs.repartition(70)).collect()
    check(spark, tokenizer, rows, pieces)
    digest = {(r.doc_id, r.start): r for r in packing.digest(packing.pack(docs)).collect()}
    for p in packing.pack(docs).collect():
        r = digest[p.doc_id, p.start]
        assert (r.length, r.ids_crc32) == (len(p.ids) // 4, zlib.crc32(p.ids))


def test_odd_rows(spark, documents, odd_rows, tokenizer):
    docs = documents(odd_rows)
    check(spark, tokenizer, [(r[0], r[1]) for r in odd_rows], packing.pack(docs).collect())
    assert packing.pack(documents([])).count() == 0


def test_fullest_window_leaves_when_none_fits():
    w = packing.Windows(0, length=10, most=2, slack=1)
    for i, n in enumerate((6, 7, 5)):
        w.add((i, 0, n, b"\0" * 4 * n))
    assert [(p[0], p[1], len(p[3]) // 4, p[5]) for p in w.out] == [(1, 0, 7, 0), (2, 0, 3, 7)]
    w.close()
    assert sum(len(p[3]) // 4 for p in w.out) == 18


def test_a_long_document_takes_time_in_proportion():
    def seconds(tokens):
        started = time.perf_counter()
        packing.Windows(0).add((1, 0, tokens, bytes(4 * tokens)))
        return time.perf_counter() - started

    seconds(100_000)
    assert seconds(8_000_000) < 12 * max(seconds(2_000_000), 0.02)
